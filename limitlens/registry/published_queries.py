"""Published reports, and rules whose patterns are checked."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from limitlens.operators import published as P, report, rule_scan as Z, rules as R
from limitlens.registry import limit_queries as LQ, tables as T
from limitlens.session import ensure_checkpoint_dir


def reports_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of two dates, one of them published twice, as a reader sees them."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/reports-{uuid.uuid4().hex}"
    for months in ((T.PRIOR, T.CURRENT), (T.CURRENT,)):
        inputs = T.limit_inputs(spark, sf_dir, list(months), months)
        P.publish(report.report_tables(report.analyze(inputs)), path)
    rows = P.read_section(spark, path, "LIMIT_MONITORING").groupBy("base_dt").agg(F.count("*").alias("limit_rows"))
    exceptions = P.read_section(spark, path, "SUMMARY").select("base_dt", "exception_count")
    written = P.commits(spark, path).groupBy("base_dt").agg(F.count("*").alias("commits"))
    live = P.current(spark, path).agg(F.count("*").alias("reports")).first()["reports"]
    return written.join(rows, "base_dt").join(exceptions, "base_dt").withColumn("reports", F.lit(live).cast("long"))


def _part_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules from the names of parts; some have an open group, class or a repetition of nothing."""
    part = T.table(spark, sf_dir, "part")
    name, size = F.col("p_name"), F.col("p_size")
    pattern = F.when(size < 10, F.concat(F.lit("("), name)).when(size < 15, F.concat(name, F.lit("["))).when(size < 20, F.concat(F.lit("*"), name)).otherwise(F.concat(F.lit(r"\b"), name))
    return R.with_code(part.select(F.lit(R.SQL_DENY).alias("group"), F.col("p_partkey").alias("rule_no"), pattern.alias("pattern")))


def rule_pattern_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pattern_findings(_part_rules(spark, sf_dir))


def rule_patterns_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the rules that compile in the names of all parts; the broken ones do no harm."""
    part = T.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    rules = R.usable_rules(_part_rules(spark, sf_dir)).select("code", "pattern", "severity", "message").distinct()
    return Z.scan_table(part, "p_name", rules, ["p_partkey"]).select("p_partkey", "code", "message", "position")


QUERIES = {f.__name__: f for f in (reports_published, rule_pattern_findings, rule_patterns_usable)}

_PATTERNS = """rules AS (SELECT p_partkey, p_size, p_name, CASE WHEN p_size < 10 THEN '(' || p_name WHEN p_size < 15 THEN p_name || '['
  WHEN p_size < 20 THEN '*' || p_name ELSE '\\b' || p_name END AS pattern FROM part)"""
SQL = {
    "reports_published": f"""WITH {T.EXPOSURES_SQL}, n AS (SELECT base_dt, count(*) AS limit_rows FROM exposures WHERE base_dt IN ('{T.CURRENT}', '{T.PRIOR}') GROUP BY base_dt),
      x AS (SELECT base_dt, sum(n) AS exceptions FROM ({LQ.SQL['recon_exceptions']}) GROUP BY base_dt)
      SELECT base_dt, CASE base_dt WHEN '{T.CURRENT}' THEN 2 ELSE 1 END AS commits, limit_rows, CAST(exceptions AS BIGINT) AS exception_count, 2 AS reports
      FROM n JOIN x USING (base_dt)""",
    "rule_pattern_findings": f"""WITH {_PATTERNS} SELECT 'sql_deny' AS "group", p_partkey AS rule_no, pattern, 'RULE_PATTERN_INVALID' AS code,
      'High' AS severity FROM rules WHERE p_size < 20""",
    "rule_patterns_usable": f"""WITH {_PATTERNS}, good AS (SELECT DISTINCT p_name AS name, pattern FROM rules WHERE p_size >= 20)
      SELECT p_partkey, 'SQL_DENY_PATTERN' AS code, 'sql_deny: ' || pattern AS message, instr(p_name, name) - 1 AS position
      FROM part JOIN good ON p_name = name OR contains(p_name, ' ' || name) OR starts_with(p_name, name)""",
}
