"""Results with their place in the order, and line numbers of files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from limitlens import schema as S
from limitlens.functions.text import sha256_hex
from limitlens.operators import limits as L, priorday as D, reconcile as R, templates as M, visual as V
from limitlens.plans.order import ranked
from limitlens.registry import limit_queries as LQ, report_queries as RQ, table_queries as TQ, tables as T
from limitlens.session import ensure_checkpoint_dir
from limitlens.sources import catalog as G, lines as N


def exceptions_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all exceptions, counted by what they say."""
    inputs = T.limit_inputs(spark, sf_dir)
    found = R.recon_exceptions(inputs, L.limit_status(inputs)).groupBy(
        "base_dt", "check_order", "code", "severity", "portfolio_id", "risk_factor"
    ).agg(F.sum("n").alias("n"))
    return R.ranked_exceptions(found).drop("check_order")


def comparison_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = D.prior_day(L.limit_status(T.limit_inputs(spark, sf_dir)), RQ.month_pairs(spark, sf_dir))
    return D.ranked_comparison(compared).select("current_dt", "prior_dt", "portfolio_id", "risk_factor", "movement", "rank")


def heatmap_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.ranked_heatmap(V.heatmap(L.limit_status(T.limit_inputs(spark, sf_dir))))
    return T.doubles(rows.withColumnRenamed("_row_no", "row_no"), "usage_ratio", places=10)


def clauses_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    clauses = G.load_clause_pack(TQ._pack(spark, sf_dir, F.substring(sha256_hex("text"), 1, 16))).clauses
    # Places need no texts: without them, none is shuffled or stored again.
    return G.ranked_clauses(clauses.drop("clause_text")).select("source_id", "clause_ref", "chunk_id", "source_text_hash", "rank")


def usage_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit usage report of one date in its order."""
    usage = M.ranked_usage(M.limit_usage(*RQ._prepared(spark, sf_dir), T.CURRENT))
    return T.doubles(usage, "EXPOSURE_AMT", "LIMIT_AMT", "LIMIT_USAGE_RATE")


def findings_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(RQ.prior_day_findings(spark, sf_dir), ("current_dt", "prior_dt", "code", "severity"))


def ragged_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ragged lines of delimited files, one of each month's orders, with their numbers."""
    orders = T.table(spark, sf_dir, "orders")
    key, status, priority = F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority")
    line = (
        F.when(priority == "1-URGENT", F.concat_ws(",", key, status)).when(priority == "2-HIGH", F.concat_ws(",", key, status, F.lit("long"), F.lit("extra")))
        .when(priority == "3-MEDIUM", F.concat(key, F.lit(","), status, F.lit(',"said ""'), status, F.lit('"", left"')))
        .when(priority == "4-NOT SPECIFIED", F.lit(" \t ")).otherwise(F.concat(key, F.lit(", "), status, F.lit(",")))
    )
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/limitlens-{uuid.uuid4().hex}"
    rows = orders.select(F.date_format("o_orderdate", "yyyyMM").alias("month"), "o_orderkey", line.alias("O_KEY,O_STATUS,O_NOTE"))
    plain = {"header": "true", "quote": "\u0000", "sep": "\u0001", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    rows.repartition("month").sortWithinPartitions("month", "o_orderkey").drop("o_orderkey").write.options(**plain).partitionBy("month").csv(folder)
    found = N.ragged_lines(N.numbered_lines(spark, folder))
    return found.select(F.regexp_extract("file", "month=([0-9]+)", 1).alias("month"), "line_no", "fields", "expected")


QUERIES = {
    f.__name__: f
    for f in (exceptions_ranked, comparison_ranked, heatmap_ranked, clauses_ranked, usage_ranked, findings_ranked, ragged_line_numbers)
}


def _placed(sql: str, order: str) -> str:
    return f"SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM ({sql})"


_CHECKS = f"coalesce(list_position([{', '.join(repr(c) for c in S.RECON_CODES)}], code), 0)"
SQL = {
    "exceptions_ranked": _placed(LQ.SQL["recon_exceptions"], f"base_dt, {_CHECKS}, upper(portfolio_id), upper(risk_factor), code, portfolio_id, risk_factor"),
    "comparison_ranked": _placed(f"SELECT current_dt, prior_dt, portfolio_id, risk_factor, movement FROM ({RQ.SQL['prior_day']})", "current_dt, prior_dt, portfolio_id, risk_factor"),
    "heatmap_ranked": _placed(RQ.SQL["heatmap"], "portfolio_id, risk_factor, base_dt, row_no"),
    "clauses_ranked": _placed(TQ.SQL["clause_pack"], "source_id, clause_ref, chunk_id"),
    "usage_ranked": _placed(RQ.SQL["tmpl_limit_usage"], "LIMIT_STATUS, LIMIT_USAGE_RATE DESC NULLS LAST, DESK_CD, PORTFOLIO_ID, RISK_FACTOR, LIMIT_AMT NULLS FIRST"),
    "findings_ranked": _placed(RQ.SQL["prior_day_findings"], "current_dt, prior_dt, code, severity"),
    "ragged_line_numbers": """SELECT month, line_no, CASE o_orderpriority WHEN '1-URGENT' THEN 2 ELSE 4 END AS fields, 3 AS expected
      FROM (SELECT strftime(o_orderdate, '%Y%m') AS month, o_orderpriority,
        row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y%m') ORDER BY o_orderkey) + 1 AS line_no FROM orders)
      WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')""",
}
