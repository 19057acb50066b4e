"""Table checks: base dates, catalog and clause pack loads, stored examples, report lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from limitlens.functions.dates import normalize_base_date
from limitlens.functions.text import sha256_hex
from limitlens.operators import audit as A, limits as L, reconcile as R, report as P, scan as C, templates as M
from limitlens.registry import limit_queries as Q, tables as T, text_queries as X
from limitlens.sources import catalog as G


def normalized_base_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in four ways, brought to one; an unknown form stays as it is."""
    orders = T.table(spark, sf_dir, "orders")
    day, priority = F.col("o_orderdate"), F.col("o_orderpriority")
    text = (
        F.when(priority == "1-URGENT", F.date_format(day, "yyyyMMdd"))
        .when(priority == "2-HIGH", F.concat(F.lit(" "), F.date_format(day, "yyyy-MM-dd"), F.lit("\t")))
        .when(priority == "3-MEDIUM", F.date_format(day, "yyyy/MM/dd"))
        .when(priority == "5-LOW", F.date_format(day, "yyyy-MM-dd"))
        .otherwise(F.concat(F.date_format(day, "yyyy"), F.lit("-02-30")))
    )
    return orders.select("o_orderkey", normalize_base_date(text).alias("base_dt"))


def catalog_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata problems of the part catalog, counted."""
    loaded = G.load_catalog(X.part_catalog(spark, sf_dir).drop("row_no"))
    return loaded.warnings.groupBy("problem", "field").agg(F.count("*").alias("entries"))


def catalog_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with a blank required value: customers as a catalog, some without category."""
    customer = T.table(spark, sf_dir, "customer")
    table = customer.select(
        F.col("c_name").alias("source_id"),
        F.when(F.col("c_acctbal") < 0, " ").otherwise(F.col("c_mktsegment")).alias("category"),
        F.col("c_name").alias("title"), F.lit("org").alias("source_org"), F.lit("type").alias("source_type"),
        F.lit("CATALOG_ONLY").alias("status"),
        F.when(F.col("c_nationkey") == 3, "").otherwise("note").alias("note"),
    )
    return G.load_catalog(table).errors.select("source_id", "problem", "field")


def _pack(spark: SparkSession, sf_dir: str, ref) -> DataFrame:
    docs = T.table(spark, sf_dir, "documents")
    return docs.select(
        ref.alias("clause_ref"), F.col("text").alias("clause_body"), F.col("source").alias("source_id"),
        F.lit("2024-01-01").alias("effective_date"), F.lit("").alias("repeal_date"), F.lit("p1").alias("pack_version"),
        F.col("doc_id").alias("_row_no"),
    )


def clause_pack_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a pack whose references repeat: later texts that differ are findings."""
    found = G.load_clause_pack(_pack(spark, sf_dir, F.col("lang"))).findings
    return found.groupBy("code", "detail").agg(F.count("*").alias("findings"))


def clause_pack_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clauses of that pack: none, since one finding rejects it."""
    return G.load_clause_pack(_pack(spark, sf_dir, F.col("lang"))).clauses.agg(F.count("*").alias("clauses"))


def clause_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a pack referenced by text: exact copies of a source are kept once."""
    ref = F.substring(sha256_hex("text"), 1, 16)
    clauses = G.load_clause_pack(_pack(spark, sf_dir, ref)).clauses
    return clauses.select("source_id", "clause_ref", "chunk_id", "source_text_hash")


def example_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored examples; foreign-language ones carry a wrong hash or length."""
    docs = T.table(spark, sf_dir, "documents")
    lang = F.col("lang")
    examples = docs.select(
        F.col("doc_id").cast("string").alias("exampleId"), F.lit("f").alias("feedbackId"),
        sha256_hex("source").alias("userIdHash"),
        F.when(lang == "es", None).otherwise(F.col("text")).alias("exampleBody"),
        F.when(lang == "es", 0).when(lang == "fr", -1).otherwise(F.length("text")).alias("exampleBodyLength"),
        F.when(lang == "es", None).when(lang == "de", sha256_hex("lang")).otherwise(sha256_hex("text")).alias("exampleBodyHash"),
    )
    checked = A.check_promoted_examples(examples)
    return checked.select("exampleId", F.explode("violations").alias("violation"))


def _exceptions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    inputs = T.limit_inputs(spark, sf_dir)
    exceptions = R.recon_exceptions(inputs, L.limit_status(inputs))
    scanned = C.scan(T.table(spark, sf_dir, "documents"), "text", X.TEXT_RULES)
    return exceptions, C.finding_rows(scanned, ["doc_id"])


def exception_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exceptions per code and severity together with severe findings of the documents."""
    listed = P.exception_list(*_exceptions(spark, sf_dir))
    return listed.groupBy("type", "code", "severity").agg(F.sum("n").alias("exceptions"))


def exception_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.exception_count(*_exceptions(spark, sf_dir))


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = T.table(spark, sf_dir, "lineitem")
    return items.select(
        F.concat(F.date_format("l_shipdate", "yyyyMM"), F.lit("01")).alias("base_dt"),
        F.concat("l_returnflag", "l_linestatus").alias("component_id"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("source_amount"),
    )


def tmpl_component_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.doubles(M.component_rows(_components(spark, sf_dir), T.CURRENT), "source_amount")


def tmpl_component_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _components(spark, sf_dir).groupBy("base_dt", "component_id").agg(
        F.sum("source_amount").alias("calculated_amount")
    )
    return T.doubles(M.component_results(results, T.CURRENT), "calculated_amount")


QUERIES = {
    f.__name__: f
    for f in (
        normalized_base_dates, catalog_warnings, catalog_errors, clause_pack_findings, clause_pack_rejected,
        clause_pack, example_violations, exception_list, exception_count, tmpl_component_rows, tmpl_component_results,
    )
}

_PACK = """pack AS (SELECT doc_id, source, lang, sha256(text) AS h,
  first_value(sha256(text)) OVER (PARTITION BY source, lang ORDER BY doc_id) AS first_h FROM documents)"""
_LISTED = f"""WITH {T.STATUS_SQL}, {Q.EXCEPTIONS_SQL},
listed AS (SELECT 'Analysis' AS type, code, severity, n FROM exc
  UNION ALL SELECT 'Validation', code, severity, 1 FROM ({X.text_scan_sql('documents', 'doc_id', False)})
  WHERE severity IN ('High', 'Blocker'))"""

SQL = {
    "normalized_base_dates": """SELECT o_orderkey, CASE o_orderpriority WHEN '3-MEDIUM' THEN strftime(o_orderdate, '%Y/%m/%d')
      WHEN '4-NOT SPECIFIED' THEN strftime(o_orderdate, '%Y') || '-02-30' ELSE strftime(o_orderdate, '%Y%m%d') END AS base_dt
      FROM orders""",
    "catalog_warnings": f"""WITH {X.PART_CATALOG_SQL} SELECT problem, field, count(*) AS entries FROM (
      SELECT 'METADATA_BLANK' AS problem, 'file_hash' AS field FROM cat
      UNION ALL SELECT 'METADATA_BLANK', 'approval_status' FROM cat WHERE approval_status = ''
      UNION ALL SELECT 'METADATA_BLANK', 'license_status' FROM cat WHERE license_status = ''
      UNION ALL SELECT 'DATE_FORMAT', 'effective_date' FROM cat WHERE effective_date = 'not_loaded'
      UNION ALL SELECT 'METADATA_COLUMN_MISSING', f FROM (VALUES ('file_hash'), ('superseded_by')) v(f)) GROUP BY ALL""",
    "catalog_errors": """SELECT c_name AS source_id, 'REQUIRED_VALUE_BLANK' AS problem, 'category' AS field FROM customer WHERE c_acctbal < 0
      UNION ALL SELECT c_name, 'REQUIRED_VALUE_BLANK', 'note' FROM customer WHERE c_nationkey = 3""",
    "clause_pack_findings": f"""WITH {_PACK} SELECT 'KB_CLAUSE_PACK_DUPLICATE_NATURAL_KEY' AS code,
      source || '/' || lang || '/p1' AS detail, count(*) AS findings FROM pack WHERE h <> first_h GROUP BY ALL""",
    "clause_pack_rejected": f"""WITH {_PACK} SELECT CASE WHEN count(*) FILTER (WHERE h <> first_h) > 0 THEN 0
      ELSE count(DISTINCT source || lang) END AS clauses FROM pack""",
    "clause_pack": """SELECT DISTINCT source AS source_id, left(sha256(text), 16) AS clause_ref,
      'clause-' || left(sha256(length(source) || ':' || source || '16:' || left(sha256(text), 16) || '2:p1' || '64:' || sha256(text)), 12) AS chunk_id,
      sha256(text) AS source_text_hash FROM documents""",
    "example_violations": """SELECT CAST(doc_id AS VARCHAR) AS exampleId,
      CASE lang WHEN 'fr' THEN 'exampleBodyLength' ELSE 'exampleBodyHash' END AS violation
      FROM documents WHERE lang IN ('fr', 'de')""",
    "exception_list": _LISTED + " SELECT type, code, severity, CAST(sum(n) AS BIGINT) AS exceptions FROM listed GROUP BY ALL",
    "exception_count": _LISTED + " SELECT CAST(sum(n) AS BIGINT) AS exception_count FROM listed",
    "tmpl_component_rows": """SELECT '19960101' AS base_dt, l_returnflag || l_linestatus AS component_id,
      CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS source_amount
      FROM lineitem WHERE strftime(l_shipdate, '%Y%m') = '199601'""",
    "tmpl_component_results": """SELECT '19960101' AS base_dt, l_returnflag || l_linestatus AS component_id,
      CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS calculated_amount
      FROM lineitem WHERE strftime(l_shipdate, '%Y%m') = '199601' GROUP BY ALL""",
}
