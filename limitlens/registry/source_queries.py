"""Text sources: delimited files, JSON logs, rule files, nested rule sets, manifests, ordered results.

The driver's tables are written as files or lines in the form a source expects, broken rows
included, and read back through that source.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from limitlens.functions import text as X
from limitlens.operators import audit as A, limits as L, manifest as M, priorday as D, profile as P, reconcile as R
from limitlens.operators import rules as U, templates as S, visual as V
from limitlens.registry import limit_queries as LQ, report_queries as RQ, table_queries as TQ, tables as T, text_queries as XQ
from limitlens.session import ensure_checkpoint_dir
from limitlens.sources import catalog as G, logs as J, nested_rules as N, rule_files as F_, tables as C
from limitlens.sources.mapping import ColumnMapping


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/limitlens-{uuid.uuid4().hex}"


def _write_lines(line: Column, header: str, df: DataFrame, **options: str) -> str:
    """Lines as they are, below a header in every file."""
    folder = _folder(df.sparkSession)
    plain = {"header": "true", "quote": "\u0000", "sep": "\u0001", "ignoreLeadingWhiteSpace": "false",
             "ignoreTrailingWhiteSpace": "false", **options}
    df.select(line.alias(header)).write.options(**plain).csv(folder)
    return folder


# --- delimited files -----------------------------------------------------------------------

def _order_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a delimited file: short, long, quoted, blank and plain rows by priority."""
    key, status, priority = F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority")
    line = (
        F.when(priority == "1-URGENT", F.concat_ws(",", key, status))
        .when(priority == "2-HIGH", F.concat_ws(",", key, status, F.lit("long"), F.lit("extra")))
        .when(priority == "3-MEDIUM", F.concat(key, F.lit(","), status, F.lit(',"said ""'), status, F.lit('"", left"')))
        .when(priority == "4-NOT SPECIFIED", F.lit(" ,\t,"))
        .otherwise(F.concat(key, F.lit(", "), status, F.lit(",")))
    )
    return C.read_table(spark, _write_lines(line, "O_KEY,O_STATUS,O_NOTE", T.table(spark, sf_dir, "orders")))


def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_file(spark, sf_dir).select(
        F.col("O_KEY").alias("o_key"), F.col("O_STATUS").alias("o_status"), F.col("O_NOTE").alias("o_note"),
        F.col(C.CORRUPT).isNotNull().alias("ragged"),
    )


def csv_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ragged rows, and the base-date column that the file lacks."""
    return P.profile_warnings(_order_file(spark, sf_dir), "BASE_DT")


def csv_cp949(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in a file of Korean text that is not UTF-8; the scan finds the encoding."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(",고객 "), F.col("c_mktsegment"))
    path = _write_lines(line, "C_KEY,C_LABEL", T.table(spark, sf_dir, "customer"), encoding="MS949")
    return C.read_table(spark, path).select(F.col("C_KEY").alias("c_key"), F.col("C_LABEL").alias("c_label"))


# --- logs ----------------------------------------------------------------------------------

def _task_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as task log lines; those of errors are cut off, those of signups are blank."""
    line = F.concat(
        F.lit('{"taskId":"'), F.col("event_id").cast("string"), F.lit('","taskType":"'), F.col("event_type"),
        F.lit('","createdAt":"2024-01-01T00:00:00Z"}'),
    )
    kind = F.col("event_type")
    value = F.when(kind == "error", F.substring(line, 1, 20)).when(kind == "signup", "\t ").otherwise(line)
    return T.table(spark, sf_dir, "events").select(value.alias("value"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = J.parse_lines(_task_lines(spark, sf_dir), "task")
    return log.select(F.col("taskId").alias("task_id"), F.col("taskType").alias("task_type"), F.col(J.CORRUPT).alias("bad_line"))


def log_line_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.log_findings(J.parse_lines(_task_lines(spark, sf_dir), "task"), "TaskLog")


def log_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended as feedback: records without a task go to the quarantine."""
    events = T.table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("feedbackId"),
        F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type")).alias("taskId"),
        F.lit(None).cast("timestamp").alias("createdAt"),
        X.sha256_hex(F.col("user_id").cast("string")).alias("userId"),
        F.lit("GOOD").alias("feedbackCode"), F.lit("Pending").alias("reviewStatus"),
    )
    good, refused = _folder(spark), _folder(spark)
    J.append_log(events, good, "feedback", quarantine=refused)
    kept = J.read_log(spark, good, "feedback").select(F.col("feedbackId").alias("feedback_id"), F.lit(True).alias("kept"))
    return kept.unionByName(
        J.read_log(spark, refused, "feedback").select(F.col("feedbackId").alias("feedback_id"), F.lit(False).alias("kept"))
    )


def example_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored example lines and back."""
    line = F.to_json(F.struct(
        F.col("doc_id").cast("string").alias("exampleId"), F.col("text").alias("exampleBody"),
        F.length("text").alias("exampleBodyLength"),
    ))
    log = J.parse_lines(T.table(spark, sf_dir, "documents").select(line.alias("value")), "promoted_example")
    return J.records(log).select(
        F.col("exampleId").alias("example_id"), X.sha256_hex("exampleBody").alias("body_hash"),
        F.col("exampleBodyLength").alias("body_length"),
    )


# --- rule files ----------------------------------------------------------------------------

def _rule_file() -> Column:
    size = F.col("p_size")
    return (
        F.when(size < 15, "sql_deny_patterns.txt").when(size < 30, "vba_warn_patterns.txt")
        .when(size < 40, "excel_2021_blocked_functions.txt").otherwise("notes.txt")
    )


def rule_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as lines of rule files: comments, required patterns, a file of another name."""
    name, brand = F.col("p_name"), F.col("p_brand")
    value = (
        F.when(brand == "Brand#1", F.concat(F.lit(" # "), name)).when(brand == "Brand#2", "\t")
        .when(brand == "Brand#3", F.concat(F.lit("Require_Present: "), name)).otherwise(F.concat(name, F.lit("  ")))
    )
    lines = T.table(spark, sf_dir, "part").select(_rule_file().alias("file"), value.alias("value"), F.col("p_partkey").alias("at"))
    return F_.rules_of_lines(lines).select(F.col("group").alias("rule_group"), "rule_no", "pattern")


def rule_file_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version over the first part name of each rule file."""
    part = T.table(spark, sf_dir, "part")
    return F_.version_of(part.groupBy(_rule_file().alias("file")).agg(F.min("p_name").alias("content")))


# --- nested rule sets ----------------------------------------------------------------------

def _rule_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON rule set per part; size and type decide what is wrong with it."""
    size, text = F.col("p_size"), F.lit("text")
    component = F.struct(
        F.lit("C1").alias("ComponentId"), F.when(size.between(11, 15), "").otherwise(F.col("p_name")).alias("Name"),
        F.col("p_type").alias("Category"), text.alias("ValuePolicy"),
    )
    mapped = F.struct(
        F.when(F.col("p_type") == "ECONOMY", "C9").otherwise("C1").alias("ComponentId"), text.alias("SourceName"),
        F.when(size.between(16, 20), " ").otherwise("AMT").alias("ColumnName"), F.lit("decimal").alias("DataType"),
        F.lit(True).alias("Required"),
    )
    approval = F.struct(F.lit("Approved").alias("Status"), F.lit("Lead").alias("ReviewerRole"))
    document = F.to_json(F.struct(
        F.when(size < 6, " ").otherwise(F.col("p_name")).alias("RuleSetId"), F.lit("v1").alias("RuleSetVersion"),
        F.when(size.between(6, 10), "2024-02-30").otherwise("2024-02-28").alias("EffectiveDate"),
        F.array(component).alias("Components"), F.array(mapped).alias("ComponentMap"),
        text.alias("FormulaDescription"), F.array(F.lit("SELECT AMT FROM SOURCE_T WHERE BASE_DT = :BASE_DT")).alias("ValidationSqlTemplates"),
        text.alias("RegulationBasis"),
        F.when(size.between(21, 25), F.array().cast("array<struct<Status:string,ReviewerRole:string>>"))
        .otherwise(F.array(approval)).alias("ApprovalHistory"),
    ))
    content = F.when(size.between(26, 30), F.substring(document, 1, 40)).otherwise(F.concat(F.lit("/* part */ "), document))
    return N.parse_rule_sets(T.table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("file"), content.alias("content")
    ))


def nested_rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the rule sets that can be read."""
    rule_sets = _rule_sets(spark, sf_dir).filter(F.col("_corrupt_record").isNull())
    return N.load_rule_sets(rule_sets, U.default_rule_set(spark)).findings.select("file", "code", "severity", "message")


def nested_rules_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.load_rule_sets(_rule_sets(spark, sf_dir), U.default_rule_set(spark)).usable.select(
        "file", F.col("RuleSetId").alias("rule_set_id"), F.size("Components").alias("components")
    )


def nested_rules_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.unmapped_components(_rule_sets(spark, sf_dir)).select("file", F.col("ComponentId").alias("component_id"))


# --- manifests -----------------------------------------------------------------------------

def _manifest_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: German ones undeclared, French and Spanish ones declared wrongly;
    pages as required files that are absent; benchmark items as entries with an unsafe path."""
    lang, text = F.col("lang"), F.coalesce("text", F.lit(""))
    files = T.table(spark, sf_dir, "documents").select(
        "lang", F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("path"),
        F.octet_length(text).cast("long").alias("actual_size"), X.sha256_hex(text).alias("actual_sha256"),
    )
    declared = files.filter(F.coalesce(lang != "de", F.lit(True))).select(
        "path", F.when(lang == "es", F.col("actual_size") + 1).otherwise(F.col("actual_size")).alias("size"),
        F.when(lang == "fr", "00").otherwise(F.upper("actual_sha256")).alias("sha256"),
        F.lit("Data").alias("class"), F.lit(False).alias("required"),
    )

    def entry(path: Column, df: DataFrame) -> DataFrame:
        return df.select(
            path.alias("path"), F.lit(0).cast("long").alias("size"), F.lit("").alias("sha256"),
            F.lit(" ").alias("class"), F.lit(True).alias("required"),
        )

    pages = entry(F.concat(F.lit("pages/"), F.col("page_id").cast("string")), T.table(spark, sf_dir, "pages"))
    items = entry(F.concat(F.lit("docs/../"), F.col("item_id").cast("string")), T.table(spark, sf_dir, "benchmark"))
    return M.manifest_audit(
        declared.unionByName(pages).unionByName(items), files.drop("lang"), watched=F.startswith("path", F.lit("docs/"))
    )


def manifest_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifest_problems(spark, sf_dir)


def manifest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = M.manifest_result(_manifest_problems(spark, sf_dir))
    return result.withColumn("blocked_classes", F.array_join("blocked_classes", ","))


def corpus_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored files: German ones bear a forbidden name, French ones a forbidden line."""
    docs = T.table(spark, sf_dir, "documents")
    path = F.concat(F.lit("kb/"), F.col("doc_id").cast("string"), F.when(F.col("lang") == "de", "_Full_Text.md").otherwise(".md"))
    text = F.when(F.col("lang") == "fr", F.concat("text", F.lit("\nthe Official TEXT"))).otherwise(F.col("text"))
    lines = docs.select(path.alias("path"), F.explode(F.split(text, "\n")).alias("value"))
    return M.guarded(docs.select(path.alias("path")), lines)


# --- missing columns and orders ------------------------------------------------------------

def missing_exposure_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposures without amounts: one mapping error per date."""
    inputs = L.bind(T.exposures(spark, sf_dir).drop("EXPOSURE_AMT"), T.limits(spark, sf_dir), None, ColumnMapping(), row_no="ROW_NO")
    return L.limit_status(inputs).groupBy("base_dt", "status").agg(F.count("*").alias("n"))


def missing_limit_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits without amounts: every exposure is a mapping error."""
    inputs = L.bind(T.exposures(spark, sf_dir), T.limits(spark, sf_dir).drop("LIMIT_AMT"), None, ColumnMapping(), row_no="ROW_NO")
    return L.limit_status(inputs).groupBy("base_dt", "status").agg(F.count("*").alias("n"))


def exceptions_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = T.limit_inputs(spark, sf_dir)
    found = R.recon_exceptions(inputs, L.limit_status(inputs)).groupBy(
        "base_dt", "check_order", "code", "severity", "portfolio_id", "risk_factor"
    ).agg(F.sum("n").alias("n"), F.min("message").alias("message"))
    return R.ordered_exceptions(found).select("base_dt", "code", "severity", "portfolio_id", "risk_factor", "n")


def _compared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[tuple[str, str]]]:
    status, pairs = L.limit_status(T.limit_inputs(spark, sf_dir)), RQ.month_pairs(spark, sf_dir)
    return status, D.prior_day(status, pairs), pairs


def comparison_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.ordered_comparison(_compared(spark, sf_dir)[1]).select(
        "current_dt", "prior_dt", "portfolio_id", "risk_factor", "movement"
    )


def heatmap_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.ordered_heatmap(V.heatmap(L.limit_status(T.limit_inputs(spark, sf_dir))))
    return T.doubles(rows.withColumnRenamed("_row_no", "row_no"), "usage_ratio", places=10)


def clauses_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = F.substring(X.sha256_hex("text"), 1, 16)
    ordered = G.ordered_clauses(G.load_clause_pack(TQ._pack(spark, sf_dir, ref)).clauses)
    return ordered.select("source_id", "clause_ref", "chunk_id", "source_text_hash")


def clause_pack_without_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pack where rows have no order: exact copies are still kept once."""
    ref = F.substring(X.sha256_hex("text"), 1, 16)
    clauses = G.load_clause_pack(TQ._pack(spark, sf_dir, ref).drop("_row_no")).clauses
    return clauses.select("source_id", "clause_ref", "chunk_id", "source_text_hash")


# --- text helpers --------------------------------------------------------------------------

def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the three tokenizers."""
    return T.table(spark, sf_dir, "documents").select(
        "doc_id", F.size(X.word_tokens("text")).alias("word_tokens"), F.size(X.space_tokens("text")).alias("space_tokens"),
        F.size(X.delimiter_tokens("text")).alias("delimiter_tokens"),
    )


def display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = XQ.part_catalog(spark, sf_dir)
    return catalog.select("source_id", *[X.display_value(c).alias(c) for c in ("version", "effective_date", "license_status")])


QUERIES = {
    f.__name__: f
    for f in (
        csv_rows, csv_warnings, csv_cp949, log_lines, log_line_findings, log_appends, example_lines, rule_lines,
        rule_file_version, nested_rule_findings, nested_rules_usable, nested_rules_unmapped, manifest_problems,
        manifest_status, corpus_guard, missing_exposure_column, missing_limit_column, exceptions_in_order,
        comparison_in_order, heatmap_in_order, clauses_in_order, clause_pack_without_order, document_tokens, display_values,
    )
}

_RULE_FILE = """CASE WHEN p_size < 15 THEN 'sql_deny_patterns.txt' WHEN p_size < 30 THEN 'vba_warn_patterns.txt'
  WHEN p_size < 40 THEN 'excel_2021_blocked_functions.txt' ELSE 'notes.txt' END"""
_TASK_LINES = """lines AS (SELECT event_id, event_type,
  '{"taskId":"' || event_id || '","taskType":"' || event_type || '","createdAt":"2024-01-01T00:00:00Z"}' AS line FROM events)"""
_PROBLEMS = """problems AS (
  SELECT CASE lang WHEN 'de' THEN 'FILE_UNDECLARED' WHEN 'fr' THEN 'HASH_MISMATCH' ELSE 'SIZE_MISMATCH' END AS problem,
    'docs/' || doc_id AS path, CASE lang WHEN 'de' THEN 'App' ELSE 'Data' END AS class FROM documents WHERE lang IN ('de', 'fr', 'es')
  UNION ALL SELECT 'FILE_MISSING', 'pages/' || page_id, 'App' FROM pages
  UNION ALL SELECT 'PATH_UNSAFE', 'docs/../' || item_id, 'App' FROM benchmark)"""
_SET_PROBLEMS = """SELECT CAST(p_partkey AS VARCHAR) AS file, code, 'Medium' AS severity, message FROM part JOIN (VALUES
    (0, 5, 'NCR_RULESET_REQUIRED_FIELD_MISSING', 'RuleSetId'), (6, 10, 'NCR_RULESET_EFFECTIVE_DATE_INVALID', ''),
    (11, 15, 'NCR_COMPONENT_INCOMPLETE', 'C1'), (16, 20, 'NCR_COMPONENT_MAP_INCOMPLETE', NULL),
    (21, 25, 'NCR_RULESET_REQUIRED_FIELD_MISSING', 'ApprovalHistory')) v(low, high, code, m) ON p_size BETWEEN low AND high,
  LATERAL (SELECT coalesce(m, CASE p_type WHEN 'ECONOMY' THEN 'C9' ELSE 'C1' END) AS message)"""

SQL = {
    "csv_rows": """SELECT CAST(o_orderkey AS VARCHAR) AS o_key,
      CASE o_orderpriority WHEN '5-LOW' THEN ' ' ELSE '' END || o_orderstatus AS o_status,
      CASE o_orderpriority WHEN '2-HIGH' THEN 'long' WHEN '3-MEDIUM' THEN 'said "' || o_orderstatus || '", left' ELSE '' END AS o_note,
      o_orderpriority IN ('1-URGENT', '2-HIGH') AS ragged FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'""",
    "csv_warnings": """SELECT 'RAGGED_ROWS' AS code, count(*) AS rows FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
      UNION ALL SELECT 'BASE_DATE_COLUMN_MISSING', 0""",
    "csv_cp949": "SELECT CAST(c_custkey AS VARCHAR) AS c_key, '고객 ' || c_mktsegment AS c_label FROM customer",
    "log_lines": f"""WITH {_TASK_LINES} SELECT CASE event_type WHEN 'error' THEN NULL ELSE CAST(event_id AS VARCHAR) END AS task_id,
      CASE event_type WHEN 'error' THEN NULL ELSE event_type END AS task_type,
      CASE event_type WHEN 'error' THEN left(line, 20) END AS bad_line FROM lines WHERE event_type <> 'signup'""",
    "log_line_findings": """SELECT 'TaskLog' AS source, 'AUDIT_LOG_LINE_INVALID' AS code, 'Low' AS severity, count(*) AS bad_lines
      FROM events WHERE event_type = 'error' HAVING count(*) > 0""",
    "log_appends": "SELECT CAST(event_id AS VARCHAR) AS feedback_id, event_type <> 'error' AS kept FROM events",
    "example_lines": """SELECT CAST(doc_id AS VARCHAR) AS example_id, sha256(text) AS body_hash,
      CAST(length(text) AS INTEGER) AS body_length FROM documents""",
    "rule_lines": f"""SELECT CASE WHEN p_brand = 'Brand#3' AND p_size BETWEEN 15 AND 29 THEN '{U.MACRO_REQUIRED}'
        WHEN p_size < 15 THEN '{U.SQL_DENY}' WHEN p_size < 30 THEN '{U.MACRO_WARN}' ELSE '{U.BLOCKED_FUNCTION}' END AS rule_group,
      p_partkey AS rule_no, CASE WHEN p_brand = 'Brand#3' AND p_size NOT BETWEEN 15 AND 29 THEN 'Require_Present: ' || trim(p_name)
        ELSE trim(p_name) END AS pattern
      FROM part WHERE p_size < 40 AND p_brand NOT IN ('Brand#1', 'Brand#2')""",
    "rule_file_version": f"""WITH c AS (SELECT {_RULE_FILE} AS file, min(p_name) AS content FROM part GROUP BY ALL),
      f(file) AS (VALUES {', '.join(f"('{name}')" for name in U.RULE_FILES)})
      SELECT 'ruleset-' || left(sha256(string_agg(file || chr(10) || coalesce(content, '') || chr(10), '' ORDER BY upper(file))), 12)
        AS rule_version FROM f LEFT JOIN c USING (file)""",
    "nested_rule_findings": _SET_PROBLEMS,
    "nested_rules_usable": """SELECT CAST(p_partkey AS VARCHAR) AS file, p_name AS rule_set_id, 1 AS components
      FROM part WHERE p_size > 30""",
    "nested_rules_unmapped": """SELECT CAST(p_partkey AS VARCHAR) AS file, 'C9' AS component_id FROM part
      WHERE p_type = 'ECONOMY' AND p_size NOT BETWEEN 26 AND 30""",
    "manifest_problems": f"WITH {_PROBLEMS} SELECT * FROM problems",
    "manifest_status": f"""WITH {_PROBLEMS} SELECT CASE count(*) WHEN 0 THEN 'OK' ELSE 'FAIL_CLOSED' END AS status,
      count(*) AS problem_count, string_agg(DISTINCT class, ',' ORDER BY class) AS blocked_classes FROM problems""",
    "corpus_guard": "SELECT 'KB_FORBIDDEN_SOURCE_TEXT' AS code, 'Blocker' AS severity, "
      "'kb/' || doc_id || CASE lang WHEN 'de' THEN '_Full_Text.md' ELSE '.md' END AS path FROM documents "
      "WHERE lang IN ('de', 'fr') AND text IS NOT NULL OR lang = 'de'"
      + "".join(f" OR contains(upper(text), '{t.upper()}')" for t in M.CONTENT_TOKENS),
    "missing_exposure_column": f"""WITH {T.EXPOSURES_SQL},{T.LIMITS_SQL} SELECT base_dt, 'MAPPING_ERROR' AS status, CAST(1 AS BIGINT) AS n
      FROM (SELECT base_dt FROM exposures UNION SELECT base_dt FROM limits)""",
    "missing_limit_column": f"""WITH {T.EXPOSURES_SQL} SELECT base_dt, 'MAPPING_ERROR' AS status, count(*) AS n
      FROM exposures GROUP BY base_dt""",
    "exceptions_in_order": LQ.SQL["recon_exceptions"],
    "comparison_in_order": f"SELECT current_dt, prior_dt, portfolio_id, risk_factor, movement FROM ({RQ.SQL['prior_day']})",
    "heatmap_in_order": RQ.SQL["heatmap"],
    "clauses_in_order": TQ.SQL["clause_pack"],
    "clause_pack_without_order": TQ.SQL["clause_pack"],
    "document_tokens": r"""SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{Nd}_]+')) AS word_tokens,
      len(list_filter(string_split(text, ' '), lambda t: regexp_matches(t, '\S'))) AS space_tokens,
      len(list_distinct(list_transform(list_filter(string_split_regex(text, '[ \t\r\n,.;:/\\|()\[\]]+'), lambda t: t <> ''),
        lambda t: upper(replace(t, 'ß', 'ss'))))) AS delimiter_tokens FROM documents""",
    "display_values": f"""WITH {XQ.PART_CATALOG_SQL}, v AS (SELECT source_id, version, effective_date, license_status FROM cat)
      SELECT source_id, CASE version WHEN 'CONFIRM_VERSION' THEN '(needs confirmation)' ELSE version END AS version,
        CASE effective_date WHEN 'not_loaded' THEN '(needs confirmation)' ELSE effective_date END AS effective_date,
        CASE license_status WHEN '' THEN '(missing)' ELSE license_status END AS license_status FROM v""",
}
