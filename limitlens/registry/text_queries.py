"""Search, rule scans, feedback and audit queries over the driver's text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from limitlens.functions.text import sha256_hex
from limitlens.operators import audit as A, feedback as B, rules as R, scan as C, search as K
from limitlens.registry import tables as T

# --- catalog: the part table ---------------------------------------------------------------


def part_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as catalog entries; brands decide status, sizes the metadata."""
    part = T.table(spark, sf_dir, "part")
    size = F.col("p_size")
    return part.select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("source_id"),
        F.col("p_brand").alias("category"), F.col("p_name").alias("title"),
        F.lit("Maker").alias("source_org"), F.col("p_type").alias("source_type"),
        F.when(size < 15, "CATALOG_ONLY").when(size < 25, "public_approved")
        .when(size < 35, "MANUAL_APPROVAL_REQUIRED").when(size < 45, "PROD_ONLY")
        .otherwise("DRAFT").alias("status"),
        F.concat(F.lit("size "), size.cast("string")).alias("note"),
        F.lit("parts").alias("source"),
        F.when(size == 20, "CONFIRM_VERSION").otherwise("v1").alias("version"),
        F.when(size == 10, "not_loaded").otherwise("2024-01-01").alias("effective_date"),
        F.lit("").alias("repeal_date"),
        F.lit("2024-02-01").alias("loaded_date"),
        F.when(size == 12, "").otherwise("OK").alias("approval_status"),
        F.when(size == 30, "").otherwise("PUBLIC").alias("license_status"),
        F.col("p_partkey").alias("row_no"),
    )


PART_CATALOG_SQL = """
cat AS (SELECT 'P' || p_partkey AS source_id, p_brand AS category, p_name AS title, 'Maker' AS source_org,
    p_type AS source_type,
    CASE WHEN p_size < 15 THEN 'CATALOG_ONLY' WHEN p_size < 25 THEN 'public_approved'
      WHEN p_size < 35 THEN 'MANUAL_APPROVAL_REQUIRED' WHEN p_size < 45 THEN 'PROD_ONLY' ELSE 'DRAFT' END AS status,
    'size ' || p_size AS note,
    CASE WHEN p_size = 20 THEN 'CONFIRM_VERSION' ELSE 'v1' END AS version,
    CASE WHEN p_size = 10 THEN 'not_loaded' ELSE '2024-01-01' END AS effective_date, '' AS repeal_date,
    '2024-02-01' AS loaded_date, CASE WHEN p_size = 12 THEN '' ELSE 'OK' END AS approval_status,
    CASE WHEN p_size = 30 THEN '' ELSE 'PUBLIC' END AS license_status FROM part)"""

CATALOG_QUERIES = [("q1", "brand"), ("q2", "P19"), ("q3", "size 3"), ("q4", "small part 12"), ("q5", "draft"), ("q6", "zzz")]


def _catalog_hits(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    entries = K.catalog_entries(part_catalog(spark, sf_dir), "row_no")
    return K.catalog_search(entries, CATALOG_QUERIES, 5, **options)


_CATALOG_OUT = ("query_id", "score", "source_id", "status", "disclosure", "snippet_allowed", "rank")


def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog_hits(spark, sf_dir).select(*_CATALOG_OUT)


def catalog_search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same results with the n-gram postings narrowing the entries."""
    entries = K.catalog_entries(part_catalog(spark, sf_dir), "row_no")
    postings = K.ngram_postings(entries)
    return K.catalog_search(entries, CATALOG_QUERIES, 5, postings=postings).select(*_CATALOG_OUT)


def catalog_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disclosure findings of every entry, counted."""
    graded = K.with_disclosure(K.catalog_entries(part_catalog(spark, sf_dir), "row_no"))
    return graded.select(F.explode("findings").alias("f")).groupBy(
        F.col("f.code").alias("code"), F.col("f.severity").alias("severity")
    ).agg(F.count("*").alias("entries"))


def citation_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = K.catalog_entries(part_catalog(spark, sf_dir), "row_no")
    return K.citation_warnings(entries, ("source_id",))


def index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = K.catalog_entries(part_catalog(spark, sf_dir), "row_no")
    return K.index_statistics(K.ngram_postings(entries))


def _score_sql(query: str, terms: list[str], weights: dict[str, int], term_weights: dict[str, int]) -> str:
    def hit(field: str, text: str, weight: int) -> str:
        return f"CASE WHEN contains(upper({field}), '{text.upper()}') THEN {weight} ELSE 0 END"

    parts = [hit(f, query, w) for f, w in weights.items()]
    parts += [hit(f, t, w) for t in terms if len(t) >= 2 for f, w in term_weights.items()]
    return " + ".join(parts)


def _catalog_scores() -> str:
    return " UNION ALL ".join(
        f"SELECT '{i}' AS query_id, {_score_sql(q, q.split(' '), K.CATALOG_WEIGHTS, K.CATALOG_TERM_WEIGHTS)} AS score, * FROM cat"
        for i, q in CATALOG_QUERIES
    )


def _missing_sql(field: str) -> str:
    return f"(trim({field}) = '' OR upper({field}) = 'NOT_LOADED' OR upper({field}) LIKE 'CONFIRM\\_%' ESCAPE '\\')"


_PUBLIC = "upper(status) IN ('CATALOG_ONLY','PUBLIC_APPROVED','APPROVED_PUBLIC')"
_DISCLOSURE = f"""CASE WHEN {_PUBLIC} THEN 'PublicCited' WHEN upper(status) = 'MANUAL_APPROVAL_REQUIRED'
  THEN 'ApprovalRequired' ELSE 'MetadataOnly' END"""
_ALLOWED = " AND ".join(
    [_PUBLIC, *[f"NOT {_missing_sql(f)}" for f in ("version", "effective_date", "approval_status", "license_status")]]
)
_CATALOG_SEARCH = f"""WITH {PART_CATALOG_SQL}, s AS ({_catalog_scores()})
  SELECT query_id, score, source_id, status, {_DISCLOSURE} AS disclosure, ({_ALLOWED}) AS snippet_allowed, rank
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id) AS rank
        FROM s WHERE score > 0) WHERE rank <= 5"""

# --- clauses: the documents ----------------------------------------------------------------

AS_OF = "2023-06-30"
CLAUSE_QUERIES = [
    ("license", "license"), ("the", "the of"), ("ref", "doc-1"), ("fr", "les queaux"),
    ("long", "licensed under the apache license, version 2.0"),
]


def document_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as clauses. Spanish ones carry an unusable effective date, French ones end."""
    docs = T.table(spark, sf_dir, "documents")
    start = F.date_add(F.lit("2020-01-01").cast("date"), F.col("n_chars").cast("int"))
    end = F.date_format(F.date_add(start, 400), "yyyy-MM-dd")
    return docs.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("chunk_id"),
        F.upper("source").alias("source_id"),
        F.concat(F.lit("Doc-"), F.col("doc_id").cast("string"), F.lit(" "), F.col("lang")).alias("clause_ref"),
        F.col("text").alias("clause_text"),
        F.when(F.col("lang") == "es", F.date_format(start, "yyyy/MM/dd"))
        .otherwise(F.date_format(start, "yyyy-MM-dd")).alias("effective_date"),
        F.when(F.col("lang") == "fr", end).when(F.col("lang") == "de", F.lit(" ")).otherwise("").alias("repeal_date"),
        F.lit("pack-1").alias("pack_version"),
        "doc_id",
    )


def source_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One catalog entry per document source; sources of many long documents need approval."""
    sources = T.table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count("*").alias("docs"), F.max("n_chars").alias("longest"), F.min("doc_id").alias("row_no")
    ).filter("source <> 'src13'")
    return sources.select(
        F.col("source").alias("source_id"), F.lit("WEB").alias("category"),
        F.concat(F.lit("Source "), F.col("source")).alias("title"), F.lit("Crawler").alias("source_org"),
        F.lit("Web").alias("source_type"),
        F.when(F.col("source").endswith("7"), "PROD_ONLY").when(F.col("source").endswith("5"), "MANUAL_APPROVAL_REQUIRED")
        .otherwise("CATALOG_ONLY").alias("status"),
        F.lit("crawl").alias("note"), F.col("source").alias("source"),
        F.when(F.col("source").endswith("3"), "CONFIRM_CURRENT_VERSION").otherwise("v1").alias("version"),
        F.lit("2020-01-01").alias("effective_date"), F.lit("").alias("repeal_date"),
        F.lit("OK").alias("approval_status"), F.lit("PUBLIC").alias("license_status"), "row_no",
    )


def clause_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = K.clause_search(
        document_clauses(spark, sf_dir), K.catalog_entries(source_catalog(spark, sf_dir), "row_no"),
        CLAUSE_QUERIES, AS_OF, 5,
    )
    return hits.select(
        "query_id", "rank", "score", "chunk_id", "source_id", "clause_ref", "document_name", "version",
        "catalog_found", "disclosure", "snippet_allowed", "snippet",
    )


def active_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses valid on the search date."""
    clauses = document_clauses(spark, sf_dir)
    day, _ = K.search_date(AS_OF)
    return clauses.filter(K.active_on(day)).select("chunk_id", "effective_date", "repeal_date")


def clause_date_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.date_warnings(document_clauses(spark, sf_dir)).select("chunk_id", "source_id", "field")


def clause_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-addressed clause ids of all documents."""
    clauses = document_clauses(spark, sf_dir).drop("chunk_id")
    return K.clause_ids(clauses).select("doc_id", "chunk_id", "source_text_hash")


_CLAUSES_SQL = """
cl AS (SELECT *, 'doc-' || doc_id AS chunk_id, upper(source) AS source_id, 'Doc-' || doc_id || ' ' || lang AS clause_ref,
    text AS clause_text, CAST(DATE '2020-01-01' + CAST(n_chars AS INTEGER) AS DATE) AS eff FROM documents),
clauses AS (SELECT *,
    CASE WHEN lang = 'es' THEN strftime(eff, '%Y/%m/%d') ELSE strftime(eff, '%Y-%m-%d') END AS effective_date,
    CASE lang WHEN 'fr' THEN strftime(eff + 400, '%Y-%m-%d') WHEN 'de' THEN ' ' ELSE '' END AS repeal_date FROM cl),
active AS (SELECT * FROM clauses WHERE lang <> 'es' AND eff <= DATE '2023-06-30'
    AND (lang <> 'fr' OR DATE '2023-06-30' < CAST(eff + 400 AS DATE))),
src AS (SELECT source, CASE WHEN source LIKE '%7' THEN 'PROD_ONLY' WHEN source LIKE '%5' THEN 'MANUAL_APPROVAL_REQUIRED'
    ELSE 'CATALOG_ONLY' END AS status, CASE WHEN source LIKE '%3' THEN 'CONFIRM_CURRENT_VERSION' ELSE 'v1' END AS version
  FROM (SELECT DISTINCT source FROM documents WHERE source <> 'src13'))"""


def _clause_scores() -> str:
    parts = []
    for i, q in CLAUSE_QUERIES:
        terms = K.query_word_terms(q)
        score = _score_sql(q, terms, K.CLAUSE_WEIGHTS, K.CLAUSE_TERM_WEIGHTS)
        whole = q.upper()
        guard = f"contains(upper(clause_text), '{whole}') OR contains(upper(clause_ref), '{whole}')" if len(q) > 32 else "TRUE"
        norm = "trim(regexp_replace(clause_text, '[\\x00-\\x1f\\x7f-\\x9f\\s\\p{Z}]+', ' ', 'g'))"
        hits = ", ".join(f"nullif(instr(upper({norm}), '{t.upper()}'), 0)" for t in terms)
        parts.append(
            f"SELECT '{i}' AS query_id, CASE WHEN {guard} THEN {score} ELSE 0 END AS score, "
            f"substr({norm}, coalesce(list_min([{hits}]), 1), 32) AS snip, * FROM active"
        )
    return " UNION ALL ".join(parts)


_CLAUSE_SEARCH = f"""WITH {_CLAUSES_SQL}, s AS ({_clause_scores()}),
  top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
          FROM s WHERE score > 0) WHERE rank <= 5)
  SELECT query_id, rank, score, chunk_id, source_id, clause_ref,
    CASE WHEN c.source IS NULL THEN '' ELSE 'Source ' || c.source END AS document_name, coalesce(version, '') AS version,
    c.source IS NOT NULL AS catalog_found,
    CASE status WHEN 'CATALOG_ONLY' THEN 'PublicCited' WHEN 'MANUAL_APPROVAL_REQUIRED' THEN 'ApprovalRequired' ELSE 'MetadataOnly' END AS disclosure,
    coalesce(status = 'CATALOG_ONLY' AND version = 'v1', FALSE) AS snippet_allowed,
    CASE WHEN status = 'CATALOG_ONLY' AND version = 'v1' THEN snip ELSE '' END AS snippet
  FROM top LEFT JOIN src c ON upper(c.source) = top.source_id"""

# --- rule scans ----------------------------------------------------------------------------

# Rules given as data: they hit the driver's texts, which hold no SQL.
TEXT_RULES = (
    R.Rule("text", "EMAIL", r"[a-z0-9._]+@[a-z0-9.]+\.[a-z]{2,}", "Blocker", needs="@"),
    R.Rule("text", "LICENSE_LINE", r"license", "Medium"),
    R.Rule("text", "PHONE", r"[0-9]{3}-[0-9]{3}-[0-9]{4}", "High", needs="-"),
    R.Rule("text", "KEY_TOKEN", r"(api[_-]?key|secret|password)", "High"),
)

CONVERSATION_RULES = TEXT_RULES + (
    R.Rule("text", "NUMBER", r"[0-9]+", "Low"),
    R.Rule("text", "REPEATED_FILLER", r"the\s+(of|the)\s", "Low"),
    R.Rule("text", "OPENING", r"^(is|the|la|le|der|el)\s", "Low"),
)


def text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First match of each rule in every document."""
    scanned = C.scan(T.table(spark, sf_dir, "documents"), "text", TEXT_RULES)
    return C.finding_rows(scanned, ["doc_id"]).select("doc_id", "code", "severity", "matched", "position")


def text_scan_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = C.scan(T.table(spark, sf_dir, "conversations"), "text", CONVERSATION_RULES)
    return C.finding_rows(scanned, ["conv_id", "turn"]).select("conv_id", "turn", "code", "severity", "position")


def safety_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = C.scan(T.table(spark, sf_dir, "documents"), "text", TEXT_RULES)
    return C.safety_result(scanned, ["doc_id"])


def _default_scan(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rules = R.default_rule_set(spark)
        finders = {
            "sql": lambda t: C.sql_findings(t, rules), "macro": lambda t: C.macro_findings(t, rules),
            "formula": lambda t: C.formula_findings(t, rules), "forbidden": C.forbidden_findings,
        }
        docs = T.table(spark, sf_dir, "documents").unionByName(rule_documents(spark, sf_dir))
        scanned = C.with_findings(docs, finders[kind](F.col("text")))
        rows = C.finding_rows(scanned, ["doc_id"])
        return rows.select("doc_id", "code", "severity", "position")

    run.__name__ = f"scan_{kind}"
    run.__doc__ = f"The {kind} rules over documents and order statements."
    return run


# Statements written from the orders, so that each default rule group has something to find.
_STATEMENTS = (
    ("1-URGENT", "select * from orders where o_orderkey = "),
    ("2-HIGH", "Sub Run()\nApplication.DisplayAlerts = False\nKill \"f\" & "),
    ("3-MEDIUM", "=TEXTSPLIT(A1, \",\") + FILTER (B:B) + take (A1, 2) + "),
    ("4-NOT SPECIFIED", "drop table REAL_TABLE_NAME; call p; number 800101-1234567, "),
    ("5-LOW", "Option Explicit\nSet x = CreateObject(\"WinHttp\") ' select "),
)


def rule_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = T.table(spark, sf_dir, "orders")
    text = F.lit("")
    for priority, statement in _STATEMENTS:
        text = F.when(F.col("o_orderpriority") == priority, F.lit(statement)).otherwise(text)
    return orders.select(
        (-F.col("o_orderkey") - 1).alias("doc_id"),
        F.concat(text, F.col("o_orderkey").cast("string")).alias("text"),
        F.lit("sql").alias("lang"), F.lit("orders").alias("source"), F.lit(0).cast("long").alias("n_chars"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_DOCS_SQL = f"""docs AS (SELECT doc_id, text FROM documents UNION ALL
  SELECT -o_orderkey - 1, (CASE o_orderpriority {' '.join(f"WHEN '{p}' THEN {_quoted(s)}" for p, s in _STATEMENTS)} ELSE '' END) || o_orderkey
  FROM orders)"""


def _position(pattern: str, text: str = "text") -> str:
    """0-based position of the first match, for patterns RE2 and Java read alike."""
    return f"CAST(length(regexp_extract({text}, '(?is)^(.*?)(?:{pattern})', 1)) AS INTEGER)"


def _word(word: str) -> tuple[str, str]:
    """Condition and position of a whole word with Unicode word boundaries."""
    bounded = rf"(^|[^\p{{L}}\p{{N}}_]){word}([^\p{{L}}\p{{N}}_]|$)"
    lead = rf"(?is)^((?:.*?[^\p{{L}}\p{{N}}_])??){word}(?:[^\p{{L}}\p{{N}}_]|$)"
    return f"regexp_matches(text, '(?is){bounded}')", f"CAST(length(regexp_extract(text, '{lead}', 1)) AS INTEGER)"


def _rule_sql(code: str, severity: str, condition: str, position: str) -> str:
    return f"SELECT doc_id, '{code}' AS code, '{severity}' AS severity, {position} AS position FROM docs WHERE {condition}"


def _plain_rule(code: str, severity: str, pattern: str) -> str:
    return _rule_sql(code, severity, f"regexp_matches(text, '(?is){pattern}')", _position(pattern))


def _sql_scan() -> str:
    rules = [_rule_sql(code, "Blocker", *_word(word)) for word, code in R.SQL_DENY_CODES]
    rules += [
        _plain_rule("SQL_SELECT_STAR", "Medium", r"SELECT\s+\*"),
        _plain_rule("SQL_WHERE_ALWAYS_TRUE", "Medium", r"WHERE\s+1\s*=\s*1"),
        _plain_rule("SQL_CROSS_JOIN", "Medium", r"CROSS\s+JOIN"),
        _plain_rule("SQL_OPTIMIZER_HINT", "Medium", r"/\*\+"),
        _rule_sql("SQL_NO_SELECT", "Medium", f"NOT {_word('SELECT')[0]}", "NULL"),
    ]
    return f"WITH {_DOCS_SQL} " + " UNION ALL ".join(rules)


def _macro_scan() -> str:
    rules = [
        _rule_sql("VBA_SHELL", "Blocker", *_word("Shell")),
        _plain_rule("VBA_WSCRIPT", "Blocker", r"WScript\.Shell"),
        _rule_sql("VBA_KILL", "Blocker", *_word("Kill")),
        _plain_rule("VBA_WINAPI", "High", r"Declare\s+PtrSafe"),
        _plain_rule("VBA_FSO", "High", r"Scripting\.FileSystemObject|FileSystemObject"),
        _plain_rule("VBA_FOLLOW_HYPERLINK", "Blocker", "FollowHyperlink"),
        _plain_rule("VBA_HTTP", "Blocker", "WinHttp"),
        _plain_rule("VBA_HTTP", "Blocker", r"MSXML2\.XMLHTTP"),
        _plain_rule("VBA_OUTLOOK", "High", r"Outlook\.Application"),
        _plain_rule("VBA_DISPLAY_ALERTS_DISABLED", "Medium", r"Application\.DisplayAlerts\s*=\s*False"),
        _plain_rule("VBA_ENABLE_EVENTS_DISABLED", "Medium", r"Application\.EnableEvents\s*=\s*False"),
        _rule_sql("VBA_OPTION_EXPLICIT_MISSING", "Medium", r"NOT regexp_matches(text, '(?is)Option\s+Explicit')", "NULL"),
    ]
    return f"WITH {_DOCS_SQL} " + " UNION ALL ".join(rules)


def _formula_scan() -> str:
    rules = []
    for name in R.DEFAULT_BLOCKED_FUNCTIONS:
        condition = rf"regexp_matches(text, '(?is)(^|[^\p{{L}}\p{{N}}_]){name}\s*\(')"
        position = rf"CAST(length(regexp_extract(text, '(?is)^((?:.*?[^\p{{L}}\p{{N}}_])??){name}\s*\(', 1)) AS INTEGER)"
        rules.append(_rule_sql("EXCEL_365_FUNCTION", "High", condition, position))
    return f"WITH {_DOCS_SQL} " + " UNION ALL ".join(rules)


def _forbidden_scan() -> str:
    rules = [
        _rule_sql("FEEDBACK_FORBIDDEN_TERM", "Blocker", f"contains(upper(text), '{t}')", f"CAST(instr(upper(text), '{t}') - 1 AS INTEGER)")
        for t in C.FORBIDDEN_TERMS
    ]
    number = r"[0-9]{6}-[1-4][0-9]{6}"
    rules.append(_rule_sql(
        "FEEDBACK_PII_PATTERN", "Blocker", f"regexp_matches(text, '(^|[^0-9]){number}([^0-9]|$)')",
        f"CAST(length(regexp_extract(text, '(?s)^((?:.*?[^0-9])??){number}(?:[^0-9]|$)', 1)) AS INTEGER)",
    ))
    return f"WITH {_DOCS_SQL} " + " UNION ALL ".join(rules)


def text_scan_sql(table: str, ids: str, matched: bool, rules=TEXT_RULES) -> str:
    parts = []
    for rule in rules:
        found = f", regexp_extract(text, '(?is){rule.pattern}') AS matched" if matched else ""
        parts.append(
            f"SELECT {ids}, '{rule.code}' AS code, '{rule.severity}' AS severity{found}, {_position(rule.pattern)} AS position "
            f"FROM {table} WHERE regexp_matches(text, '(?is){rule.pattern}')"
        )
    return " UNION ALL ".join(parts)


# --- feedback ------------------------------------------------------------------------------

PROMOTED_AT = "2024-03-01 00:00:00"


def label_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as feedback, twice: the second copy is a duplicate. Toxic rows lack a hashed user."""
    labels = T.table(spark, sf_dir, "labels")
    return labels.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("feedbackId"),
        F.lit("t1").alias("taskId"),
        F.when(F.col("toxic") == 1, "plain-user").otherwise(sha256_hex(F.col("doc_id").cast("string"))).alias("userId"),
        F.when(F.col("quality") == 1, "approved").otherwise("REJECTED").alias("feedbackCode"),
        F.lit("Pending").alias("reviewStatus"),
        (F.col("doc_id") * 2 + F.col("copy")).alias("_row_no"),
    )


def document_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as draft bodies; English ones declare no kind."""
    docs = T.table(spark, sf_dir, "documents")
    return docs.select(
        F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("feedbackId"),
        F.lit("t1").alias("taskId"), F.col("text").alias("draftBody"),
        F.when(F.col("lang") == "en", "").otherwise("Text").alias("kind"),
        F.col("doc_id").alias("_row_no"),
    )


# E-mail addresses block a body here; the default keyword rules hit nothing in the documents.
def promotion_rules(spark: SparkSession) -> R.RuleSet:
    base = R.default_rule_set(spark)
    return R.RuleSet(base.rules + (R.Rule(R.SQL_DENY, "EMAIL", TEXT_RULES[0].pattern, "Blocker", needs="@"),))


def _promotion(spark: SparkSession, sf_dir: str) -> B.Promotion:
    return B.promote_approved(
        label_feedback(spark, sf_dir), document_bodies(spark, sf_dir), promotion_rules(spark), F.lit(PROMOTED_AT)
    )


def promote_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _promotion(spark, sf_dir).promoted.select(
        "exampleId", "feedbackId", "taskId", "userIdHash", "feedbackCode", "reviewStatus", "promotionMode",
        "exampleBodyKind", "exampleBodyLength", "exampleBodyHash",
    )


def promote_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _promotion(spark, sf_dir).skipped.groupBy("feedbackId", "taskId", "reason").agg(F.count("*").alias("entries"))


def promote_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _promotion(spark, sf_dir).warnings.select(
        "warning", "feedbackId", "taskId", F.array_join("codes", ",").alias("codes")
    )


EXAMPLE_QUERIES = [("e1", "license"), ("e2", "f12 approved"), ("e3", "exampleCuration"), ("e4", "the (of), the")]


def example_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = K.example_search(_promotion(spark, sf_dir).promoted, EXAMPLE_QUERIES, 5)
    return hits.select("query_id", "rank", "score", "exampleId", "feedbackId")


_FEEDBACK_SQL = f"""
feedback AS (SELECT 'f' || doc_id AS fid, doc_id, CASE WHEN toxic = 1 THEN 'plain-user' ELSE sha256(CAST(doc_id AS VARCHAR)) END AS uid,
    quality, toxic FROM labels),
ok AS (SELECT * FROM feedback WHERE toxic <> 1 AND quality = 1),
sqlbody AS (SELECT ok.*, d.text, d.lang,
    CASE WHEN d.text IS NULL OR trim(d.text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'NONE'
      WHEN d.lang <> 'en' THEN 'General'
      WHEN regexp_matches(d.text, '(?is)(^|[^\\p{{L}}\\p{{Nd}}_])(SELECT|WITH|INSERT|UPDATE|DELETE|DROP|MERGE)([^\\p{{L}}\\p{{Nd}}_]|$)') THEN 'Sql'
      WHEN contains(upper(d.text), 'OPTION EXPLICIT') OR contains(upper(d.text), 'SUB ') OR contains(upper(d.text), 'FUNCTION ')
        OR contains(upper(d.text), 'END SUB') OR contains(upper(d.text), 'END FUNCTION') THEN 'Vba'
      ELSE 'UNCERTAIN' END AS kind FROM ok LEFT JOIN documents d USING (doc_id)),
blocked AS (SELECT doc_id, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM (
    {' UNION ALL '.join(
        [f"SELECT doc_id, '{code}' AS code FROM sqlbody WHERE {_word(word)[0]}" for word, code in R.SQL_DENY_CODES]
        + [f"SELECT doc_id, 'EMAIL' FROM sqlbody WHERE regexp_matches(text, '(?is){TEXT_RULES[0].pattern}')"]
        + [f"SELECT doc_id, '{code}' FROM sqlbody WHERE {_word(word)[0]}" for word, code in (('Shell', 'VBA_SHELL'), ('Kill', 'VBA_KILL'))]
        + ["SELECT doc_id, 'FEEDBACK_PII_PATTERN' FROM sqlbody WHERE regexp_matches(text, '(^|[^0-9])[0-9]{6}-[1-4][0-9]{6}([^0-9]|$)')"]
    )}) GROUP BY doc_id),
gated AS (SELECT s.*, b.codes, CASE WHEN kind = 'NONE' THEN 'NONE' WHEN kind = 'UNCERTAIN' THEN 'UNCERTAIN'
    WHEN b.codes IS NOT NULL THEN 'BLOCKED' ELSE 'STORED' END AS state FROM sqlbody s LEFT JOIN blocked b USING (doc_id)),
promoted AS (SELECT 'example-' || left(sha256(fid || '|t1'), 12) AS exampleId, fid AS feedbackId, 't1' AS taskId, uid AS userIdHash,
    'approved' AS feedbackCode, 'Pending' AS reviewStatus, 'ExampleCurationOnly' AS promotionMode,
    CASE WHEN state = 'STORED' THEN text END AS exampleBody,
    CASE WHEN state = 'STORED' THEN kind ELSE 'None' END AS exampleBodyKind,
    CAST(CASE WHEN state = 'STORED' THEN length(text) ELSE 0 END AS INTEGER) AS exampleBodyLength,
    CASE WHEN state = 'STORED' THEN sha256(text) END AS exampleBodyHash FROM gated)"""


def _example_scores() -> str:
    fields = {f: f"coalesce({f}, '')" for f in K.EXAMPLE_WEIGHTS}
    weights = {fields[f]: w for f, w in K.EXAMPLE_WEIGHTS.items()}
    terms = {fields[f]: w for f, w in K.EXAMPLE_TERM_WEIGHTS.items()}
    return " UNION ALL ".join(
        f"SELECT '{i}' AS query_id, {_score_sql(q, K.query_delimiter_terms(q), weights, terms)} AS score, * FROM promoted"
        for i, q in EXAMPLE_QUERIES
    )


# --- audit ---------------------------------------------------------------------------------


def event_logs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Purchases and sign-ups are task records, all other events feedback records."""
    events = T.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    user = sha256_hex(F.col("user_id").cast("string"))
    is_task = F.col("event_type").isin("purchase", "signup")
    tasks = events.filter(is_task).select(
        F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("taskId"), F.col("ts").alias("createdAt"),
        user.alias("userId"), F.col("event_type").alias("taskType"), F.lit("Events").alias("toolType"),
        sha256_hex("props").alias("requestHash"), F.lit(None).cast("string").alias("outputHash"),
        F.when(F.col("value") > 50, "REVIEW_REQUIRED").otherwise("PASS").alias("safetyResult"),
        F.lit("ruleset-0123456789ab").alias("ruleVersion"),
    )
    feedback = events.filter(~is_task).select(
        F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("feedbackId"),
        F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("taskId"), F.col("ts").alias("createdAt"),
        user.alias("userId"), F.col("event_type").alias("feedbackCode"), F.lit("PENDING").alias("reviewStatus"),
    )
    return tasks, feedback


def _stamp(df: DataFrame) -> DataFrame:
    return df.withColumn("created_at", F.unix_micros("created_at"))


def audit_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stamp(A.audit_history(*event_logs(spark, sf_dir)))


def audit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stamp(A.audit_records(*event_logs(spark, sf_dir)))


def log_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that may not be appended: here, feedback derived from sign-ups without a task."""
    _, feedback = event_logs(spark, sf_dir)
    broken = feedback.withColumn("taskId", F.when(F.col("feedbackCode") == "error", " ").otherwise(F.col("taskId")))
    checked = A.check_feedback_log(broken)
    return checked.select("feedbackId", F.explode("violations").alias("violation"))


def dashboard_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = A.audit_records(*event_logs(spark, sf_dir))
    promoted = _promotion(spark, sf_dir).promoted
    return A.dashboard_counters(records, promoted, T.exposures(spark, sf_dir))


_RECORDS_SQL = """records AS (
  SELECT 'TaskLog' AS source, 't' || event_id AS entry_id, 't' || event_id AS task_id, epoch_us(ts) AS created_at,
    event_type AS activity_type, 'Events' AS detail, CASE WHEN value > 50 THEN 'REVIEW_REQUIRED' ELSE 'PASS' END AS result,
    'ruleset-0123456789ab' AS rule_version, left(sha256(CAST(user_id AS VARCHAR)), 12) AS user_hash_prefix,
    left(sha256(props), 12) AS request_hash_prefix, '' AS output_hash_prefix
  FROM events WHERE event_type IN ('purchase', 'signup')
  UNION ALL SELECT 'FeedbackLog', 'f' || event_id, 't' || user_id, epoch_us(ts), event_type, 'Feedback', 'PENDING', '',
    left(sha256(CAST(user_id AS VARCHAR)), 12), '', '' FROM events WHERE event_type NOT IN ('purchase', 'signup'))"""

QUERIES = {
    f.__name__: f
    for f in (
        catalog_search, catalog_search_indexed, catalog_findings, citation_warnings, index_statistics,
        clause_search, active_clauses, clause_date_warnings, clause_ids,
        text_scan, text_scan_conversations, safety_result,
        _default_scan("sql"), _default_scan("macro"), _default_scan("formula"), _default_scan("forbidden"),
        promote_examples, promote_skipped, promote_warnings, example_search,
        audit_history, audit_records, log_violations, dashboard_counters,
    )
}

SQL = {
    "catalog_search": _CATALOG_SEARCH,
    "catalog_search_indexed": _CATALOG_SEARCH,
    "catalog_findings": f"""WITH {PART_CATALOG_SQL} SELECT code, severity, count(*) AS entries FROM (
      SELECT CASE upper(status) WHEN 'PROD_ONLY' THEN 'KB_PROD_ONLY_METADATA' WHEN 'MANUAL_APPROVAL_REQUIRED'
          THEN 'KB_APPROVAL_REQUIRED' ELSE 'KB_UNKNOWN_STATUS' END AS code,
        CASE upper(status) WHEN 'PROD_ONLY' THEN 'Info' WHEN 'MANUAL_APPROVAL_REQUIRED' THEN 'Medium' ELSE 'High' END AS severity
      FROM cat WHERE NOT {_PUBLIC}
      UNION ALL SELECT 'KB_LICENSE_MISSING', 'Medium' FROM cat WHERE {_missing_sql('license_status')}
      UNION ALL SELECT 'KB_APPROVAL_MISSING', 'Medium' FROM cat WHERE {_missing_sql('approval_status')}) GROUP BY ALL""",
    "citation_warnings": f"WITH {PART_CATALOG_SQL} " + " UNION ALL ".join(
        f"SELECT source_id, '{f}' AS field, {f} AS value FROM cat WHERE trim({f}) <> '' AND {_missing_sql(f)}"
        for f in K.CITATION_FIELDS
    ),
    "index_statistics": f"""WITH {PART_CATALOG_SQL},
      f AS (SELECT source_id, upper(unnest([source_id, title, category, source_org, source_type, status, note])) AS v FROM cat),
      st AS (SELECT source_id, v, unnest(range(1, length(v) + 1)) AS s FROM f),
      terms AS (SELECT DISTINCT source_id, substr(v, s, n) AS term FROM
        (SELECT *, unnest(range(1, least(32, length(v) - s + 1) + 1)) AS n FROM st))
      SELECT count(DISTINCT term) AS indexed_terms, count(*) AS postings FROM terms""",
    "clause_search": _CLAUSE_SEARCH,
    "active_clauses": f"WITH {_CLAUSES_SQL} SELECT chunk_id, effective_date, repeal_date FROM active",
    "clause_date_warnings": f"""WITH {_CLAUSES_SQL} SELECT chunk_id, source_id, 'effective_date' AS field
      FROM clauses WHERE lang = 'es'""",
    "clause_ids": f"""WITH {_CLAUSES_SQL}, h AS (SELECT *, sha256(clause_text) AS source_text_hash FROM clauses)
      SELECT doc_id, 'clause-' || left(sha256(length(source_id) || ':' || source_id || length(clause_ref) || ':' || clause_ref
        || '6:pack-1' || '64:' || source_text_hash), 12) AS chunk_id, source_text_hash FROM h""",
    "text_scan": text_scan_sql("documents", "doc_id", True),
    "text_scan_conversations": text_scan_sql("conversations", "conv_id, turn", False, CONVERSATION_RULES),
    "safety_result": f"""WITH hits AS ({text_scan_sql('documents', 'doc_id', False)})
      SELECT d.doc_id, CASE WHEN bool_or(severity = 'Blocker') THEN 'BLOCKED' WHEN bool_or(severity = 'High')
        THEN 'REVIEW_REQUIRED' ELSE 'PASS' END AS safety_result FROM documents d LEFT JOIN hits USING (doc_id) GROUP BY d.doc_id""",
    "scan_sql": _sql_scan(),
    "scan_macro": _macro_scan(),
    "scan_formula": _formula_scan(),
    "scan_forbidden": _forbidden_scan(),
    "promote_examples": f"WITH {_FEEDBACK_SQL} SELECT * EXCLUDE (exampleBody) FROM promoted",
    "promote_skipped": f"""WITH {_FEEDBACK_SQL} SELECT fid AS feedbackId, 't1' AS taskId,
      CASE WHEN toxic = 1 THEN 'USER_NOT_HASHED' WHEN quality <> 1 THEN 'NOT_APPROVED' ELSE 'DUPLICATE' END AS reason,
      CAST(CASE WHEN toxic = 1 OR quality <> 1 THEN 2 ELSE 1 END AS BIGINT) AS entries FROM feedback""",
    "promote_warnings": f"""WITH {_FEEDBACK_SQL}
      SELECT CASE WHEN toxic = 1 THEN 'USER_NOT_HASHED' ELSE 'DUPLICATE_FEEDBACK' END AS warning, fid AS feedbackId,
        't1' AS taskId, '' AS codes FROM feedback, range(CASE WHEN toxic = 1 THEN 2 WHEN quality = 1 THEN 1 ELSE 0 END)
      UNION ALL SELECT 'BODY_' || state, fid, 't1', CASE WHEN state = 'BLOCKED' THEN codes ELSE '' END
      FROM gated WHERE state IN ('UNCERTAIN', 'BLOCKED')""",
    "example_search": f"""WITH {_FEEDBACK_SQL}, s AS ({_example_scores()})
      SELECT query_id, rank, score, exampleId, feedbackId FROM (SELECT *, row_number() OVER
        (PARTITION BY query_id ORDER BY score DESC, exampleId) AS rank FROM s WHERE score > 0) WHERE rank <= 5""",
    "audit_history": f"WITH {_RECORDS_SQL} SELECT * FROM records ORDER BY created_at DESC, source, entry_id LIMIT 200",
    "audit_records": f"WITH {_RECORDS_SQL} SELECT * FROM records",
    "log_violations": """SELECT 'f' || event_id AS feedbackId, 'taskId' AS violation FROM events WHERE event_type = 'error'""",
    "dashboard_counters": f"""WITH {T.EXPOSURES_SQL}, {_FEEDBACK_SQL}
      SELECT 'Audit Records' AS metric, count(*) AS value FROM events
      UNION ALL SELECT 'Promoted Examples', count(*) FROM promoted
      UNION ALL SELECT 'Reports', count(DISTINCT base_dt) FROM exposures""",
}
