"""Rule and query tables with thousands of rows, and searches over a stored index."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from limitlens.operators import postings as P, query_table as Q, rule_scan as Z, rules as R, search as K
from limitlens.registry import tables as T, text_queries as X
from limitlens.session import ensure_checkpoint_dir

# --- a rule for each word of the conversations -----------------------------------------------


def word_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of three forms from the distinct words of user turns, by the word's length."""
    turns = T.table(spark, sf_dir, "conversations").filter("role = 'user'")
    word, size = F.col("word"), F.length("word")
    words = turns.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("word")).distinct()
    return words.select(
        F.concat(F.lit("W_"), F.upper(word)).alias("code"),
        F.when(size == 6, F.concat(F.lit(r"\b"), word, F.lit(r"\b"))).when(size <= 8, word)
        .otherwise(F.concat(F.lit("(?:"), word, F.lit("[a-z]|"), word, F.lit(r"\.)"))).alias("pattern"),
        F.when(size == 6, "High").when(size <= 8, "Medium").otherwise("Low").alias("severity"),
        F.concat(F.lit("word "), word).alias("message"),
    )


def text_scan_many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thousands of rules over all documents."""
    found = Z.scan_table(T.table(spark, sf_dir, "documents"), "text", word_rules(spark, sf_dir), ["doc_id"])
    return found.select("doc_id", "code", "severity", "severity_rank", F.lower("matched").alias("matched"), "position")


_MANY_RULES = r"""
WITH words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS word FROM conversations WHERE role = 'user'),
docs AS MATERIALIZED (SELECT doc_id, text, lower(text) AS low, ' ' || regexp_replace(lower(text), '[^\p{L}\p{N}_]', ' ', 'g') || ' ' AS spaced FROM documents),
met AS (SELECT docs.*, word, length(word) AS n FROM docs JOIN words ON contains(low, word)),
found AS (SELECT *, CASE WHEN n = 6 THEN instr(spaced, ' ' || word || ' ') - 1 WHEN n <= 8 THEN instr(low, word) - 1
    WHEN regexp_matches(low, word || '[a-z.]') THEN length(regexp_extract(low, '(?s)^(.*?)' || word || '[a-z.]', 1)) ELSE -1 END AS pos FROM met)
SELECT doc_id, 'W_' || upper(word) AS code, CASE WHEN n = 6 THEN 'High' WHEN n <= 8 THEN 'Medium' ELSE 'Low' END AS severity,
  CASE WHEN n = 6 THEN 3 WHEN n <= 8 THEN 2 ELSE 1 END AS severity_rank,
  substr(low, pos + 1, CASE WHEN n <= 8 THEN n ELSE n + 1 END) AS matched, CAST(pos AS INTEGER) AS position
FROM found WHERE pos >= 0"""


def _many_default(kind: str):
    """The default rules as a table; the results equal those of the rules as parameters."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = T.table(spark, sf_dir, "documents").unionByName(X.rule_documents(spark, sf_dir))
        scans = {"sql": Z.sql_scan, "macro": Z.macro_scan, "formula": Z.formula_scan}
        return scans[kind](docs, "text", R.default_rules(spark), ["doc_id"]).select("doc_id", "code", "severity", "position")

    run.__name__ = f"scan_{kind}_rule_table"
    return run


# --- a query for each part, name, brand and size ---------------------------------------------


def part_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, names, brands and sizes of all parts as queries."""
    part = T.table(spark, sf_dir, "part")
    texts = F.array(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")), F.col("p_name"), F.upper("p_brand"),
        F.concat(F.lit(" size "), F.col("p_size").cast("string")),
    )
    asked = part.select(F.explode(texts).alias("query")).distinct()
    return asked.select(F.concat(F.lit("q:"), F.col("query")).alias("query_id"), "query")


def catalog_search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thousands of queries over the catalog."""
    entries = K.catalog_entries(X.part_catalog(spark, sf_dir), "row_no")
    return Q.catalog_search(entries, part_queries(spark, sf_dir), 5).select(*X._CATALOG_OUT)


def catalog_search_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same results from a stored index of two segments; the second replaces some entries of the first.

    The first segment holds entries whose title and note the second one corrects.
    """
    entries = K.catalog_entries(X.part_catalog(spark, sf_dir), "row_no")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    P.append(entries.filter("status != 'DRAFT'").withColumns({"title": F.reverse("title"), "note": F.lit("to be corrected")}), path, 16)
    P.append(entries, path, 16)
    return P.catalog_search(P.open_index(spark, path), part_queries(spark, sf_dir), 5).select(*X._CATALOG_OUT)


_MANY_QUERIES = f"""
WITH {X.PART_CATALOG_SQL},
asked AS (SELECT DISTINCT query FROM (
  SELECT 'p' || p_partkey AS query FROM part UNION ALL SELECT p_name FROM part UNION ALL SELECT upper(p_brand) FROM part
  UNION ALL SELECT ' size ' || p_size FROM part)),
q AS (SELECT 'q:' || query AS query_id, upper(trim(query)) AS w, list_filter(string_split(upper(trim(query)), ' '), lambda t: length(t) >= 2) AS terms FROM asked),
u AS (SELECT *, upper(source_id) AS u1, upper(title) AS u2, upper(category) AS u3, upper(source_org) AS u4, upper(source_type) AS u5, upper(status) AS u6, upper(note) AS u7 FROM cat),
s AS (SELECT query_id, u.*,
    10 * contains(u1, w)::INT + 8 * contains(u2, w)::INT + 5 * contains(u3, w)::INT + 3 * contains(u4, w)::INT + 3 * contains(u5, w)::INT
    + 2 * contains(u6, w)::INT + contains(u7, w)::INT + coalesce(list_sum(list_transform(terms, lambda t: 2 * contains(u2, t)::INT + contains(u7, t)::INT)), 0) AS score
  FROM q, u)
SELECT query_id, CAST(score AS INTEGER) AS score, source_id, status, {X._DISCLOSURE} AS disclosure, ({X._ALLOWED}) AS snippet_allowed, rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id) AS rank FROM s WHERE score > 0) WHERE rank <= 5"""


def clause_search_query_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clause queries as a table."""
    asked = spark.createDataFrame(X.CLAUSE_QUERIES, "query_id string, query string")
    hits = Q.clause_search(X.document_clauses(spark, sf_dir), K.catalog_entries(X.source_catalog(spark, sf_dir), "row_no"), asked, X.AS_OF, 5)
    return hits.select(
        "query_id", "rank", "score", "chunk_id", "source_id", "clause_ref", "document_name", "version",
        "catalog_found", "disclosure", "snippet_allowed", "snippet",
    )


def example_search_query_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The example queries as a table."""
    asked = spark.createDataFrame(X.EXAMPLE_QUERIES, "query_id string, query string")
    return Q.example_search(X._promotion(spark, sf_dir).promoted, asked, 5).select("query_id", "rank", "score", "exampleId", "feedbackId")


def index_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments, documents and postings of an index appended to once."""
    entries = K.catalog_entries(X.part_catalog(spark, sf_dir), "row_no")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    P.append(entries.filter("status = 'DRAFT'"), path, 16)
    P.append(entries.filter("status != 'DRAFT'"), path, 16)
    return P.signature(spark, path).drop("signature")


QUERIES = {
    "text_scan_many_rules": text_scan_many_rules,
    "catalog_search_many": catalog_search_many, "catalog_search_stored": catalog_search_stored,
    "clause_search_query_table": clause_search_query_table, "example_search_query_table": example_search_query_table,
    "index_signature": index_signature,
    **{f"scan_{kind}_rule_table": _many_default(kind) for kind in ("sql", "macro", "formula")},
}
SQL = {
    "text_scan_many_rules": _MANY_RULES,
    "catalog_search_many": _MANY_QUERIES, "catalog_search_stored": _MANY_QUERIES,
    "clause_search_query_table": X.SQL["clause_search"], "example_search_query_table": X.SQL["example_search"],
    "index_signature": X.SQL["index_statistics"].replace(
        "SELECT count(DISTINCT term) AS indexed_terms, count(*) AS postings FROM terms",
        "SELECT CAST(2 AS BIGINT) AS segments, (SELECT count(*) FROM cat) AS documents, count(*) AS postings FROM terms",
    ),
    **{f"scan_{kind}_rule_table": X.SQL[f"scan_{kind}"] for kind in ("sql", "macro", "formula")},
}
