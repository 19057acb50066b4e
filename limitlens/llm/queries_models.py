"""Queries of embedding whitening, the filter audit and the quality classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from limitlens.llm import embedding_whitening, filter_audit, quality_classifier


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight leading whitened components of every embedding."""
    return embedding_whitening.whitened(_table(spark, sf_dir, "embeddings"))


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removals of five filters in all orders, per source."""
    return filter_audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return quality_classifier.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_filter_interaction_audit": op12_filter_interaction_audit,
    "op13_quality_classifier": op13_quality_classifier,
}

SQL = {
    "op12_filter_interaction_audit": r"""
WITH RECURSIVE letter(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders(o) AS (SELECT '' UNION ALL SELECT o || f FROM orders, letter WHERE NOT contains(o, f)),
steps AS (
  SELECT o AS filter_order, k AS step, substr(o, 1, k - 1) AS earlier, substr(o, k, 1) AS f
  FROM orders, (SELECT unnest(range(1, 6)) AS k) WHERE length(o) = 5
),
worded AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
failing AS (
  SELECT doc_id, part,
    CASE WHEN len(w) < 50 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM worded
),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM failing LEFT JOIN known USING (doc_id) GROUP BY part, fails
),
counted AS (
  SELECT part, filter_order, step, f,
    sum(n) FILTER (length(translate(fails, earlier || f, '')) = length(fails)) AS kept,
    sum(n) FILTER (contains(fails, f) AND length(translate(fails, earlier, '')) = length(fails)) AS removed,
    sum(n) FILTER (contains(fails, f) AND length(translate(fails, earlier, '')) < length(fails)) AS redundant,
    sum(n) FILTER (fails = f) AS unique_fails,
    sum(good) FILTER (contains(fails, f) AND length(translate(fails, earlier, '')) = length(fails)) AS good_lost,
    sum(toxic) FILTER (contains(fails, f) AND length(translate(fails, earlier, '')) = length(fails)) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
""",
}
