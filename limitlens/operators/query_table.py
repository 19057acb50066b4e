"""Keyword search where the queries are a table of any length.

The plan does not grow with the queries. Each whole query and each of its terms is a needle;
a document meets only the needles it contains, is scored against those, and the points of a
query and document are summed. Results equal those of the searches whose queries are
parameters.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from limitlens.functions.dates import search_date
from limitlens.functions.text import MAX_NGRAM, clean, delimiter_tokens, fold, snippet_of, space_tokens, word_tokens
from limitlens.operators import search as K
from limitlens.plans.contain import containing
from limitlens.plans.held import best_texts
from limitlens.plans.ranking import top_n_per_group
from limitlens.plans.reuse import materialized
from limitlens.plans.sizing import broadcast_limit

# Parts the fields of a document, so that no needle spans two of them.
_BETWEEN = "\x01"


def needles(queries: DataFrame, terms: Callable[[Column], Column]) -> DataFrame:
    """(query_id, query, needle, whole, times): whole queries, and their terms of two letters and more.

    ``queries`` has query_id and query; blank queries are left out. times counts how often
    the query repeats a term. A stored table.
    """
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), clean("query").alias("query")).filter("query != ''").distinct()
    whole = asked.select("query_id", "query", F.col("query").alias("needle"), F.lit(True).alias("whole"), F.lit(1).alias("times"))
    parts = (
        asked.select("query_id", "query", F.explode(terms(F.col("query"))).alias("needle")).filter(F.length("needle") >= K.MIN_TERM)
        .groupBy("query_id", "query", "needle").agg(F.count("*").cast("int").alias("times"))
    )
    return materialized(whole.unionByName(parts.withColumn("whole", F.lit(False)).select(*whole.columns)))


def points(weights: dict[str, int], term_weights: dict[str, int]) -> Column:
    """Points of a document's fields, folded, for the needle on its row."""
    form = fold("needle")

    def total(given: dict[str, int]) -> Column:
        out = F.lit(0)
        for field, weight in given.items():
            out = out + F.when(F.contains(F.col(field), form), weight).otherwise(0)
        return out

    return F.when(F.col("whole"), total(weights)).otherwise(F.col("times") * total(term_weights))


def summed(met: DataFrame, key: Sequence[str], weights: dict[str, int], term_weights: dict[str, int]) -> DataFrame:
    """(query_id, query, key, score, whole): score of every query and document that met by a needle.

    ``whole`` says whether the whole query is in a weighted field. Documents with the same
    key count once.
    """
    scored = met.withColumn("__points", points(weights, term_weights)).filter("__points > 0")
    once = scored.groupBy("query_id", "query", *key, "needle", "whole").agg(F.max("__points").alias("points"))
    return once.groupBy("query_id", "query", *key).agg(F.sum("points").cast("int").alias("score"), F.max("whole").alias("whole"))


def hits(
    docs: DataFrame, key: Sequence[str], wanted: DataFrame, weights: dict[str, int], term_weights: dict[str, int]
) -> DataFrame:
    """``summed`` over all documents that contain a needle."""
    fields = list(dict.fromkeys([*weights, *term_weights]))
    # Dealt by their key: a document's points are summed where it met its needles, without another shuffle.
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.sparkSession.sparkContext.defaultParallelism)
    # Fields are folded before, once per document; those of the key stay as they are beside that.
    names = {f: f"__field_{f}" for f in fields}
    folded = [fold(F.coalesce(f, F.lit(""))).alias(names[f]) for f in fields]
    kept = docs.select(*key, *folded).repartition(parts, *key)
    body = F.concat_ws(_BETWEEN, *names.values())
    given = ({names[f]: w for f, w in x.items()} for x in (weights, term_weights))
    return summed(containing(kept, body, wanted, dealt=True), key, *given)


def _asked(wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``needles`` by the numbers of their queries, folded (see ``held.best_texts``), and the queries with their numbers; both stored."""
    # Numbered where they are stored: the numbers stay as they are.
    queries = materialized(wanted.select("query_id", "query").distinct().withColumn("number", F.monotonically_increasing_id()))
    rows = wanted.join(queries, ["query_id", "query"]).select(F.col("number").alias("query"), F.octet_length("query").alias("length"), fold("needle").alias("form"), "whole", "times")
    counts = rows.groupBy("query", "length", "form").agg(F.count_if("whole").alias("whole"), F.sum(F.when(F.col("whole"), 0).otherwise(F.col("times"))).alias("times"))
    return materialized(counts), queries


def _catalog_found(entries: DataFrame, wanted: DataFrame, k: int, unique_ids: bool) -> DataFrame:
    """(query_id, source_id, _row_no, score): of the last entries, those that may be a query's best, these among them."""
    fields = list(dict.fromkeys([*K.CATALOG_WEIGHTS, *K.CATALOG_TERM_WEIGHTS]))
    if broadcast_limit(entries) <= 0:
        found = hits(entries, ["source_id", "_row_no"], wanted, K.CATALOG_WEIGHTS, K.CATALOG_TERM_WEIGHTS).drop("query")
        return found if unique_ids else found.join(_last(entries), ["source_id", "_row_no"])
    # Dealt by the id once: the last entries, and entries with equal keys, are told there.
    parts = max(1, int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), entries.sparkSession.sparkContext.defaultParallelism)
    kept = entries.select("source_id", "_row_no", F.struct(*[fold(F.coalesce(f, F.lit(""))).alias(f) for f in fields]).alias("fields")).repartition(parts, "source_id")
    if not unique_ids:
        kept = kept.join(_last(kept), ["source_id", "_row_no"])
    docs = materialized(kept.groupBy("source_id", "_row_no").agg(F.collect_set("fields").alias("fields")))
    asked, queries = _asked(wanted)
    found = best_texts(docs, [K.CATALOG_WEIGHTS.get(f, 0) for f in fields], [K.CATALOG_TERM_WEIGHTS.get(f, 0) for f in fields], asked, max(1, k))
    return found.join(queries.select(F.col("number").alias("query"), "query_id"), "query")


def _last(entries: DataFrame) -> DataFrame:
    return entries.groupBy("source_id").agg(F.max("_row_no").alias("_row_no"))


def _catalog_best(entries: DataFrame, wanted: DataFrame, k: int, unique_ids: bool) -> DataFrame:
    found = _catalog_found(entries, wanted, k, unique_ids)
    order = [F.desc("score"), F.asc("source_id")]
    best = materialized(top_n_per_group(found.select("query_id", "source_id", "_row_no", "score"), ["query_id"], order, max(1, k)))
    # The entries are read once more, for those that the few best rows name.
    named = entries.join(best.select("source_id", "_row_no").distinct(), ["source_id", "_row_no"], "left_semi").dropDuplicates(["source_id", "_row_no"])
    return K.with_disclosure(best.join(named, ["source_id", "_row_no"]).drop("_row_no"))


def catalog_search(entries: DataFrame, queries: DataFrame, k: int = 5, unique_ids: bool = False) -> DataFrame:
    """``search.catalog_search`` for a table of queries (query_id, query)."""
    return _catalog_best(entries, needles(queries, space_tokens), k, unique_ids)


def clause_search(clauses: DataFrame, entries: DataFrame, queries: DataFrame, as_of: str | None = None, k: int = 5) -> DataFrame:
    """``search.clause_search`` for a table of queries (query_id, query); chunk_id identifies a clause."""
    day, usable = search_date(as_of)
    active = clauses.filter(K.active_on(day))
    key = ["chunk_id", "source_id", "clause_ref"]
    found = hits(active, key, needles(queries, word_tokens), K.CLAUSE_WEIGHTS, K.CLAUSE_TERM_WEIGHTS)
    found = found.filter(F.col("whole") | (F.length("query") <= MAX_NGRAM))
    order = [F.desc("score"), F.asc("chunk_id")]
    best = materialized(top_n_per_group(found.select("query_id", "query", "score", *key), ["query_id"], order, max(1, k)))
    texts = active.select("chunk_id", "clause_text").join(best.select("chunk_id").distinct(), "chunk_id", "left_semi").dropDuplicates(["chunk_id"])
    snipped = best.join(texts, "chunk_id").withColumn("snippet", snippet_of("clause_text", word_tokens("query"))).drop("clause_text", "query")
    return K._with_catalog(materialized(snipped), entries).withColumns({
        "search_date": F.lit(day.isoformat()), "search_date_valid": F.lit(usable),
    })


def example_search(examples: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``search.example_search`` for a table of queries (query_id, query); exampleId identifies an example."""
    key = ["exampleId", "feedbackId", "taskId"]
    found = hits(examples, key, needles(queries, delimiter_tokens), K.EXAMPLE_WEIGHTS, K.EXAMPLE_TERM_WEIGHTS)
    return top_n_per_group(found.select("query_id", "score", *key), ["query_id"], [F.desc("score"), F.asc("exampleId")], max(1, k))
