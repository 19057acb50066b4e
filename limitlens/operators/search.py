"""Keyword search over the catalog, its clauses, and promoted examples.

Queries are parameters: their words become literals, every document is scored in place
and only hits leave the row. Documents are read once for all queries.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from limitlens import schema as S
from limitlens.functions.dates import search_date, strict_date
from limitlens.functions.found import explode_rows, found_array
from limitlens.functions.text import (
    MAX_NGRAM, WHITE_SPACE, bounded_substrings, clean, fold, fold_key, is_blank, is_placeholder,
    length_prefixed, query_delimiter_terms, query_space_terms, query_word_terms, sha256_hex,
    short_id, snippet,
)
from limitlens.plans.ranking import first_per_key, top_n_per_group
from limitlens.plans.reuse import materialized
from limitlens.plans.sizing import collect_bounded, fits_broadcast
from limitlens.plans.local import local_table

MAX_QUERIES = 10_000

# Catalog fields; the first seven are required.
CATALOG_FIELDS = (
    "source_id", "category", "title", "source_org", "source_type", "status", "note",
    "source", "version", "effective_date", "repeal_date", "file_hash", "loaded_date",
    "approval_status", "superseded_by", "license_status",
)
# Weights of the whole query and of each term, per field.
CATALOG_WEIGHTS = {
    "source_id": 10, "title": 8, "category": 5, "source_org": 3, "source_type": 3, "status": 2, "note": 1,
}
CATALOG_TERM_WEIGHTS = {"title": 2, "note": 1}
CLAUSE_WEIGHTS = {"clause_text": 10, "clause_ref": 8}
CLAUSE_TERM_WEIGHTS = {"clause_text": 2, "clause_ref": 4}
EXAMPLE_WEIGHTS = {
    "exampleBody": 10, "feedbackId": 6, "taskId": 6, "feedbackCode": 4, "reviewStatus": 4,
    "promotionMode": 3, "exampleBodyKind": 2,
}
EXAMPLE_TERM_WEIGHTS = {
    "exampleBody": 3, "feedbackId": 2, "taskId": 2, "feedbackCode": 1, "reviewStatus": 1,
}
MIN_TERM = 2

# Catalog states and their disclosure.
PUBLIC_STATUSES = ("CATALOG_ONLY", "PUBLIC_APPROVED", "APPROVED_PUBLIC")
PROD_ONLY = "PROD_ONLY"
APPROVAL_REQUIRED = "MANUAL_APPROVAL_REQUIRED"
CITATION_FIELDS = ("version", "effective_date", "repeal_date", "loaded_date", "license_status")


@dataclass(frozen=True)
class Query:
    query_id: str
    text: str


def as_queries(queries: str | Sequence | DataFrame) -> list[Query]:
    """Queries from a text, a list of texts or (id, text) pairs, or a (query_id, query) table."""
    if isinstance(queries, DataFrame):
        rows = collect_bounded(queries.select("query_id", "query"), MAX_QUERIES, "queries")
        pairs = [(str(r["query_id"]), r["query"] or "") for r in rows]
    elif isinstance(queries, str):
        pairs = [(queries, queries)]
    else:
        pairs = [(q, q) if isinstance(q, str) else (str(q[0]), q[1] or "") for q in queries]
    cleaned = [Query(i, text.strip(WHITE_SPACE)) for i, text in pairs]
    return [q for q in cleaned if q.text]


def score(
    query: str, terms: Sequence[str], weights: dict[str, int], term_weights: dict[str, int],
    folded: Callable[[str], Column],
) -> Column:
    """Weighted count of the fields that contain the query, plus those that contain a term."""
    total = F.lit(0)
    for field, weight in weights.items():
        hit = F.contains(folded(field), F.lit(query.upper()))
        total = total + F.when(hit, weight).otherwise(0)
    for term in terms:
        if len(term) < MIN_TERM:
            continue
        for field, weight in term_weights.items():
            hit = F.contains(folded(field), F.lit(term.upper()))
            total = total + F.when(hit, weight).otherwise(0)
    return total


def _hits(
    docs: DataFrame, queries: list[Query], fields: Sequence[str], keep: Sequence[str],
    score_of: Callable[[Query, Callable[[str], Column]], Column],
    extra: Callable[[Query], dict[str, Column]] | None = None,
) -> DataFrame:
    """One row per (query, document) with a positive score."""
    # Folded once per document, in a projection of its own.
    folded = docs.withColumns({f"__f_{f}": fold(F.coalesce(f, F.lit(""))) for f in fields})
    name = lambda field: F.col(f"__f_{field}")
    found, element = [], ["query_id:string", "score:int"]
    for query in queries:
        points = score_of(query, name)
        more = extra(query) if extra else {}
        element[2:] = [f"{n}:string" for n in more]
        found.append((points > 0, F.struct(
            F.lit(query.query_id).alias("query_id"),
            points.alias("score"),
            *[c.alias(n) for n, c in more.items()],
        )))
    hits = found_array(found, f"struct<{','.join(element)}>")
    return explode_rows(folded, keep, hits, "__hit").select("__hit.*", *keep)


# --- disclosure ----------------------------------------------------------------------------

def missing_gate(name: str) -> Column:
    """Metadata that blocks a snippet: blank or still to be confirmed."""
    value = F.coalesce(F.col(name), F.lit(""))
    return is_blank(value) | is_placeholder(value)


def with_disclosure(entries: DataFrame) -> DataFrame:
    """Disclosure class, snippet gate and findings of catalog entries, by their status."""
    status = fold_key("status")
    public = status.isin(*PUBLIC_STATUSES)
    disclosure = (
        F.when(public, "PublicCited").when(status == APPROVAL_REQUIRED, "ApprovalRequired")
        .otherwise("MetadataOnly")
    )
    source = F.col("source_id")
    raised = [
        F.when(status == PROD_ONLY, S.finding("KB_PROD_ONLY_METADATA", "Info", source))
        .when(status == APPROVAL_REQUIRED, S.finding("KB_APPROVAL_REQUIRED", "Medium", source))
        .when(~public, S.finding("KB_UNKNOWN_STATUS", "High", source)),
        F.when(missing_gate("license_status"), S.finding("KB_LICENSE_MISSING", "Medium", source)),
        F.when(missing_gate("approval_status"), S.finding("KB_APPROVAL_MISSING", "Medium", source)),
    ]
    allowed = public
    for name in ("version", "effective_date", "approval_status", "license_status"):
        allowed = allowed & ~missing_gate(name)
    return entries.withColumns({
        "disclosure": disclosure,
        "snippet_allowed": allowed,
        "findings": F.array_compact(F.array(*raised)),
    })


def citation_warnings(results: DataFrame, ids: Sequence[str] = ("query_id", "source_id")) -> DataFrame:
    """Citation fields of the results that still hold a placeholder."""
    pairs = F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in CITATION_FIELDS
    ])
    return (
        results.select(*ids, F.explode(pairs).alias("c"))
        .filter(is_placeholder(F.coalesce("c.value", F.lit(""))))
        .select(*ids, "c.field", "c.value")
    )


# --- catalog -------------------------------------------------------------------------------

def catalog_entries(catalog: DataFrame, row_no: str | None = None) -> DataFrame:
    """Trimmed catalog with every field present, and its row order as ``_row_no``.

    Without a row order the ids must be unique: there is no last entry of an id then.
    """
    present = {c.lower() for c in catalog.columns}
    order = F.col(row_no) if row_no and row_no.lower() in present else F.lit(0)
    return catalog.select(
        *[(clean(f) if f in present else F.lit("")).alias(f) for f in CATALOG_FIELDS],
        order.alias("_row_no"),
    )


def catalog_search(
    entries: DataFrame, queries, k: int = 5, postings: DataFrame | None = None,
    unique_ids: bool = False,
) -> DataFrame:
    """Best ``k`` catalog entries per query, with disclosure.

    Of entries with the same id the last one counts; ``unique_ids`` tells there are none.
    ``postings`` (see ``ngram_postings``) may narrow the entries scored; results are the same.
    """
    asked = as_queries(queries)
    if not asked:
        raise ValueError("no query given")
    every = entries
    if postings is not None and all(len(q.text) <= MAX_NGRAM for q in asked):
        entries = entries.join(candidates(postings, asked, by_query=False), "source_id", "left_semi")

    def points(query: Query, folded: Callable[[str], Column]) -> Column:
        return score(query.text, query_space_terms(query.text), CATALOG_WEIGHTS, CATALOG_TERM_WEIGHTS, folded)

    keep = [*CATALOG_FIELDS, "_row_no"]
    hits = _hits(entries, asked, list(CATALOG_WEIGHTS), keep, points)
    if not unique_ids:
        # Narrowing keeps all entries of an id or none, so the postings are not looked up again here.
        last = every.groupBy("source_id").agg(F.max("_row_no").alias("_row_no"))
        hits = hits.join(last, ["source_id", "_row_no"])
    order = [F.desc("score"), F.asc("source_id")]
    best = top_n_per_group(hits, ["query_id"], order, max(1, k)).drop("_row_no")
    return with_disclosure(best)


# --- clauses -------------------------------------------------------------------------------

def clause_ids(clauses: DataFrame) -> DataFrame:
    """Content-addressed id and text hash of each clause."""
    hashed = clauses.withColumn("source_text_hash", sha256_hex("clause_text"))
    seed = length_prefixed("source_id", "clause_ref", "pack_version", "source_text_hash")
    return hashed.withColumn("chunk_id", short_id("clause", seed))


def active_on(as_of) -> Column:
    """Half-open validity: effective on or before the date, not yet repealed; a bad date excludes."""
    day = F.lit(as_of)
    effective, repeal = strict_date("effective_date"), strict_date("repeal_date")
    return F.coalesce(
        (effective <= day) & (is_blank("repeal_date") | (day < repeal)), F.lit(False)
    )


def date_warnings(clauses: DataFrame) -> DataFrame:
    """Clauses whose dates are not yyyy-MM-dd."""
    bad = [
        F.when(strict_date("effective_date").isNull(), F.lit("effective_date")),
        F.when(~is_blank("repeal_date") & strict_date("repeal_date").isNull(), F.lit("repeal_date")),
    ]
    return clauses.select(
        "chunk_id", "source_id", "clause_ref", F.explode(F.array_compact(F.array(*bad))).alias("field")
    )


def clause_search(
    clauses: DataFrame, entries: DataFrame, queries, as_of: str | None = None, k: int = 5
) -> DataFrame:
    """Best ``k`` clauses per query valid on a date, with catalog metadata and gated snippet.

    A query longer than 32 characters must occur as a whole in the text or the reference.
    ``search_date`` is the date used; ``search_date_valid`` is false where ``as_of`` was not
    usable and today's date stands in for it.
    """
    asked = as_queries(queries)
    if not asked:
        raise ValueError("no query given")
    day, usable = search_date(as_of)

    def points(query: Query, folded: Callable[[str], Column]) -> Column:
        total = score(query.text, query_word_terms(query.text), CLAUSE_WEIGHTS, CLAUSE_TERM_WEIGHTS, folded)
        if len(query.text) <= MAX_NGRAM:
            return total
        whole = F.lit(query.text.upper())
        return F.when(
            F.contains(folded("clause_text"), whole) | F.contains(folded("clause_ref"), whole), total
        ).otherwise(0)

    def snippets(query: Query) -> dict[str, Column]:
        return {"snippet": snippet("clause_text", query_word_terms(query.text))}

    hits = _hits(
        clauses.filter(active_on(day)), asked, list(CLAUSE_WEIGHTS),
        ["chunk_id", "source_id", "clause_ref"], points, snippets,
    )
    order = [F.desc("score"), F.asc("chunk_id")]
    # At most k rows per query; written so that the clauses are scored once, not once more
    # to find the catalog entries the hits name.
    best = materialized(top_n_per_group(hits, ["query_id"], order, max(1, k)))
    return _with_catalog(best, entries).withColumns({
        "search_date": F.lit(day.isoformat()), "search_date_valid": F.lit(usable),
    })


def _with_catalog(best: DataFrame, entries: DataFrame) -> DataFrame:
    """Catalog metadata of the hits: first entry per case-folded id; none means metadata only."""
    keyed = entries.withColumn("__key", fold_key("source_id"))
    # Only the entries the few hits name are grouped and joined.
    wanted = best.select(fold_key("source_id").alias("__key")).distinct()
    named = keyed.join(wanted, "__key", "left_semi")
    first = with_disclosure(first_per_key(named, ["__key"], ["source_id", "_row_no"]))
    meta = first.select(
        "__key", F.lit(True).alias("catalog_found"), F.col("title").alias("document_name"),
        "version", "effective_date", "repeal_date", F.col("source").alias("source_locator"),
        "category", "source_org", "disclosure", "snippet_allowed", "findings",
    )
    joined = best.withColumn("__key", fold_key("source_id")).join(meta, "__key", "left").drop("__key")
    missing = F.array(S.finding("KB_CLAUSE_CATALOG_MISSING", "Medium", F.col("source_id")))
    text = ("document_name", "version", "effective_date", "repeal_date", "source_locator", "category", "source_org")
    return joined.withColumns({
        **{c: F.coalesce(c, F.lit("")) for c in text},
        "catalog_found": F.coalesce("catalog_found", F.lit(False)),
        "disclosure": F.coalesce("disclosure", F.lit("MetadataOnly")),
        "snippet": F.when(F.col("snippet_allowed"), F.col("snippet")).otherwise(""),
        "snippet_allowed": F.coalesce("snippet_allowed", F.lit(False)),
        "findings": F.coalesce("findings", missing),
    })


# --- promoted examples ---------------------------------------------------------------------

def example_search(examples: DataFrame, queries, k: int = 5) -> DataFrame:
    """Best ``k`` promoted examples per query."""
    asked = as_queries(queries)
    if not asked:
        raise ValueError("no query given")

    def points(query: Query, folded: Callable[[str], Column]) -> Column:
        return score(
            query.text, query_delimiter_terms(query.text), EXAMPLE_WEIGHTS, EXAMPLE_TERM_WEIGHTS, folded
        )

    hits = _hits(examples, asked, list(EXAMPLE_WEIGHTS), ["exampleId", "feedbackId", "taskId"], points)
    return top_n_per_group(hits, ["query_id"], [F.desc("score"), F.asc("exampleId")], max(1, k))


# --- n-gram postings -----------------------------------------------------------------------

def ngram_postings(
    docs: DataFrame, doc_id: str = "source_id", fields: Sequence[str] = tuple(CATALOG_WEIGHTS)
) -> DataFrame:
    """(term, id) for every substring of up to 32 characters of the fields, case-folded.

    About 32 terms per character: meant for short fields. The documents are spread before
    they grow; terms are made distinct within the row, so the postings need no shuffle.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(doc_id, *[f for f in fields if f != doc_id]).repartition(parts, doc_id)
    terms = F.array_distinct(F.concat(*[bounded_substrings(fold_key(f)) for f in fields]))
    return explode_rows(docs, [doc_id], terms, "term").select("term", doc_id)


def index_statistics(postings: DataFrame) -> DataFrame:
    return postings.agg(
        F.count_distinct("term").alias("indexed_terms"), F.count("*").alias("postings")
    )


def candidates(postings: DataFrame, queries, doc_id: str = "source_id", by_query: bool = True) -> DataFrame:
    """Documents sharing a substring with a query of up to 32 characters: (query_id, id), or ids alone."""
    asked = queries if isinstance(queries, list) and all(isinstance(q, Query) for q in queries) else as_queries(queries)
    spark: SparkSession = postings.sparkSession
    pairs = [
        (q.query_id if by_query else None, q.text.upper()[start:start + size])
        for q in asked if len(q.text) <= MAX_NGRAM
        for start in range(len(q.text)) for size in range(1, len(q.text) - start + 1)
    ]
    terms = local_table(spark, sorted(set(pairs)), "query_id string, term string")
    if fits_broadcast(terms):
        terms = F.broadcast(terms)
    return postings.join(terms, "term").select(*(["query_id"] if by_query else []), doc_id).distinct()
