"""A stored n-gram index: terms, field texts and documents in buckets, appended segment by segment.

    <index>/segments/<n>/terms/bucket=<b>/      (term, text_key), sorted by term
    <index>/segments/<n>/owners/bucket=<b>/     (text_key, id): entries with a field of that text
    <index>/segments/<n>/documents/bucket=<b>/  the entries of the segment
    <index>/commits/<n>/                        one row: written last, makes segment n visible

A term leads to the distinct folded texts of fields that hold it, and these to the entries, so that a
text that many entries share has its terms once. Texts go by a hash of 64 bits: two texts with one
hash would add entries to those that are looked at, never to those found.

A search looks up whole queries and terms only, reads the buckets their hashes name, and then
the documents its candidates name. A segment without a commit row is invisible, so a job that
died in between leaves no half index. Of entries with the same id the last segment's, and in
it the last row, counts. One writer at a time, as for any folder of files.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from limitlens.functions.text import MAX_NGRAM, fold_key, space_tokens
from limitlens.operators import query_table as Q, search as K
from limitlens.plans.reuse import materialized

#: Buckets of each segment. A search reads those of its terms alone.
BUCKETS = 64
#: Buckets named one by one in a search; with more, the buckets are joined.
NAMED_BUCKETS = 256

# Terms of a piece of output, and of the texts that a task remembers.
_PIECE, _REMEMBERED = 1 << 17, 1 << 19
# An id with more texts than this has its terms made distinct by a shuffle.
MANY_TEXTS = 1000

_COMMIT = "segment long, buckets int, documents long, postings long, terms_sum string, signature string"


def _bucket(value: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


def commits(spark: SparkSession, index: str) -> DataFrame:
    """A row per visible segment; none for an index that does not exist yet."""
    try:
        return spark.read.schema(_COMMIT).parquet(f"{index}/commits/*")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], _COMMIT)
        raise


def append(entries: DataFrame, index: str, buckets: int = BUCKETS, fields: Sequence[str] = tuple(K.CATALOG_WEIGHTS)) -> int:
    """Write ``entries`` (see ``search.catalog_entries``) as the next segment; its number.

    Only the new entries are indexed. All segments share the first one's number of buckets.
    """
    spark = entries.sparkSession
    known = commits(spark, index).agg(F.max("segment").alias("last"), F.max("buckets").alias("buckets")).first()
    segment = 0 if known["last"] is None else known["last"] + 1
    buckets = known["buckets"] or buckets
    root = f"{index}/segments/{segment}"
    folded = F.array_distinct(F.array(*[F.make_valid_utf8(fold_key(f)) for f in fields]))
    held = materialized(entries.select("source_id", F.explode(folded).alias("text")).filter("text != ''").groupBy("source_id").agg(F.collect_set("text").alias("texts")))
    owners = held.select("source_id", F.explode("texts").alias("text")).withColumn("text_key", F.xxhash64("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    terms = with_terms(owners.select("text_key", "text").distinct().repartition(parts), "text").withColumn("bucket", _bucket(F.col("term"), buckets))
    # Many tasks for each bucket: rows are dealt by term and text, so that no bucket is one task.
    terms.repartition("bucket", F.pmod(F.xxhash64("term", "text_key"), F.lit(8))).sortWithinPartitions("bucket", "term").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{root}/terms")
    placed = owners.select("text_key", "source_id", _bucket(F.col("text_key"), buckets).alias("bucket"))
    placed.repartition("bucket", F.pmod(F.xxhash64("text_key", "source_id"), F.lit(8))).sortWithinPartitions("bucket", "text_key").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{root}/owners")
    entries.withColumn("bucket", _bucket(F.col("source_id"), buckets)).repartition("bucket", F.pmod(F.xxhash64(*entries.columns), F.lit(8))).sortWithinPartitions("bucket", "source_id").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{root}/documents")
    total = F.sum(F.xxhash64("text", "source_id").cast("decimal(38,0)"))
    row = owners.agg(F.lit(segment).cast("long").alias("segment"), F.lit(buckets).alias("buckets"), F.lit(entries.count()).alias("documents"),
        F.lit(_postings(held)).cast("long").alias("postings"), F.coalesce(total, F.lit(0)).cast("string").alias("terms_sum"))
    row = row.withColumn("signature", F.sha2(F.concat_ws(":", F.col("postings").cast("string"), "terms_sum"), 256))
    row.coalesce(1).write.mode("overwrite").parquet(f"{index}/commits/{segment}")
    return segment


def terms_of(text: str) -> set[str]:
    """Every run of up to ``MAX_NGRAM`` characters."""
    n = len(text)
    return {text[i:j] for i in range(n) for j in range(i + 1, min(n, i + MAX_NGRAM) + 1)}


def with_terms(df: DataFrame, text: str) -> DataFrame:
    """The other columns with ``term``, a row for each distinct term of the text. Documents are spread before they grow."""
    names = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[str] = []
            many: list[int] = []
            first = 0
            texts = batch.column(len(names)).to_pylist()
            for i, own in enumerate(texts):
                terms = terms_of(own)
                found += terms
                many.append(len(terms))
                if len(found) >= _PIECE or i + 1 == len(texts):
                    rows = pa.array(np.repeat(np.arange(first, i + 1), many))
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).take(rows) for c in range(len(names))], pa.array(found, pa.string())], names=[*names, "term"])
                    found, many, first = [], [], i + 1

    return df.select(*names, text).mapInArrow(run, df.drop(text).schema.add("term", "string"))


def _postings(held: DataFrame) -> int:
    """Distinct pairs of term and id, for a table of ids with their distinct texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, set[str]] = {}
        size = total = 0
        for batch in batches:
            for texts in batch.column(0).to_pylist():
                own: list[set[str]] = []
                for text in texts:
                    terms = known.get(text)
                    if terms is None:
                        terms = terms_of(text)
                        size += len(terms)
                        if size > _REMEMBERED:
                            known, size = {}, len(terms)
                        known[text] = terms
                    own.append(terms)
                total += len(set().union(*own))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["n"])

    few = held.filter(F.size("texts") <= MANY_TEXTS).select("texts").mapInArrow(run, "n long")
    many = held.filter(F.size("texts") > MANY_TEXTS).select("source_id", F.explode("texts").alias("text"))
    return int(few.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]) + with_terms(many, "text").distinct().count()


def signature(spark: SparkSession, index: str) -> DataFrame:
    """(segments, documents, postings, signature) of the index: the same ids and texts, the same signature.

    Made of the segments' sums, whatever files and partitions hold them.
    """
    total = F.coalesce(F.sum(F.col("terms_sum").cast("decimal(38,0)")), F.lit(0)).cast("string")
    return commits(spark, index).agg(
        F.count("*").alias("segments"), F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.sum("postings"), F.lit(0)).alias("postings"),
        F.sha2(F.concat_ws(":", F.coalesce(F.sum("postings"), F.lit(0)).cast("string"), total), 256).alias("signature"),
    )


@dataclass(frozen=True)
class Index:
    """Opened at one moment: segments committed later are not seen."""

    spark: SparkSession
    path: str
    segments: tuple[int, ...]
    buckets: int

    def _read(self, part: str, schema: str) -> DataFrame:
        roots = [f"{self.path}/segments/{s}/{part}" for s in self.segments]
        if not roots:
            return self.spark.createDataFrame([], schema + ", segment long")
        reader = self.spark.read.schema(schema)
        one = [reader.parquet(root).withColumn("segment", F.lit(s).cast("long")) for s, root in zip(self.segments, roots)]
        out = one[0]
        for more in one[1:]:
            out = out.unionByName(more)
        return out

    def postings(self) -> DataFrame:
        """(term, text_key, bucket, segment)."""
        return self._read("terms", "term string, text_key long, bucket int")

    def owners(self) -> DataFrame:
        """(text_key, source_id, bucket, segment)."""
        return self._read("owners", "text_key long, source_id string, bucket int")

    def documents(self) -> DataFrame:
        """Entries with bucket and segment."""
        fields = ", ".join(f"{f} string" for f in K.CATALOG_FIELDS)
        return self._read("documents", f"{fields}, _row_no long, bucket int")


def open_index(spark: SparkSession, path: str) -> Index:
    """The index as committed so far."""
    rows = commits(spark, path).select("segment", "buckets").orderBy("segment").collect()  # a row per append
    return Index(spark, path, tuple(r["segment"] for r in rows), rows[0]["buckets"] if rows else BUCKETS)


def in_buckets(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``stored`` in the buckets of ``wanted``: named in the plan, so that others are not read.

    With more buckets than ``NAMED_BUCKETS`` the few distinct ones are joined, and pruned when the join runs.
    """
    distinct = wanted.select("bucket").distinct()
    rows = distinct.limit(NAMED_BUCKETS + 1).collect()  # at most the number of buckets
    if len(rows) <= NAMED_BUCKETS:
        return stored.filter(F.col("bucket").isin([r["bucket"] for r in rows]))
    return stored.join(F.broadcast(distinct), "bucket", "left_semi")


def looked_up(index: Index, needles: DataFrame) -> DataFrame:
    """(source_id, bucket): ids of entries that hold a needle, and where they are stored.

    A needle longer than the longest indexed term is looked up by its beginning, which any text
    that holds it holds too.
    """
    term = F.substr(F.make_valid_utf8(fold_key("needle")), F.lit(1), F.lit(MAX_NGRAM))
    terms = materialized(needles.select(term.alias("term")).distinct().withColumn("bucket", _bucket(F.col("term"), index.buckets)))
    met = in_buckets(index.postings(), terms).join(terms, ["bucket", "term"], "left_semi").select("text_key").distinct()
    texts = materialized(met.withColumn("bucket", _bucket(F.col("text_key"), index.buckets)))
    found = in_buckets(index.owners(), texts).join(texts, ["bucket", "text_key"], "left_semi").select("source_id").distinct()
    return materialized(found.withColumn("bucket", _bucket(F.col("source_id"), index.buckets)))


def catalog_search(index: Index, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_table.catalog_search`` over a stored index: only candidate documents are read."""
    wanted = Q.needles(queries, space_tokens)
    ids = looked_up(index, wanted)
    stored = in_buckets(index.documents(), ids).join(ids, ["bucket", "source_id"], "left_semi")
    latest = stored.groupBy("source_id").agg(F.max(F.struct("segment", "_row_no")).alias("latest")).select("source_id", "latest.*")
    entries = materialized(stored.join(latest, ["source_id", "segment", "_row_no"]).drop("bucket", "segment"))
    return Q._catalog_best(entries, wanted, k, unique_ids=True)
