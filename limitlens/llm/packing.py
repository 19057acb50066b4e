"""Packing into token-budget batches with optimal length buckets.

Texts become sequences of at most ``max_len`` tokens, so the global histogram of lengths has
at most ``max_len`` + 1 rows whatever the corpus. Dynamic programming over it finds the bucket
boundaries with the least padding. Sequences are numbered within their bucket over hashed
shards, so that a bucket holding a third of all rows is spread, and every batch of a bucket
but its last is full.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from limitlens.llm import words as W
from limitlens.plans.local import local_table
from limitlens.plans.reuse import materialized

MAX_LEN, BUCKETS, TOKEN_BUDGET = 2048, 16, 65_536
# Sequences of a bucket numbered in one task.
_SHARD_ROWS = 100_000


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens): words [^\\x20\\x09-\\x0D]+ of each whole text; a null has none."""

    def run(batches):
        for batch in batches:
            for low, high, data, offsets in W.text_slices(batch.column(1)):
                bounds = W.spans(data, offsets, W.SPACED)[2]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(np.diff(bounds))], ["doc_id", "n_tokens"])

    kind = docs.select(F.col(key).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    return W.map_batches(docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")), run, f"doc_id {kind}, n_tokens long")


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total padding.

    ``lengths`` ascend. A bucket's bound is the longest length in it, so the last is the
    longest of all. Of equal choices the one with fewer, then shorter buckets is taken.
    """
    n = len(lengths)
    if not n:
        return []
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    rows = np.concatenate([[0], np.cumsum(counts)])
    tokens = np.concatenate([[0], np.cumsum(counts * lengths)])
    # best[j]: least padding of the first j lengths; taking lengths i..j-1 as one bucket
    # costs lengths[j-1] * (rows[j] - rows[i]) - (tokens[j] - tokens[i]).
    best = np.full(n + 1, np.iinfo(np.int64).max // 4, np.int64)
    best[0] = 0
    cuts: list[np.ndarray] = []
    ends = [best[n]]
    for _ in range(min(buckets, n)):
        now, cut = np.empty_like(best), np.zeros(n + 1, np.int64)
        now[0] = 0
        for j in range(1, n + 1):
            cost = best[:j] + lengths[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            cut[j] = cost.argmin()
            now[j] = cost[cut[j]]
        best = now
        cuts.append(cut)
        ends.append(best[n])
    used = int(np.argmin(ends[1:])) + 1
    bounds, j = [], n
    for cut in reversed(cuts[:used]):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(cut[j])
    return bounds[::-1]


def pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text", max_len: int = MAX_LEN, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET,
) -> DataFrame:
    """(doc_id, chunk, token_start, n_tokens, bucket, padded_len, batch, slot): a row per sequence.

    A text of more than ``max_len`` tokens is cut into chunks 0, 1, ...; nothing is dropped.
    bucket is numbered from 0 by length, padded_len is its bound. A batch holds
    token_budget // padded_len sequences, one at least; batch and slot count from 0 within
    the bucket, in the order of a hash of id and chunk.

    A null or empty text is one sequence of no tokens. Null ids are numbered like others;
    repeated rows are sequences of their own. An empty table gives no rows.
    """
    if min(max_len, buckets, token_budget) < 1:
        raise ValueError("max_len, buckets and token_budget are at least 1")
    spark = docs.sparkSession
    counted = materialized(word_counts(docs, key, text))
    last = F.greatest(F.lit(0).cast("long"), F.expr(f"(n_tokens - 1) div {max_len}"))
    chunks = counted.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), last))).select(
        "doc_id", "chunk", (F.col("chunk") * max_len).alias("token_start"), F.least(F.lit(max_len).cast("long"), F.col("n_tokens") - F.col("chunk") * max_len).alias("n_tokens")
    )
    histogram = chunks.groupBy("n_tokens").agg(F.count("*").alias("n")).orderBy("n_tokens").toArrow()  # at most max_len + 1 rows
    lengths, counts = histogram["n_tokens"].to_numpy(), histogram["n"].to_numpy()
    bounds = optimal_boundaries(lengths, counts, buckets)
    place = np.searchsorted(bounds, lengths) if bounds else np.zeros(0, np.int64)
    table = local_table(spark, [(int(x), int(b), int(bounds[b])) for x, b in zip(lengths, place)], "n_tokens long, bucket int, padded_len long")
    shards = max(1, -(-int(counts.sum()) // _SHARD_ROWS))
    order = F.xxhash64("doc_id", "chunk")
    placed = chunks.join(F.broadcast(table), "n_tokens").withColumn("h", order).withColumn("shard", F.pmod("h", F.lit(shards)))
    sizes = placed.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("bucket", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("bucket", "shard").orderBy("h", "doc_id", "chunk", "n_tokens")
    numbered = placed.withColumn("row", F.row_number().over(within) - 1).join(starts, ["bucket", "shard"]).withColumn("row", F.col("row") + F.col("start"))
    fits = F.greatest(F.lit(1).cast("long"), F.expr(f"{token_budget} div greatest(1L, padded_len)"))
    return numbered.withColumn("fits", fits).select(
        "doc_id", "chunk", "token_start", "n_tokens", "bucket", "padded_len", F.expr("row div fits").alias("batch"), F.expr("row % fits").alias("slot")
    )
