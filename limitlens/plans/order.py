"""The place of each row in one global order, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from limitlens.plans.joins import lookup_join
from limitlens.plans.reuse import materialized

# ``monotonically_increasing_id``: the partition's number, then 33 bits for the row in it.
_ROW_BITS = 33


def ranked(df: DataFrame, order: Sequence[Column | str], rank: str = "rank") -> DataFrame:
    """``df`` with the 1-based place of each row in ``order``.

    Rows are dealt in ranges of the order and sorted inside them; a range's places follow
    from the counts of the ranges before it. Rows that are equal by ``order`` stand in the
    order of a hash of all their columns, so a value that many rows share is spread over
    several ranges; equal rows stand in any order. The ranges are stored before they are
    counted, so that a task that runs again can't place rows anew.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [*[F.col(o) if isinstance(o, str) else o for o in order], F.xxhash64(*columns)]
    dealt = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    stored = materialized(dealt.select(F.struct(*columns).alias("r"), F.monotonically_increasing_id().alias("id")))
    placed = stored.withColumn("part", F.shiftright("id", _ROW_BITS))
    # A row per range: their running sum is the only window.
    counts = placed.groupBy("part").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialized(counts.select("part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")).alias("before")))
    out = lookup_join(placed, offsets, ["part"], "inner", bound=offsets)
    return out.select("r.*", (F.col("before") + F.col("id") - F.col("first") + 1).alias(rank))
