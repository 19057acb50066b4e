"""Top-n per group without sending a whole group to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from limitlens.plans.joins import row_bucket

# Up to this rank Spark prunes on the map side.
_PRUNED = "spark.sql.optimizer.windowGroupLimitThreshold"


def top_n_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """The first ``n`` rows of each group with their 1-based rank.

    For n up to the threshold Spark's window group limit keeps n rows per group and map
    task before the shuffle. Above it (or where the session switches that off) the group is
    first cut within hashed buckets, as many as there are shuffle partitions, which keeps
    every row that can be among the first n.
    """
    n = max(0, n)
    source = df
    conf = df.sparkSession.conf
    if n > int(conf.get(_PRUNED)):
        bucket = row_bucket(df, max(1, int(conf.get("spark.sql.shuffle.partitions"))))
        inner = Window.partitionBy(*group, "__bucket").orderBy(*order)
        source = (
            df.withColumn("__bucket", bucket)
            .withColumn("__rank", F.row_number().over(inner))
            .filter(F.col("__rank") <= n)
            .drop("__bucket", "__rank")
        )
    window = Window.partitionBy(*group).orderBy(*order)
    return source.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the smallest by ``order``: a combinable aggregate, not a window.

    A window would sort a hot key in one task; ``min`` over a struct is combined before
    the shuffle, so a task receives at most one row per key and map task.
    """
    rest = [c for c in df.columns if c not in keys]
    lead = [c for c in order if c in rest]
    packed = F.struct(*lead, *[c for c in rest if c not in lead])
    picked = df.groupBy(*keys).agg(F.min(packed).alias("__first"))
    return picked.select(
        *keys, *[F.col("__first").getField(c).alias(c) for c in rest]
    ).select(*df.columns)
