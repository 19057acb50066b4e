"""Back from counted rows to single rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

_CHUNK = 10_000


def expand_counts(df: DataFrame, count: str = "n") -> DataFrame:
    """Repeat each row ``count`` times.

    Two steps: a row becomes one row per chunk, chunks are spread over the cluster, then
    each chunk is unrolled. A count of billions does not stay in one task. The number of
    partitions is given, so that small chunks are not coalesced before they grow.
    """
    chunks = df.filter(F.col(count) > 0).withColumn(
        "__chunk",
        F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({count} - 1) div {_CHUNK}"))),
    )
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = chunks.repartition(parts, *[F.col(c) for c in chunks.columns])
    size = F.least(F.lit(_CHUNK).cast("long"), F.col(count) - F.col("__chunk") * _CHUNK)
    return spread.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), size))).drop(
        "__chunk", "__i", count
    )
