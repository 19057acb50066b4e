"""Measured sizes. Nothing is broadcast or collected on a guess."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, functions as F, types as T

# Largest side that is broadcast, in bytes of row data measured by ``measured_bytes``.
# Override per session with spark.conf.set("limitlens.broadcastBytes", ...).
BROADCAST_BYTES = 32 * 1024 * 1024
# Per-row overhead of a hashed relation.
_ROW_OVERHEAD = 64


def broadcast_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("limitlens.broadcastBytes", str(BROADCAST_BYTES)))


def measured_bytes(df: DataFrame) -> int:
    """Bytes the rows of ``df`` take in memory: one map-side combined aggregate."""
    width = F.lit(_ROW_OVERHEAD).cast("long")
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(column), F.lit(0)) + 8
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) + 16
        else:
            width = width + 16
    return int(df.agg(F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()["b"])


def fits_broadcast(df: DataFrame) -> bool:
    limit = broadcast_limit(df)
    return limit > 0 and measured_bytes(df) <= limit


def collect_bounded(df: DataFrame, max_rows: int, what: str) -> list[Row]:
    """Rows of a configuration-sized table; refuses a larger one instead of cutting it."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what}: more than {max_rows} rows")
    return rows
