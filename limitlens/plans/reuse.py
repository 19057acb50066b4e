"""Compute once, read many times."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from limitlens.session import ensure_checkpoint_dir


def materialized(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared checkpoint folder and read it back.

    The result has no lineage to recompute when an executor is lost, column pruning for
    each reader, and a known size. The folder is removed by whoever owns the checkpoint
    folder, like any checkpoint.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/limitlens-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
