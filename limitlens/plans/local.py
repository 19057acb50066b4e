"""Tables made of parameters."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table of call parameters, as a local relation.

    Handed over as one Arrow batch it is part of the plan: no tasks read it, and joins
    with it are planned from its true size.
    """
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    arrow = to_arrow_schema(kind)
    columns = list(zip(*rows)) if rows else [[] for _ in kind.names]
    batch = pa.table([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)
    return spark.createDataFrame(batch, schema=kind)
