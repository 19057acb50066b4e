"""Lines of text files with their numbers, the same however the files are split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from limitlens.functions.text import trim_ws
from limitlens.plans.joins import lookup_join
from limitlens.plans.reuse import materialized

# A quoted field: from a quote at the field's beginning to the next one that stands alone.
_QUOTED = r'(^|,)"(?:[^"]|"")*"(?=,|$)'


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): all lines of a file or folder, numbered from 1 in each file.

    Splits are numbered on their own, in one scan whose result is stored; a line's number is
    its place in its split after the lines of the file's earlier splits.
    """
    read = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value",
    )
    stored = materialized(read)
    splits = stored.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialized(splits.select("file", "block", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")).alias("before")))
    joined = lookup_join(stored, offsets, ["file", "block"], "inner", bound=offsets)
    return joined.select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line_no"), "value")


def field_count(line: Column) -> Column:
    """Fields of a delimited line: commas outside quoted fields, and one."""
    bare = F.regexp_replace(line, _QUOTED, "$1")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def ragged_lines(lines: DataFrame) -> DataFrame:
    """(file, line_no, fields, expected): rows of another number of fields than their file's header.

    ``lines`` comes from ``numbered_lines``. The header is the first line that is not blank; blank
    lines are no rows.
    """
    filled = lines.filter(F.length(trim_ws("value")) > 0).withColumn("fields", field_count(F.col("value")))
    header = filled.groupBy("file").agg(F.min(F.struct("line_no", "fields")).alias("h")).select("file", F.col("h.line_no").alias("head"), F.col("h.fields").alias("expected"))
    joined = lookup_join(filled.select("file", "line_no", "fields"), header, ["file"], "inner")
    return joined.filter((F.col("line_no") > F.col("head")) & (F.col("fields") != F.col("expected"))).select("file", "line_no", "fields", "expected")
