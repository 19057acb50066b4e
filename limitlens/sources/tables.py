"""Delimited tables: header checks, encodings, ragged and blank rows, standard layout."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from limitlens.functions.text import WHITE_SPACE, clean, trim_ws

CORRUPT = "_corrupt_record"
ROW_NO = "_row_no"
AUTO, UTF8, CP949 = "auto", "utf8", "cp949"
_REPLACEMENT = "\ufffd"


class TableError(ValueError):
    """The file cannot be read as a table."""


def check_header(names: list[str]) -> list[str]:
    """Trimmed column names; blank or repeated names are refused."""
    header = [n.lstrip("\ufeff").strip(WHITE_SPACE) if i == 0 else n.strip(WHITE_SPACE) for i, n in enumerate(names)]
    if not header or any(not n for n in header):
        raise TableError("the header has a blank column name")
    if len({n.upper() for n in header}) != len(header):
        raise TableError("the header has a repeated column name")
    return header


def file_encodings(spark: SparkSession, path: str) -> DataFrame:
    """Whether each file below ``path`` is valid UTF-8 and whether it is plain ASCII, decided
    line by line in parallel."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return lines.groupBy("file").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("valid_utf8"),
        F.bool_and(~F.col("value").rlike(r"[^\x00-\x7F]")).alias("ascii"),
    )


def _charset(spark: SparkSession, path: str, encoding: str) -> str:
    if encoding == CP949:
        return CP949
    verdict = file_encodings(spark, path).agg(
        F.count_if(F.col("valid_utf8") & ~F.col("ascii")).alias("good"), F.count_if(~F.col("valid_utf8")).alias("bad")
    ).first()
    if encoding == UTF8:
        if verdict["bad"]:
            raise TableError("the file is not valid UTF-8")
        return UTF8
    if verdict["bad"] and verdict["good"]:
        # ASCII files read alike in both and count for neither; a folder must not mix the two.
        raise TableError("the folder mixes encodings; read it in parts with an explicit encoding")
    return CP949 if verdict["bad"] else UTF8


def _options(spark: SparkSession, charset: str) -> dict[str, str]:
    options = {
        "header": "true", "quote": '"', "escape": '"', "mode": "PERMISSIVE",
        # Empty fields stay empty text; nothing is read as NULL.
        "emptyValue": "", "nullValue": "\u0001",
        # Ragged rows are only seen when all columns are parsed.
        "columnPruning": "false", "columnNameOfCorruptRecord": CORRUPT,
        "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
        # The header of every file is compared with the first one's; another order is an error.
        "enforceSchema": "false",
    }
    if charset == CP949:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
        options["encoding"] = "MS949"
    return options


def read_table(spark: SparkSession, path: str, encoding: str = AUTO) -> DataFrame:
    """Lazy scan of one delimited file or a folder of files with one header.

    All columns are text, values as written. ``_corrupt_record`` holds the line of a ragged
    row (missing fields are empty, extra ones dropped), ``_row_no`` orders the rows. Blank
    rows are left out. A file whose header differs from the first one's stops the job. ``auto`` and ``utf8`` check the bytes first, in one pass; pass
    ``cp949`` or use ``read_checked`` for input whose encoding is known.
    """
    if encoding not in (AUTO, UTF8, CP949):
        raise ValueError(f"unknown encoding {encoding!r}")
    return _scan(spark, path, _charset(spark, path, encoding))


def read_checked(spark: SparkSession, path: str) -> DataFrame:
    """The same scan for input known to be UTF-8: no pass over the bytes."""
    return _scan(spark, path, UTF8)


def _scan(spark: SparkSession, path: str, charset: str) -> DataFrame:
    options = _options(spark, charset)
    written = _header(spark, path, charset)
    header = check_header(written)
    fields = [T.StructField(n, T.StringType()) for n in written]
    schema = T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])
    raw = spark.read.options(**options).schema(schema).csv(path)
    values = [F.coalesce(F.col(f"`{n.replace('`', '``')}`"), F.lit("")) for n in written]
    if charset == CP949:
        values = [_strict(v) for v in values]
    rows = raw.select(
        *[v.alias(n) for v, n in zip(values, header)],
        CORRUPT,
        row_position().alias(ROW_NO),
    )
    return rows.filter(~blank_row(header))


def row_position() -> Column:
    """Order of a row: file, block within the file, row within the block."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def blank_row(names: list[str]) -> Column:
    blank = F.lit(True)
    for name in names:
        blank = blank & (F.length(trim_ws(F.col(f"`{name}`"))) == 0)
    return blank


def _strict(value: Column) -> Column:
    """Undecodable bytes stop the job; the decoder marks them with U+FFFD, which CP949 lacks."""
    failed = F.raise_error(F.lit("the file is not valid CP949")).cast("string")
    return F.when(F.contains(value, F.lit(_REPLACEMENT)), failed).otherwise(value)


def _header(spark: SparkSession, path: str, charset: str) -> list[str]:
    """Header, as written, of the first file that has one, read by a scan that stops at the
    first line."""
    reader = spark.read.option("header", "false").option("quote", "\u0000").option("sep", "\u0001")
    if charset == CP949:
        reader = reader.option("encoding", "MS949")
    first = reader.schema("line string").csv(path).filter(F.length(clean("line")) > 0).first()
    if first is None:
        raise TableError("the file has no header")
    return next(csv.reader(io.StringIO(first["line"].lstrip("\ufeff"))))


def write_standard(df: DataFrame, path: str, partition: str, mode: str = "append") -> None:
    """Store a scanned table trimmed and partitioned by its base date.

    Later jobs read columns and partitions they need only (``limits.bind(..., trimmed=True)``).
    Rows are rebalanced by date before writing: files come out near the advisory size, and
    a date holding a third of all rows is split over many tasks.
    """
    names = [c for c in df.columns if c not in (CORRUPT, ROW_NO)]
    tidy = df.select(*[clean(F.col(f"`{c}`")).alias(c) for c in names])
    tidy.hint("rebalance", F.col(f"`{partition}`")).write.mode(mode).partitionBy(partition).parquet(path)


def read_standard(spark: SparkSession, path: str) -> DataFrame:
    """A stored table. All columns are text, base dates too, though they are folder names."""
    names = spark.read.parquet(path).columns
    return spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).parquet(path)
