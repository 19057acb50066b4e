"""Line-delimited JSON logs: scans that keep bad lines, appends that refuse bad records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from limitlens.functions.text import is_blank
from limitlens.operators import audit
from limitlens.schema import FEEDBACK_LOG, PROMOTED_EXAMPLE, SUGGESTION_LOG, TASK_LOG

CORRUPT = "_corrupt_record"
Check = Callable[[DataFrame], DataFrame]

# Each log: its schema and the constraints a record must meet.
LOGS: dict[str, tuple[T.StructType, Check]] = {
    "task": (TASK_LOG, audit.check_task_log),
    "feedback": (FEEDBACK_LOG, audit.check_feedback_log),
    "suggestion": (SUGGESTION_LOG, audit.check_suggestion_log),
    "promoted_example": (PROMOTED_EXAMPLE, audit.check_promoted_examples),
}


def scan_schema(kind: str) -> T.StructType:
    schema = LOGS[kind][0]
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


def parse_lines(lines: DataFrame, kind: str) -> DataFrame:
    """Records of a text table with one JSON document per line; blank lines are skipped.

    An unreadable line keeps its text in ``_corrupt_record`` and has no other value.
    """
    record = F.from_json("value", scan_schema(kind), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    parsed = lines.filter(~is_blank("value")).select("value", record.alias("r"))
    names = [f.name for f in LOGS[kind][0].fields]
    bad = F.when(F.col("r").isNull(), F.col("value")).otherwise(F.col(f"r.{CORRUPT}"))
    return parsed.select(
        *[F.when(bad.isNull(), F.col(f"r.{n}")).alias(n) for n in names], bad.alias(CORRUPT)
    )


def read_log(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """All lines of a log."""
    return parse_lines(spark.read.text(path), kind)


def records(log: DataFrame) -> DataFrame:
    """The readable records."""
    return log.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def split(df: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Valid records, and refused ones with the constraints they break."""
    checked = LOGS[kind][1](df)
    bad = F.size("violations") > 0
    return checked.filter(~bad).drop("violations"), checked.filter(bad)


def append_log(df: DataFrame, path: str, kind: str, quarantine: str | None = None) -> None:
    """Append records as JSON lines.

    With a quarantine folder refused records are written there; without one a refused
    record fails the job and nothing of it is committed.
    """
    good, bad = split(df, kind)
    if quarantine is not None:
        bad.write.mode("append").json(quarantine)
        good.write.mode("append").json(path)
        return
    checked = LOGS[kind][1](df)
    stop = F.raise_error(
        F.concat(F.lit(f"{kind} log: "), F.array_join("violations", ", "))
    ).cast("boolean")
    checked.filter(F.when(F.size("violations") > 0, stop).otherwise(True)).drop("violations").write.mode(
        "append"
    ).json(path)
