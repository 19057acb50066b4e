"""Append arriving log files to the checked log.

The batch scan of ``sources.logs`` on a stream: stateless, so no watermark is needed. The
file sink commits each micro-batch exactly once; refused and unreadable lines go to a
quarantine query of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from limitlens.sources.logs import CORRUPT, LOGS, parse_lines


def stream_log(spark: SparkSession, path: str, kind: str, files_per_batch: int = 1000) -> DataFrame:
    """Lines of log files as they arrive below ``path``."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return parse_lines(lines, kind)


def append_stream(
    lines: DataFrame, kind: str, target: str, quarantine: str, checkpoint: str, once: bool = False
) -> tuple[StreamingQuery, StreamingQuery]:
    """Start both queries. ``once`` handles what has arrived and stops."""
    checked = LOGS[kind][1](lines)
    refused = (F.size("violations") > 0) | F.col(CORRUPT).isNotNull()

    def start(df: DataFrame, path: str, name: str) -> StreamingQuery:
        writer = df.writeStream.format("json").outputMode("append").option(
            "checkpointLocation", f"{checkpoint}/{name}"
        ).option("path", path)
        return writer.trigger(availableNow=True).start() if once else writer.start()

    good = start(checked.filter(~refused).drop("violations", CORRUPT), target, "good")
    bad = start(checked.filter(refused), quarantine, "refused")
    return good, bad
