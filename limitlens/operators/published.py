"""Reports that appear as a whole, and a record of each.

    <reports>/runs/<folder>/<section>/   the sections of one run, written first
    <reports>/commits/<run>/             a row per base date of the run, written last

Every attempt has a folder of its own, so nothing of a dead one is taken over.

A reader sees the sections of the last committed run of each date. A job that dies in between
leaves a run without commit, which nobody reads. One writer at a time.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from limitlens.operators.report import write_report

_COMMIT = "base_dt string, run long, folder string, sections array<string>"
#: The section that names the dates of a run.
_DATED_BY = "SUMMARY"


def commits(spark: SparkSession, reports: str) -> DataFrame:
    """(base_dt, run, folder, sections) of every published report; none where nothing was published yet."""
    try:
        return spark.read.schema(_COMMIT).parquet(f"{reports}/commits/*")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], _COMMIT)
        raise


def publish(sections: dict[str, DataFrame], reports: str) -> int:
    """Write all sections (see ``report.report_tables``) as one run, then commit its dates; the run's number."""
    spark = sections[_DATED_BY].sparkSession
    last = commits(spark, reports).agg(F.max("run")).first()[0]
    run = 0 if last is None else last + 1
    folder = uuid.uuid4().hex
    write_report(sections, f"{reports}/runs/{folder}")
    dates = spark.read.parquet(f"{reports}/runs/{folder}/{_DATED_BY.lower()}").select(F.col("base_dt").cast("string").alias("base_dt")).distinct()
    names = F.array(*[F.lit(n) for n in sorted(sections)])
    # One file: it is there as a whole or not at all.
    dates.select("base_dt", F.lit(run).cast("long").alias("run"), F.lit(folder).alias("folder"), names.alias("sections")).coalesce(1).write.mode("overwrite").parquet(f"{reports}/commits/{run}")
    return run


def current(spark: SparkSession, reports: str) -> DataFrame:
    """(base_dt, run, folder, sections): the last report of each date."""
    last = commits(spark, reports).groupBy("base_dt").agg(F.max(F.struct("run", "folder", "sections")).alias("c"))
    return last.select("base_dt", "c.*")


def read_section(spark: SparkSession, reports: str, section: str) -> DataFrame:
    """A section of the last report of every date; of the last run that has it where it has no dates."""
    live = current(spark, reports).filter(F.array_contains("sections", section))
    dates: dict[tuple[int, str], list[str]] = {}
    for row in live.select("base_dt", "run", "folder").collect():  # a row per date
        dates.setdefault((row["run"], row["folder"]), []).append(row["base_dt"])
    if not dates:
        raise ValueError(f"no published report holds {section}")
    parts = {key: spark.read.parquet(f"{reports}/runs/{key[1]}/{section.lower()}") for key in sorted(dates)}
    if "base_dt" not in next(iter(parts.values())).columns:
        return parts[max(parts)]
    dated = [df.withColumn("base_dt", F.col("base_dt").cast("string")).filter(F.col("base_dt").isin(dates[key])) for key, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dated)
