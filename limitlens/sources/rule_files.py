"""Rule files: one pattern or name per line, # comments, REQUIRE_PRESENT: prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from limitlens.functions.text import clean, fold, short_id
from limitlens.operators import rules as R
from limitlens.plans.local import local_table


def _file_name() -> Column:
    return F.col("_metadata.file_name")


def read_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rules table of a folder of rule files."""
    return rules_of_lines(spark.read.text(folder).select(
        _file_name().alias("file"), "value",
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"),
    ))


def rules_of_lines(lines: DataFrame) -> DataFrame:
    """Rules table of lines: ``file`` (its name), ``value`` and ``at``, the order within a file."""
    pairs = [F.lit(x) for item in R.RULE_FILES.items() for x in item]
    lines = lines.select("file", clean("value").alias("line"), "at")
    active = lines.filter((F.col("line") != "") & ~F.startswith("line", F.lit("#"))).withColumn(
        "file_group", F.create_map(*pairs)[F.col("file")]
    ).filter(F.col("file_group").isNotNull())
    required = (F.col("file_group") == R.MACRO_WARN) & F.startswith(fold("line"), F.lit(R.REQUIRE_PREFIX))
    rows = active.select(
        F.when(required, R.MACRO_REQUIRED).otherwise(F.col("file_group")).alias("group"),
        F.col("at").alias("rule_no"),
        F.when(required, clean(F.substr("line", F.lit(len(R.REQUIRE_PREFIX) + 1))))
        .otherwise(F.col("line")).alias("pattern"),
    )
    return R.with_code(rows)


def rule_version(spark: SparkSession, folder: str) -> DataFrame:
    """Version of the rule files: a hash over names and contents in name order.

    One row; the files are the handful named in ``rules.RULE_FILES``. Scans skip files of no
    bytes, so a file not seen counts as empty.
    """
    return version_of(spark.read.format("binaryFile").load(folder).select(
        _file_name().alias("file"), F.col("content").cast("string").alias("content")
    ))


def version_of(contents: DataFrame) -> DataFrame:
    """Version of rule files given as ``file`` (its name) and ``content``."""
    expected = local_table(contents.sparkSession, [(name,) for name in R.RULE_FILES], "file string")
    found = contents.select("file", F.regexp_replace("content", "\\A\ufeff", "").alias("content"))
    files = expected.join(found, "file", "left").withColumn("content", F.coalesce("content", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct(fold("file").alias("key"), "file", "content")))
    joined = F.array_join(
        F.transform(ordered, lambda f: F.concat(f.getField("file"), F.lit("\n"), f.getField("content"), F.lit("\n"))), ""
    )
    return files.agg(short_id("ruleset", joined).alias("rule_version"))


def load_rule_set(spark: SparkSession, folder: str) -> R.RuleSet:
    """Rule set of a folder; a mandatory group without a rule is an error.

    Rules whose pattern does not compile are left out (``rules.pattern_findings`` names them);
    a mandatory group of such rules only takes its default rules.
    """
    version = rule_version(spark, folder).first()["rule_version"]
    return R.RuleSet.from_table(R.usable_rules(read_rules(spark, folder)), version)
