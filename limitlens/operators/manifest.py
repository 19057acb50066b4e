"""Dataset manifest audit and corpus guard over file trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from limitlens.functions.text import contains_ignore_case, fold, is_blank
from limitlens.plans.local import local_table

# File-name and content tokens of source text that may not be stored.
NAME_TOKENS = (
    "internal_rule_original", "internal_regulation_original", "ncr_official_original",
    "clause_original", "official_text", "full_text",
)
CONTENT_TOKENS = ("내부규정 원문", "NCR 공식본 원문", "조항 원문", "official text", "full text")
# Files whose content is read.
TEXT_SUFFIXES = (".csv", ".json", ".jsonl", ".md", ".txt", ".sql")


def relative_path(root: str, path: Column) -> Column:
    """Path below ``root``, with forward slashes and without a scheme."""
    plain = F.regexp_replace(path, r"\A[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")
    base = root.split("://", 1)[-1] if "://" in root else root.removeprefix("file:")
    base = base.rstrip("/") + "/"
    slashed = F.replace(F.url_decode(plain), F.lit("\\"), F.lit("/"))
    return F.when(F.startswith(slashed, F.lit(base)), F.substr(slashed, F.lit(len(base) + 1))).otherwise(slashed)


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Path, size and SHA-256 of every file below ``root``; files are hashed in parallel.

    A file is one value here: files may have up to 2 GB.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(
        relative_path(root, F.col("path")).alias("path"), F.col("length").alias("actual_size"),
        F.sha2("content", 256).alias("actual_sha256"),
    )


def unsafe_path(path: Column) -> Column:
    """Rooted, drive, UNC or parent-traversing paths."""
    return path.rlike(r"\A[/\\]|\A[A-Za-z]:") | F.contains(path, F.lit(".."))


def manifest_audit(
    manifest: DataFrame, inventory: DataFrame, required: Sequence[str] = (), watched: Column | None = None,
) -> DataFrame:
    """Problems between a manifest and the files found.

    ``manifest`` has path, size, sha256, class, required. ``required`` paths must be declared
    and present whatever the manifest says; files for which ``watched`` holds (a condition on
    ``path``) must be declared. A manifest without entries is a problem of its own, so it
    fails closed. Columns: problem, path, class.
    """
    spark = manifest.sparkSession
    entry_class = F.when(is_blank("class"), "App").otherwise(F.col("class"))
    entries = manifest.withColumn("class", entry_class)
    usable = entries.filter(~is_blank("path") & ~unsafe_path(F.col("path")))
    rejected = entries.filter(is_blank("path") | unsafe_path(F.col("path"))).select(
        F.when(is_blank("path"), "PATH_EMPTY").otherwise("PATH_UNSAFE").alias("problem"),
        F.coalesce("path", F.lit("")).alias("path"), "class",
    )
    must = F.col("path").isin(list(required)) if required else F.lit(False)
    seen = watched if watched is not None else F.lit(False)
    both = usable.withColumn("declared", F.lit(True)).join(
        inventory.withColumn("found", F.lit(True)), "path", "full"
    )
    declared, found = F.col("declared").isNotNull(), F.col("found").isNotNull()
    problems = F.array_compact(F.array(
        F.when(declared & ~found & (F.coalesce("required", F.lit(False)) | must | seen), F.lit("FILE_MISSING")),
        F.when(declared & found & (F.lower("actual_sha256") != F.lower(F.coalesce("sha256", F.lit("")))),
               F.lit("HASH_MISMATCH")),
        F.when(declared & found & (F.col("actual_size") != F.coalesce("size", F.lit(-1))), F.lit("SIZE_MISMATCH")),
        F.when(~declared & found & seen, F.lit("FILE_UNDECLARED")),
    ))
    result = rejected.unionByName(both.select(
        F.explode(problems).alias("problem"), "path", F.coalesce("class", F.lit("App")).alias("class")
    ))
    nothing = manifest.agg(F.count("*").alias("n")).filter("n = 0")
    result = result.unionByName(nothing.select(
        F.lit("MANIFEST_EMPTY").alias("problem"), F.lit("").alias("path"), F.lit("App").alias("class")
    ))
    if required:
        wanted = local_table(spark, [(p,) for p in required], "path string")
        result = result.unionByName(
            wanted.join(entries.select("path"), "path", "left_anti").select(
                F.lit("ENTRY_MISSING").alias("problem"), "path", F.lit("App").alias("class")
            )
        )
    return result


def manifest_result(problems: DataFrame) -> DataFrame:
    """OK or FAIL_CLOSED with the classes blocked."""
    return problems.agg(
        F.count("*").alias("problem_count"), F.array_sort(F.collect_set("class")).alias("blocked_classes")
    ).select(
        F.when(F.col("problem_count") == 0, "OK").otherwise("FAIL_CLOSED").alias("status"),
        "problem_count", "blocked_classes",
    )


def corpus_guard(spark: SparkSession, root: str, allowed: Sequence[str] = ()) -> DataFrame:
    """Files below ``root`` whose name or content looks like protected source text.

    Text files are read by line, so large ones are split over tasks; no token spans lines.
    """
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    globs = "{" + ",".join("*" + _any_case(s) for s in TEXT_SUFFIXES) + "}"
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", globs).text(root)
    return guarded(
        names.select(relative_path(root, F.col("path")).alias("path")),
        lines.select(relative_path(root, F.col("_metadata.file_path")).alias("path"), "value"),
        allowed,
    )


def guarded(paths: DataFrame, lines: DataFrame, allowed: Sequence[str] = ()) -> DataFrame:
    """The guard over a table of paths and one of lines (``path``, ``value``) of text files."""
    def listed(df: DataFrame) -> DataFrame:
        keep = ~fold("path").isin([a.upper() for a in allowed]) if allowed else F.lit(True)
        return df.filter(keep)

    def any_of(value: Column, tokens: Sequence[str]) -> Column:
        found = F.lit(False)
        for token in tokens:
            found = found | contains_ignore_case(value, token)
        return found

    by_name = listed(paths.select("path")).filter(any_of(F.col("path"), NAME_TOKENS))
    by_content = listed(lines).filter(any_of(F.col("value"), CONTENT_TOKENS)).select("path")
    return by_name.union(by_content).distinct().select(
        F.lit("KB_FORBIDDEN_SOURCE_TEXT").alias("code"), F.lit("Blocker").alias("severity"), "path"
    )


def _any_case(suffix: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
