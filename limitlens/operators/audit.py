"""Audit history over task and feedback logs, log constraints, operational counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from limitlens import schema as S
from limitlens.functions.text import clean, fold, hash_prefix, is_blank, is_sha256_hex

DEFAULT_ROWS = 200
AUDIT_COLUMNS = (
    "source", "entry_id", "task_id", "created_at", "activity_type", "detail", "result",
    "rule_version", "user_hash_prefix", "request_hash_prefix", "output_hash_prefix",
)
# Fixed value: format of a rule version.
RULE_VERSION = r"\Aruleset-[0-9a-fA-F]{12}\z"
# Suggestion kinds that are hints and cannot be accepted.
HINT_KINDS = ("SAFETYHINT", "BLOCKEDHINT")


def audit_records(task_log: DataFrame, feedback_log: DataFrame) -> DataFrame:
    """Both logs in one 11-column shape."""
    empty = F.lit("")
    tasks = task_log.select(
        F.lit("TaskLog").alias("source"), F.col("taskId").alias("entry_id"),
        F.col("taskId").alias("task_id"), F.col("createdAt").alias("created_at"),
        F.col("taskType").alias("activity_type"), F.col("toolType").alias("detail"),
        F.col("safetyResult").alias("result"), F.col("ruleVersion").alias("rule_version"),
        hash_prefix("userId").alias("user_hash_prefix"),
        hash_prefix("requestHash").alias("request_hash_prefix"),
        hash_prefix("outputHash").alias("output_hash_prefix"),
    )
    feedback = feedback_log.select(
        F.lit("FeedbackLog").alias("source"), F.col("feedbackId").alias("entry_id"),
        F.col("taskId").alias("task_id"), F.col("createdAt").alias("created_at"),
        F.col("feedbackCode").alias("activity_type"), F.lit("Feedback").alias("detail"),
        F.col("reviewStatus").alias("result"), empty.alias("rule_version"),
        hash_prefix("userId").alias("user_hash_prefix"),
        empty.alias("request_hash_prefix"), empty.alias("output_hash_prefix"),
    )
    return tasks.unionByName(feedback)


def audit_history(task_log: DataFrame, feedback_log: DataFrame, n: int = DEFAULT_ROWS) -> DataFrame:
    """Newest ``n`` records; every task keeps its own newest n, one merges them.

    Records of one instant and source keep file order in a single log; over many files the
    entry id decides instead.
    """
    if n <= 0:
        raise ValueError("at least one row must be asked for")
    order = [F.desc("created_at"), F.asc("source"), F.asc("entry_id")]
    return audit_records(task_log, feedback_log).orderBy(*order).limit(n)


# --- constraints before appending ----------------------------------------------------------

def _violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    failed = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in checks.items()])
    return df.withColumn("violations", F.array_compact(failed))


def _filled(name: str) -> Column:
    return ~is_blank(name)


def check_task_log(df: DataFrame) -> DataFrame:
    """Task records with the constraints each one breaks in ``violations``."""
    return _violations(df, {
        "taskId": _filled("taskId"),
        "userId": is_sha256_hex("userId"),
        "requestHash": is_sha256_hex("requestHash"),
        "outputHash": F.col("outputHash").isNull() | is_sha256_hex("outputHash"),
        "ruleVersion": F.col("ruleVersion").rlike(RULE_VERSION),
    })


def check_feedback_log(df: DataFrame) -> DataFrame:
    return _violations(df, {
        "feedbackId": _filled("feedbackId"),
        "taskId": _filled("taskId"),
        "userId": is_sha256_hex("userId"),
    })


def check_suggestion_log(df: DataFrame) -> DataFrame:
    return _violations(df, {
        "suggestionId": is_sha256_hex("suggestionId"),
        "providerId": _filled("providerId"),
        "kind": ~fold(clean("kind")).isin(*HINT_KINDS),
        "mode": _filled("mode"),
        "userHash": is_sha256_hex("userHash"),
        "insertTextHash": is_sha256_hex("insertTextHash"),
        "acceptedAtUtc": F.col("acceptedAtUtc").isNotNull(),
    })


def check_promoted_examples(df: DataFrame) -> DataFrame:
    """Stored examples: length and hash agree with the body, or all of it is absent."""
    body = F.col("exampleBody")
    absent = body.isNull() & (F.col("exampleBodyLength") == 0) & F.col("exampleBodyHash").isNull()
    return _violations(df, {
        "exampleId": _filled("exampleId"),
        "feedbackId": _filled("feedbackId"),
        "userIdHash": is_sha256_hex("userIdHash"),
        "exampleBodyLength": absent | (F.length(body) == F.col("exampleBodyLength")),
        "exampleBodyHash": absent | (F.sha2(body.cast("binary"), 256) == F.col("exampleBodyHash")),
    })


def log_findings(log: DataFrame, source: str) -> DataFrame:
    """Unreadable lines of a scanned log, as one counted finding."""
    bad = log.agg(
        F.count_if(F.col("_corrupt_record").isNotNull()).alias("bad_lines"), F.count("*").alias("all_lines")
    )
    return bad.filter("bad_lines > 0").select(
        F.lit(source).alias("source"),
        S.finding("AUDIT_LOG_LINE_INVALID", "Low").alias("f"), "bad_lines",
    ).select("source", "f.code", "f.severity", "bad_lines")


def dashboard_counters(records: DataFrame, examples: DataFrame, reports: DataFrame) -> DataFrame:
    """Audit records, promoted examples and reports: the dates of ``reports``, e.g. ``published.commits``."""
    def counted(df: DataFrame, metric: str, column: Column) -> DataFrame:
        return df.agg(column.alias("value")).select(F.lit(metric).alias("metric"), "value")

    return (
        counted(records, "Audit Records", F.count("*"))
        .unionByName(counted(examples, "Promoted Examples", F.count("*")))
        .unionByName(counted(reports, "Reports", F.count_distinct("base_dt")))
    )
