"""Codes, severities and table schemas shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# --- fixed values: status codes, in their defined order -----------------------------------
NORMAL = "NORMAL"
WARNING = "WARNING"
BREACH = "BREACH"
NO_LIMIT = "NO_LIMIT"
INVALID_LIMIT = "INVALID_LIMIT"
MAPPING_ERROR = "MAPPING_ERROR"
DUPLICATE_LIMIT = "DUPLICATE_LIMIT"
STATUSES = (NORMAL, WARNING, BREACH, NO_LIMIT, INVALID_LIMIT, MAPPING_ERROR, DUPLICATE_LIMIT)
NUMERIC_STATUSES = (NORMAL, WARNING, BREACH)

# --- fixed values: reconciliation checks, in their defined order --------------------------
RECON_EXPOSURE_NO_LIMIT = "RECON_EXPOSURE_NO_LIMIT"
RECON_LIMIT_NO_EXPOSURE = "RECON_LIMIT_NO_EXPOSURE"
RECON_DUPLICATE_LIMIT = "RECON_DUPLICATE_LIMIT"
RECON_BASEDATE_MISMATCH = "RECON_BASEDATE_MISMATCH"
RECON_CURRENCY_MISMATCH = "RECON_CURRENCY_MISMATCH"
RECON_UNIT_MISMATCH = "RECON_UNIT_MISMATCH"
RECON_NONPOSITIVE_LIMIT = "RECON_NONPOSITIVE_LIMIT"
RECON_ROW_AMPLIFICATION = "RECON_ROW_AMPLIFICATION"
RECON_SUM_BALANCE = "RECON_SUM_BALANCE"
RECON_CODES = (
    RECON_EXPOSURE_NO_LIMIT,
    RECON_LIMIT_NO_EXPOSURE,
    RECON_DUPLICATE_LIMIT,
    RECON_BASEDATE_MISMATCH,
    RECON_CURRENCY_MISMATCH,
    RECON_UNIT_MISMATCH,
    RECON_NONPOSITIVE_LIMIT,
    RECON_ROW_AMPLIFICATION,
    RECON_SUM_BALANCE,
)
# The checks that fail the reconciliation are chosen by code, whatever their severity.
RECON_FAIL_CODES = (RECON_NONPOSITIVE_LIMIT, RECON_ROW_AMPLIFICATION, RECON_SUM_BALANCE)

# --- fixed values: severities, lowest first ------------------------------------------------
SEVERITIES = ("Info", "Low", "Medium", "High", "Blocker")
SEVERITY_RANK = {name: rank for rank, name in enumerate(SEVERITIES)}

# --- fixed values: movement classes of the two-date comparison -----------------------------
MOVEMENTS = ("New", "Resolved", "StateTransition", "Increased", "Decreased", "Unchanged")

# 29 integer digits and nine decimals; what is finer is in a FINE column beside it. Arithmetic on
# the full width drops decimals in Spark:
# ``functions.numbers`` compares, subtracts and divides amounts without that.
AMOUNT = T.DecimalType(38, 9)
# Tenth to 28th decimal of an amount, as a whole number; NULL where zero.
FINE = T.DecimalType(20, 0)
RATIO = T.DecimalType(38, 16)
REMAINING = AMOUNT

STATUS_COLUMNS = (
    "base_dt", "desk_cd", "portfolio_id", "product_type", "risk_factor", "ccy_cd",
    "exposure_amt", "limit_amt", "usage_ratio", "remaining_limit", "status", "note",
)

TASK_LOG = T.StructType([
    T.StructField("taskId", T.StringType()),
    T.StructField("createdAt", T.TimestampType()),
    T.StructField("userId", T.StringType()),
    T.StructField("taskType", T.StringType()),
    T.StructField("toolType", T.StringType()),
    T.StructField("requestHash", T.StringType()),
    T.StructField("outputHash", T.StringType()),
    T.StructField("safetyResult", T.StringType()),
    T.StructField("ruleVersion", T.StringType()),
])

FEEDBACK_LOG = T.StructType([
    T.StructField("feedbackId", T.StringType()),
    T.StructField("taskId", T.StringType()),
    T.StructField("createdAt", T.TimestampType()),
    T.StructField("userId", T.StringType()),
    T.StructField("feedbackCode", T.StringType()),
    T.StructField("reviewStatus", T.StringType()),
])

SUGGESTION_LOG = T.StructType([
    T.StructField("suggestionId", T.StringType()),
    T.StructField("providerId", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("mode", T.StringType()),
    T.StructField("userHash", T.StringType()),
    T.StructField("insertTextHash", T.StringType()),
    T.StructField("acceptedAtUtc", T.TimestampType()),
])

PROMOTED_EXAMPLE = T.StructType([
    T.StructField("exampleId", T.StringType()),
    T.StructField("feedbackId", T.StringType()),
    T.StructField("taskId", T.StringType()),
    T.StructField("promotedAt", T.TimestampType()),
    T.StructField("userIdHash", T.StringType()),
    T.StructField("feedbackCode", T.StringType()),
    T.StructField("reviewStatus", T.StringType()),
    T.StructField("promotionMode", T.StringType()),
    T.StructField("exampleBody", T.StringType()),
    T.StructField("exampleBodyKind", T.StringType()),
    T.StructField("exampleBodyLength", T.IntegerType()),
    T.StructField("exampleBodyHash", T.StringType()),
])


def severity_of(rank: Column) -> Column:
    """Severity name of a numeric rank."""
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), rank + F.lit(1))


def finding(code: str, severity: str, message: Column | str = "") -> Column:
    """One (code, severity, severity_rank, message) struct."""
    text = message if isinstance(message, Column) else F.lit(message)
    return F.struct(
        F.lit(code).alias("code"),
        F.lit(severity).alias("severity"),
        F.lit(SEVERITY_RANK[severity]).alias("severity_rank"),
        text.alias("message"),
    )
