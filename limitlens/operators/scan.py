"""Rule scans over text columns.

A scan is a projection: every rule becomes an expression over the text, and the rules that
match become an array on the row. Texts are not shuffled, joined or copied per rule.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from limitlens import schema as S
from limitlens.functions.found import explode_rows, found_array
from limitlens.functions.text import (
    call_pattern, fold, is_blank, may_match, regex_absent,
    regex_match, regex_position,
)
from limitlens.operators import rules as R

FINDINGS = "findings"
FINDING = "struct<code:string,severity:string,severity_rank:int,message:string,matched:string,position:int>"

# Tokens that may not be stored, and the resident-number pattern.
FORBIDDEN_TERMS = (
    "INTERNAL_REGULATION_ORIGINAL", "NCR_OFFICIAL_ORIGINAL", "REAL_CUSTOMER_DATA",
    "REAL_ACCOUNT_NUMBER", "REAL_TABLE_NAME", "REAL_COLUMN_NAME",
    "PRODUCTION_CONNECTION_STRING", "MODEL_WEIGHT_FILE",
)
RESIDENT_NUMBER = r"(?<!\d)\d{6}-[1-4]\d{6}(?!\d)"
_SELECT = r"\bSELECT\b"


def _found(
    code: str, severity: str, message: str,
    matched: Column | None = None, position: Column | None = None,
) -> Column:
    return F.struct(
        F.lit(code).alias("code"),
        F.lit(severity).alias("severity"),
        F.lit(S.SEVERITY_RANK[severity]).alias("severity_rank"),
        F.lit(message).alias("message"),
        (F.lit(None).cast("string") if matched is None else matched).alias("matched"),
        (F.lit(None).cast("int") if position is None else position).alias("position"),
    )


@dataclass(frozen=True)
class Check:
    """A finding and when it applies. ``cheap`` is tested first and rules most texts out."""

    cheap: Column
    holds: Column
    code: str
    severity: str
    message: str
    matched: Column | None = None
    position: Column | None = None

    @property
    def finding(self) -> Column:
        return _found(self.code, self.severity, self.message, self.matched, self.position)


def pattern_checks(text: Column, rules: Sequence[R.Rule]) -> list[Check]:
    """First match of each rule."""
    checks = []
    for rule in rules:
        position = regex_position(text, rule.pattern)
        checks.append(Check(
            may_match(text, rule.pattern, rule.needs), position >= 0, rule.code, rule.severity, rule.message,
            regex_match(text, rule.pattern), position,
        ))
    return checks


def sql_checks(text: Column, rules: R.RuleSet) -> list[Check]:
    checks = pattern_checks(text, rules.of(R.SQL_DENY, R.SQL_WARN))
    absent = ~may_match(text, _SELECT) | (regex_position(text, _SELECT) < 0)
    return [*checks, Check(F.lit(True), absent, "SQL_NO_SELECT", "Medium", "text holds no SELECT")]


def macro_checks(text: Column, rules: R.RuleSet) -> list[Check]:
    checks = pattern_checks(text, rules.of(R.MACRO_DENY, R.MACRO_WARN))
    for rule in rules.of(R.MACRO_REQUIRED):
        absent = ~may_match(text, rule.pattern) | regex_absent(text, rule.pattern)
        checks.append(Check(F.lit(True), absent, rule.code, rule.severity, rule.message))
    return checks


def formula_checks(text: Column, rules: R.RuleSet) -> list[Check]:
    return pattern_checks(text, [
        R.Rule(r.group, r.code, call_pattern(r.pattern), r.severity, f"{r.pattern} is not available")
        for r in rules.of(R.BLOCKED_FUNCTION)
    ])


def forbidden_checks(text: Column) -> list[Check]:
    upper = fold(text)
    checks = [
        Check(
            F.contains(upper, F.lit(term)), F.lit(True), "FEEDBACK_FORBIDDEN_TERM", "Blocker", "forbidden token",
            F.lit(term), F.instr(upper, F.lit(term)) - 1,
        )
        for term in FORBIDDEN_TERMS
    ]
    number = regex_position(text, RESIDENT_NUMBER)
    return [*checks, Check(
        F.contains(text, F.lit("-")), number >= 0, "FEEDBACK_PII_PATTERN", "Blocker", "personal number pattern",
        F.lit("RRN_PATTERN"), number,
    )]


def _findings(text: Column, empty: Column | None, checks: list[Check]) -> Column:
    """Findings of the text; a blank text has only ``empty``.

    Every check is one flat condition, so that the parts they share (the upper-cased text,
    the blank test) are computed once per row.
    """
    filled = ~is_blank(text)
    found = [(c.cheap & filled & c.holds, c.finding) for c in checks]
    if empty is not None:
        found.insert(0, (~filled, empty))
    return found_array(found, FINDING)


def blocker_codes(text: Column, checks: Sequence[Check]) -> Column:
    """Sorted distinct codes of the Blocker checks that hold; the others are not evaluated."""
    filled = ~is_blank(text)
    codes = found_array(
        [(c.cheap & filled & c.holds, F.lit(c.code)) for c in checks if c.severity == "Blocker"], "string"
    )
    return F.sort_array(F.array_distinct(codes))


def sql_findings(text: Column, rules: R.RuleSet) -> Column:
    """Denied and warned patterns of SQL text; text without SELECT is reported."""
    return _findings(text, _found("SQL_EMPTY", "Low", "SQL text is empty"), sql_checks(text, rules))


def macro_findings(text: Column, rules: R.RuleSet) -> Column:
    """Denied and warned patterns of macro text, and required patterns that are absent."""
    return _findings(text, _found("VBA_EMPTY", "Low", "macro text is empty"), macro_checks(text, rules))


def formula_findings(text: Column, rules: R.RuleSet) -> Column:
    """Calls of blocked functions."""
    return _findings(text, None, formula_checks(text, rules))


def forbidden_findings(text: Column) -> Column:
    """Forbidden tokens and resident numbers; the number itself is not repeated."""
    return _findings(text, None, forbidden_checks(text))


def with_findings(df: DataFrame, findings: Column) -> DataFrame:
    return df.withColumn(FINDINGS, findings)


def scan(df: DataFrame, text: str, rules: Sequence[R.Rule]) -> DataFrame:
    """Rows with their findings for any list of pattern rules."""
    column = F.col(text)
    return with_findings(df, _findings(column, None, pattern_checks(column, rules)))


def finding_rows(scanned: DataFrame, ids: Sequence[str]) -> DataFrame:
    """One row per finding."""
    return explode_rows(scanned, ids, FINDINGS, "f").select(*ids, "f.*")


def safety_result(scanned: DataFrame, ids: Sequence[str]) -> DataFrame:
    """BLOCKED, REVIEW_REQUIRED or PASS of every row, decided on the row itself."""
    worst = F.array_max(F.transform(FINDINGS, lambda f: f.getField("severity_rank")))
    return scanned.select(*ids, result_of(worst).alias("safety_result"))


def result_of(worst_rank: Column) -> Column:
    return (
        F.when(worst_rank >= S.SEVERITY_RANK["Blocker"], "BLOCKED")
        .when(worst_rank >= S.SEVERITY_RANK["High"], "REVIEW_REQUIRED")
        .otherwise("PASS")
    )


def safety_result_of_findings(findings: DataFrame, ids: Sequence[str]) -> DataFrame:
    """The same roll-up from a table of findings."""
    return findings.groupBy(*ids).agg(
        result_of(F.max("severity_rank")).alias("safety_result")
    )


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    """Findings of a severity or above."""
    return findings.filter(F.col("severity_rank") >= S.SEVERITY_RANK[severity])
