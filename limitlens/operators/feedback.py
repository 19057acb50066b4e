"""Promotion of approved feedback to stored examples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from limitlens.functions.text import (
    clean, contains_ignore_case, equals_ignore_case, is_blank, is_sha256_hex, sha256_hex, short_id,
)
from limitlens.operators.rules import RuleSet
from limitlens.operators.scan import blocker_codes, forbidden_checks, macro_checks, sql_checks
from limitlens.plans.joins import lookup_join
from limitlens.plans.reuse import materialized

KEY = ("feedbackId", "taskId")
# What counts as approved, and the mode written to promoted rows.
APPROVED_CODES = ("APPROVED", "ACCEPTED")
APPROVED_STATUSES = ("APPROVED", "REVIEWER_APPROVED", "ReviewerApproved")
PROMOTION_MODE = "ExampleCurationOnly"
# Declared kinds, and the marks an undeclared body is recognised by.
KIND_ALIASES = {"Sql": ("SQL",), "Vba": ("VBA", "Macro"), "General": ("General", "Other", "Text", "Draft")}
SQL_WORDS = ("SELECT", "WITH", "INSERT", "UPDATE", "DELETE", "DROP", "MERGE")
MACRO_MARKS = ("Option Explicit", "Sub ", "Function ", "End Sub", "End Function")


@dataclass(frozen=True)
class Promotion:
    promoted: DataFrame
    skipped: DataFrame
    warnings: DataFrame


def is_approved() -> Column:
    return F.coalesce(
        equals_ignore_case("feedbackCode", *APPROVED_CODES)
        | equals_ignore_case("reviewStatus", *APPROVED_STATUSES),
        F.lit(False),
    )


def body_kind(kind: Column, body: Column) -> Column:
    """Declared kind, else SQL by keyword, else macro by mark, else NULL."""
    declared = clean(kind)
    word = rf"(?iU)(?<![\p{{L}}\p{{Nd}}_])(?:{'|'.join(SQL_WORDS)})(?![\p{{L}}\p{{Nd}}_])"
    macro = F.lit(False)
    for mark in MACRO_MARKS:
        macro = macro | contains_ignore_case(body, mark)
    chain = F.when(equals_ignore_case(declared, *KIND_ALIASES["Sql"]), "Sql")
    for name in ("Vba", "General"):
        chain = chain.when(equals_ignore_case(declared, *KIND_ALIASES[name]), name)
    return chain.when(body.rlike(word), "Sql").when(macro, "Vba")


def first_of_key(df: DataFrame, row_no: str, name: str) -> DataFrame:
    """Row order of the first row per key: a narrow aggregate, whatever the row width."""
    return df.groupBy(*KEY).agg(F.min(row_no).alias(name))


def first_bodies(kept: DataFrame, bodies: DataFrame, row_no: str) -> DataFrame:
    """First draft body of each kept (feedback, task).

    Keys and row order alone are grouped and joined; only then are the texts of exactly
    the wanted rows picked, without a shuffle of all texts where the wanted rows are few.
    """
    first = first_of_key(bodies, row_no, row_no)
    wanted = kept.select(*KEY).join(first, list(KEY))
    return lookup_join(bodies, wanted, [*KEY, row_no], "inner").select(*KEY, "draftBody", "kind")


def promote_approved(
    feedback: DataFrame, bodies: DataFrame | None, rules: RuleSet, promoted_at: Column, row_no: str = "_row_no"
) -> Promotion:
    """Promote each approved (feedback, task) once, with its body where the body is clean.

    ``feedback`` and ``bodies`` carry their arrival order in ``row_no``, unique per table.
    The marked feedback and the gated bodies are written once; all three results read them.
    """
    hashed = is_sha256_hex("userId")
    graded = feedback.withColumn("reason", F.when(~hashed, "USER_NOT_HASHED").when(~is_approved(), "NOT_APPROVED"))
    approved = graded.filter(F.col("reason").isNull())
    first = first_of_key(approved, row_no, "__first")
    # Entries of one key may be a large part of the log: the lookup join splits them.
    marked = materialized(lookup_join(graded, first, KEY, "left").withColumn(
        "reason",
        F.coalesce(
            "reason", F.when(F.col(row_no) != F.col("__first"), F.lit("DUPLICATE"))
        ),
    ).drop("__first"))

    kept = marked.filter(F.col("reason").isNull()).drop("reason")
    skipped = marked.filter(F.col("reason").isNotNull())
    if bodies is None:
        with_body = kept.withColumns({
            "draftBody": F.lit(None).cast("string"), "kind": F.lit(None).cast("string"),
        })
    else:
        drafts = first_bodies(kept, bodies, row_no)
        with_body = kept.join(drafts, list(KEY), "left")
    ok = F.col("body_state") == "STORED"
    # Only bodies that are kept are written.
    gated = materialized(_gate(with_body, rules).withColumn("draftBody", F.when(ok, F.col("draftBody"))))
    body = F.when(ok, F.col("draftBody"))
    promoted = gated.select(
        short_id("example", F.concat_ws("|", *KEY)).alias("exampleId"),
        *KEY,
        promoted_at.cast("timestamp").alias("promotedAt"),
        F.col("userId").alias("userIdHash"),
        "feedbackCode", "reviewStatus",
        F.lit(PROMOTION_MODE).alias("promotionMode"),
        body.alias("exampleBody"),
        F.when(ok, F.col("body_kind")).otherwise("None").alias("exampleBodyKind"),
        F.when(ok, F.length("draftBody")).otherwise(0).alias("exampleBodyLength"),
        F.when(ok, sha256_hex("draftBody")).alias("exampleBodyHash"),
    )
    warnings = _warnings(skipped, gated, bodies, row_no)
    return Promotion(promoted, skipped, warnings)


def _gate(df: DataFrame, rules: RuleSet) -> DataFrame:
    """State of the body: NONE, UNCERTAIN, BLOCKED (with codes) or STORED."""
    text = F.coalesce("draftBody", F.lit(""))
    kind = body_kind(F.coalesce("kind", F.lit("")), text)
    checks = [*sql_checks(text, rules), *macro_checks(text, rules), *forbidden_checks(text)]
    # Codes are computed for every body, outside any condition: what the checks share is then
    # computed once per body.
    scanned = df.withColumns({
        "__blank": is_blank(text), "body_kind": kind, "__codes": blocker_codes(text, checks),
    })
    state = (
        F.when(F.col("__blank"), "NONE").when(F.col("body_kind").isNull(), "UNCERTAIN")
        .when(F.size("__codes") > 0, "BLOCKED").otherwise("STORED")
    )
    codes = F.when(F.col("body_state") == "BLOCKED", F.col("__codes"))
    return scanned.withColumn("body_state", state).withColumn(
        "codes", F.coalesce(codes, F.array().cast("array<string>"))
    ).drop("__blank", "__codes")


def _warnings(skipped: DataFrame, gated: DataFrame, bodies: DataFrame | None, row_no: str) -> DataFrame:
    none = F.array().cast("array<string>")

    def shaped(df: DataFrame, code: Column, codes: Column = none) -> DataFrame:
        return df.select(code.alias("warning"), *KEY, codes.alias("codes"))

    result = shaped(
        skipped.filter(F.col("reason") != "NOT_APPROVED"),
        F.when(F.col("reason") == "DUPLICATE", "DUPLICATE_FEEDBACK").otherwise("USER_NOT_HASHED"),
    ).unionByName(shaped(
        gated.filter(F.col("body_state").isin("UNCERTAIN", "BLOCKED")),
        F.concat(F.lit("BODY_"), F.col("body_state")), F.col("codes"),
    ))
    if bodies is not None:
        extra = bodies.join(first_of_key(bodies, row_no, row_no), [*KEY, row_no], "left_anti")
        result = result.unionByName(shaped(extra, F.lit("DUPLICATE_BODY")))
    return result


def newest_first(examples: DataFrame) -> DataFrame:
    return examples.orderBy(F.desc("promotedAt"), "exampleId")
