"""Rule scans where the rules are a table of any length.

The plan does not grow with the rules. Each rule brings literal factors of its pattern; a text
meets only the rules one of whose factors it contains, and the pattern, taken from the rule's
row, decides there. Rules without a factor meet every text. Rules of plain patterns (``functions.plain``)
are looked for all at once instead (``plans.spots``), without a regex per pair. Results equal those of
``scan``.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from limitlens import schema as S
from limitlens.functions.factors import literal_factors_of
from limitlens.functions.plain import encoded
from limitlens.functions.text import REGEX_FLAGS, is_blank
from limitlens.operators import rules as R
from limitlens.plans.contain import containing, lookup_form
from limitlens.plans.reuse import materialized
from limitlens.plans.sizing import broadcast_limit, collect_bounded, measured_bytes
from limitlens.plans.spots import first_matches

_FLAGS_REQUIRED = "(?imU)"
_OUT = ("code", "severity", "severity_rank", "message", "matched", "position")


def severity_rank(severity: Column) -> Column:
    pairs = [F.lit(x) for item in S.SEVERITY_RANK.items() for x in item]
    return F.create_map(*pairs)[severity]


def call_patterns(rules: DataFrame) -> DataFrame:
    """Rules of function names as rules of their calls."""
    name = F.col("pattern")
    escaped = F.regexp_replace(name, r"([^\p{L}\p{Nd}_])", r"\\\\$1")
    return rules.withColumns({
        "message": F.concat(name, F.lit(" is not available")),
        "pattern": F.concat(F.lit(r"\b"), escaped, F.lit(r"\s*\(")),
    })


def with_factors(rules: DataFrame) -> DataFrame:
    """Rules with ``factors``, in lookup form; a stored table. A rule's own ``needs`` goes first.

    Rules that don't compile are left out; ``rules.pattern_findings`` names them.
    """
    found = F.transform(literal_factors_of(F.col("pattern")), lookup_form)
    if "needs" in rules.columns:
        found = F.when(F.length("needs") > 0, F.array(lookup_form(F.col("needs")))).otherwise(found)
    return materialized(rules.filter(R.valid_pattern(F.col("pattern"))).withColumn("factors", found))


def _matches(texts: DataFrame, text: str, rules: DataFrame, flags: str) -> DataFrame:
    """All columns of ``texts`` with ``rule`` and ``position`` for each rule that matches."""
    rule = F.struct(*[F.col(c) for c in rules.columns]).alias("__rule")
    needles = rules.select(rule, F.explode("factors").alias("__factor"))
    met = containing(texts.filter(~is_blank(text)), F.col(text), needles, "__factor", "__form")
    # A rule with several factors meets a text once per factor in it: the first one counts.
    several = F.get(F.filter(F.col("__rule.factors"), lambda f: F.contains(F.col("__form"), f)), F.lit(0))
    first = F.when(F.size("__rule.factors") > 1, several).otherwise(F.col("__factor"))
    # In one condition, so that the pattern is tried on texts that hold the factor alone, however filters are moved.
    held = F.contains(F.col("__form"), F.col("__factor")) & (F.col("__factor") == first)
    found = F.when(held, F.regexp_instr(F.col(text), F.concat(F.lit(flags), F.col("__rule.pattern"))))
    # Exploded, the position is computed once; a filter would compute it again for the result.
    once = met.withColumn("__position", F.explode_outer(F.filter(F.array(found), lambda at: at > 0)))
    return once.filter("__position is not null").withColumn("__position", F.col("__position") - 1).drop("__factor", "__form")


def scan_table(df: DataFrame, text: str, rules: DataFrame, ids: Sequence[str]) -> DataFrame:
    """A row per text and rule that matches it: ``ids``, the rule's code, severity and message, first match.

    ``rules`` has code, pattern, severity, message and, where wanted, needs: a text that every
    match contains. Blank texts match nothing.
    """
    kept = [c for c in ("code", "pattern", "severity", "message", "needs") if c in rules.columns]
    texts = df.select(*ids, *([] if text in ids else [text]))
    if broadcast_limit(df) <= 0:
        return _tried(texts, text, with_factors(rules.select(*kept)), ids)
    needs = F.col("needs") if "needs" in kept else F.lit("")
    # Numbered where they are stored: the numbers stay as they are.
    judged = materialized(rules.select(*kept).withColumn("plain", encoded(F.col("pattern"), needs)).withColumn("number", F.monotonically_increasing_id()))
    plain, other = judged.filter("plain.sizes is not null"), judged.filter("plain.sizes is null").select(*kept)
    size = 0 if plain.isEmpty() else max(1, measured_bytes(plain))
    blocks = -(-size // broadcast_limit(df))
    found = [_spotted(texts, text, plain if blocks == 1 else plain.filter(F.pmod(F.xxhash64("number"), F.lit(blocks)) == b), ids) for b in range(blocks)]
    if not found or not other.isEmpty():
        found.append(_tried(texts, text, with_factors(other), ids))
    return reduce(DataFrame.unionAll, found)


def _spotted(texts: DataFrame, text: str, rules: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Findings of plain rules (number, plain and the rule's columns); they fit a broadcast."""
    number, matched, position = "__rule", "__matched", "__position"
    own = {i: f"__id_{k}" for k, i in enumerate(ids)}
    bodies = texts.filter(~is_blank(text)).select(*[F.col(i).alias(n) for i, n in own.items()], F.col(text).alias("__text"))
    found = first_matches(bodies, "__text", rules.select("number", "plain.*"), number, matched, position)
    named = rules.select(F.col("number").alias(number), "code", "severity", severity_rank(F.col("severity")).alias("severity_rank"), "message")
    return found.join(F.broadcast(named), number).select(
        *[F.col(n).alias(i) for i, n in own.items()], "code", "severity", "severity_rank", "message",
        F.col(matched).alias("matched"), F.col(position).alias("position"),
    )


def _tried(texts: DataFrame, text: str, rules: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Findings of any rules (see ``with_factors``), each by its pattern."""
    found = _matches(texts, text, rules, REGEX_FLAGS)
    rule = F.col("__rule")
    return found.select(
        *ids, rule["code"].alias("code"), rule["severity"].alias("severity"), severity_rank(rule["severity"]).alias("severity_rank"),
        rule["message"].alias("message"),
        F.regexp_substr(F.col(text), F.concat(F.lit(REGEX_FLAGS), rule["pattern"])).alias("matched"), F.col("__position").alias("position"),
    )


def _alone(df: DataFrame, ids: Sequence[str], condition: Column, code: str, severity: str, message: str) -> DataFrame:
    return df.filter(condition).select(
        *ids, F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(S.SEVERITY_RANK[severity]).alias("severity_rank"),
        F.lit(message).alias("message"), F.lit(None).cast("string").alias("matched"), F.lit(None).cast("int").alias("position"),
    )


def absent_rules(df: DataFrame, text: str, rules: DataFrame, ids: Sequence[str]) -> DataFrame:
    """A row per text and rule whose pattern the text lacks; blank texts have none.

    The result has a row for most texts and rules, so these rules are few by nature; they
    travel as one array on every text.
    """
    numbered = with_factors(rules.select("code", "pattern", "severity", "message").distinct())
    if numbered.isEmpty():
        return _alone(df, ids, F.lit(False), "", "Info", "")
    texts = df.select(*ids, *([] if text in ids else [text]))
    # Rows with equal ids and texts have equal findings.
    key = [*[F.col(i) for i in ids], F.sha2(F.col(text), 256).alias("__text")]
    fields = ("code", "pattern", "severity", "message")
    present = _matches(texts, text, numbered, _FLAGS_REQUIRED).select(*key, *[F.col("__rule")[f].alias(f) for f in fields]).distinct()
    rows = [r.asDict() for r in collect_bounded(numbered.select(*fields), R.MAX_RULES, "required rules")]
    wanted = F.from_json(F.lit(json.dumps(rows)), "array<struct<code:string,pattern:string,severity:string,message:string>>")
    every = texts.filter(~is_blank(text)).select(*key).select(*ids, "__text", F.inline(wanted))
    names = [*ids, "__text", *fields]
    lacking = every.alias("e").join(present.alias("p"), [F.col(f"e.{n}").eqNullSafe(F.col(f"p.{n}")) for n in names], "left_anti")
    return lacking.select(
        *ids, "code", "severity", severity_rank(F.col("severity")).alias("severity_rank"), "message",
        F.lit(None).cast("string").alias("matched"), F.lit(None).cast("int").alias("position"),
    )


def _of(rules: DataFrame, *groups: str) -> DataFrame:
    return rules.filter(F.col("group").isin(*groups))


def sql_scan(df: DataFrame, text: str, rules: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Findings of SQL texts: denied and warned patterns, a blank text, a text without SELECT."""
    lacks = ~is_blank(text) & (F.regexp_instr(F.col(text), F.lit(REGEX_FLAGS + r"\bSELECT\b")) == 0)
    return (
        scan_table(df, text, _of(rules, R.SQL_DENY, R.SQL_WARN), ids)
        .unionByName(_alone(df, ids, is_blank(text), "SQL_EMPTY", "Low", "SQL text is empty"))
        .unionByName(_alone(df, ids, lacks, "SQL_NO_SELECT", "Medium", "text holds no SELECT"))
    )


def macro_scan(df: DataFrame, text: str, rules: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Findings of macro texts: denied and warned patterns, required patterns that are absent, a blank text."""
    return (
        scan_table(df, text, _of(rules, R.MACRO_DENY, R.MACRO_WARN), ids)
        .unionByName(absent_rules(df, text, _of(rules, R.MACRO_REQUIRED), ids))
        .unionByName(_alone(df, ids, is_blank(text), "VBA_EMPTY", "Low", "macro text is empty"))
    )


def formula_scan(df: DataFrame, text: str, rules: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Calls of blocked functions."""
    return scan_table(df, text, call_patterns(_of(rules, R.BLOCKED_FUNCTION)), ids)
