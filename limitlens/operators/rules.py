"""Rule sets: their fixed default values, and how a rule line gets its code and severity."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from limitlens.functions.text import REGEX_FLAGS, fold
from limitlens.plans.sizing import collect_bounded
from limitlens.plans.local import local_table

SQL_DENY = "sql_deny"
SQL_WARN = "sql_warn"
MACRO_DENY = "macro_deny"
MACRO_WARN = "macro_warn"
MACRO_REQUIRED = "macro_required"
BLOCKED_FUNCTION = "blocked_function"
PREFERRED_FUNCTION = "preferred_function"
COMPLETION_FUNCTION = "completion_function"

# Rule files and the group each one fills.
RULE_FILES = {
    "sql_deny_patterns.txt": SQL_DENY,
    "sql_warn_patterns.txt": SQL_WARN,
    "vba_deny_patterns.txt": MACRO_DENY,
    "vba_warn_patterns.txt": MACRO_WARN,
    "excel_2021_blocked_functions.txt": BLOCKED_FUNCTION,
    "excel_2021_preferred_functions.txt": PREFERRED_FUNCTION,
    "excel_2021_completion_allow_functions.txt": COMPLETION_FUNCTION,
}
# Fixed value: prefix of a rule that must match.
REQUIRE_PREFIX = "REQUIRE_PRESENT:"
# Groups that may not be empty.
MANDATORY_GROUPS = (SQL_DENY, MACRO_DENY, MACRO_REQUIRED, BLOCKED_FUNCTION, COMPLETION_FUNCTION)

# Codes of the deny keywords.
SQL_DENY_CODES = (
    ("INSERT", "SQL_DML_INSERT"), ("UPDATE", "SQL_DML_UPDATE"),
    ("DELETE", "SQL_DML_DELETE"), ("MERGE", "SQL_DML_MERGE"),
    ("CREATE", "SQL_DDL_CREATE"), ("ALTER", "SQL_DDL_ALTER"),
    ("DROP", "SQL_DDL_DROP"), ("TRUNCATE", "SQL_DDL_TRUNCATE"),
    ("GRANT", "SQL_PRIVILEGE_GRANT"), ("REVOKE", "SQL_PRIVILEGE_REVOKE"),
    ("EXEC", "SQL_EXEC_EXEC"), ("CALL", "SQL_EXEC_CALL"),
    ("COMMIT", "SQL_TX_COMMIT"), ("ROLLBACK", "SQL_TX_ROLLBACK"),
)
# Words that decide the code and severity of a macro deny rule, first match wins.
MACRO_DENY_CODES = (
    (("WSCRIPT",), "VBA_WSCRIPT", "Blocker"),
    (("SHELL",), "VBA_SHELL", "Blocker"),
    (("KILL",), "VBA_KILL", "Blocker"),
    (("DECLARE", "PTRSAFE"), "VBA_WINAPI", "High"),
    (("FILESYSTEMOBJECT",), "VBA_FSO", "High"),
    (("FOLLOWHYPERLINK",), "VBA_FOLLOW_HYPERLINK", "Blocker"),
    (("WINHTTP", "XMLHTTP"), "VBA_HTTP", "Blocker"),
    (("OUTLOOK",), "VBA_OUTLOOK", "High"),
)
# Default patterns of each group.
DEFAULT_SQL_DENY = tuple(rf"\b{word}\b" for word, _ in SQL_DENY_CODES)
DEFAULT_SQL_WARN = (r"SELECT\s+\*", r"WHERE\s+1\s*=\s*1", r"CROSS\s+JOIN", r"/\*\+")
DEFAULT_MACRO_DENY = (
    r"\bShell\b", r"WScript\.Shell", r"\bKill\b", r"Declare\s+PtrSafe",
    r"Scripting\.FileSystemObject|FileSystemObject", "FollowHyperlink", "WinHttp",
    r"MSXML2\.XMLHTTP", r"Outlook\.Application",
)
DEFAULT_MACRO_WARN = (
    r"REQUIRE_PRESENT:Option\s+Explicit",
    r"Application\.DisplayAlerts\s*=\s*False", r"Application\.EnableEvents\s*=\s*False",
)
DEFAULT_BLOCKED_FUNCTIONS = (
    "VSTACK", "HSTACK", "TOCOL", "TOROW", "TAKE", "DROP", "CHOOSECOLS", "TEXTSPLIT",
    "TEXTBEFORE", "TEXTAFTER", "GROUPBY", "PIVOTBY", "MAP", "REDUCE", "BYROW", "BYCOL",
    "REGEXTEST", "REGEXEXTRACT", "REGEXREPLACE",
)
MAX_RULES = 10_000


@dataclass(frozen=True)
class Rule:
    """A pattern rule. ``needs`` may name a text every match contains; texts without it are
    passed over quickly. Simple patterns need none, their words are found by themselves."""

    group: str
    code: str
    pattern: str
    severity: str
    message: str = ""
    needs: str = ""


@dataclass(frozen=True)
class RuleSet:
    """Rules by group. A rule set is configuration: it travels inside the plan as literals,
    so each pattern is compiled once per task and texts are never joined with rules."""

    rules: tuple[Rule, ...]
    version: str = ""

    def of(self, *groups: str) -> list[Rule]:
        return [r for g in groups for r in self.rules if r.group == g]

    @staticmethod
    def from_table(rules: DataFrame, version: str = "") -> "RuleSet":
        """Rule set from a rules table (group, rule_no, code, pattern, severity, message)."""
        rows = collect_bounded(rules, MAX_RULES, "rules")
        rows.sort(key=lambda r: (r["group"], r["rule_no"]))
        built = RuleSet(tuple(
            Rule(r["group"], r["code"], r["pattern"], r["severity"], r["message"]) for r in rows
        ), version)
        empty = [g for g in MANDATORY_GROUPS if not built.of(g)]
        if empty:
            raise ValueError(f"rule groups without a rule: {', '.join(empty)}")
        return built


def valid_pattern(pattern: Column) -> Column:
    """Whether the regex compiles, told by the JVM's compiler on the executors; NULL does not."""
    compiled = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.concat(F.lit(REGEX_FLAGS), pattern))
    return compiled.isNotNull()


def pattern_findings(rules: DataFrame) -> DataFrame:
    """A finding per rule whose pattern does not compile. Function names are no patterns."""
    named = F.col("group").isin(BLOCKED_FUNCTION, PREFERRED_FUNCTION, COMPLETION_FUNCTION)
    return rules.filter(~named & ~valid_pattern(F.col("pattern"))).select(
        "group", "rule_no", "pattern", F.lit("RULE_PATTERN_INVALID").alias("code"), F.lit("High").alias("severity")
    )


def usable_rules(rules: DataFrame) -> DataFrame:
    """Rules that compile; a mandatory group of which none does takes its default rules.

    ``pattern_findings`` names the others.
    """
    named = F.col("group").isin(BLOCKED_FUNCTION, PREFERRED_FUNCTION, COMPLETION_FUNCTION)
    good = rules.filter(named | valid_pattern(F.col("pattern")))
    # Groups with rules, none of which compiles: a handful.
    lost = rules.select("group").distinct().join(good.select("group").distinct(), "group", "left_anti").filter(F.col("group").isin(*MANDATORY_GROUPS))
    defaults = default_rules(rules.sparkSession).join(F.broadcast(lost), "group", "left_semi")
    kept = [c for c in good.columns if c in defaults.columns and c != "rule_no"]
    order = F.lit(None).cast(rules.schema["rule_no"].dataType).alias("rule_no")
    return good.select(*kept, "rule_no").unionByName(defaults.select(*kept, order))


def _any_of(text: Column, words: Iterable[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def with_code(rules: DataFrame) -> DataFrame:
    """Add code, severity and message to (group, pattern) rows."""
    group, pattern = F.col("group"), F.col("pattern")
    upper = fold(pattern)

    deny = F.lit("SQL_DENY_PATTERN")
    for word, code in reversed(SQL_DENY_CODES):
        deny = F.when(F.contains(upper, F.lit(word)), code).otherwise(deny)
    warn = (
        F.when(_any_of(upper, ["SELECT"]) & F.contains(pattern, F.lit(r"\*")), "SQL_SELECT_STAR")
        .when(_any_of(upper, ["WHERE"]) & _any_of(upper, ["1"]), "SQL_WHERE_ALWAYS_TRUE")
        .when(_any_of(upper, ["CROSS"]) & _any_of(upper, ["JOIN"]), "SQL_CROSS_JOIN")
        .when(F.contains(pattern, F.lit(r"/\*\+")), "SQL_OPTIMIZER_HINT")
        .otherwise("SQL_WARN_PATTERN")
    )
    macro, macro_severity = F.lit("VBA_DENY_PATTERN"), F.lit("Blocker")
    for words, code, severity in reversed(MACRO_DENY_CODES):
        hit = _any_of(upper, words)
        macro = F.when(hit, code).otherwise(macro)
        macro_severity = F.when(hit, severity).otherwise(macro_severity)
    macro_warn = (
        F.when(_any_of(upper, ["DISPLAYALERTS"]), "VBA_DISPLAY_ALERTS_DISABLED")
        .when(_any_of(upper, ["ENABLEEVENTS"]), "VBA_ENABLE_EVENTS_DISABLED")
        .otherwise("VBA_WARN_PATTERN")
    )
    required = (
        F.when(_any_of(upper, ["OPTION"]) & _any_of(upper, ["EXPLICIT"]), "VBA_OPTION_EXPLICIT_MISSING")
        .otherwise("VBA_REQUIRED_PATTERN_MISSING")
    )
    code = (
        F.when(group == SQL_DENY, deny).when(group == SQL_WARN, warn)
        .when(group == MACRO_DENY, macro).when(group == MACRO_WARN, macro_warn)
        .when(group == MACRO_REQUIRED, required)
        .when(group == BLOCKED_FUNCTION, "EXCEL_365_FUNCTION").otherwise("FUNCTION_NAME")
    )
    severity = (
        F.when(group == SQL_DENY, "Blocker").when(group == MACRO_DENY, macro_severity)
        .when(group.isin(SQL_WARN, MACRO_WARN, MACRO_REQUIRED), "Medium")
        .when(group == BLOCKED_FUNCTION, "High").otherwise("Info")
    )
    return rules.withColumns({
        "code": code,
        "severity": severity,
        "message": F.concat(F.col("group"), F.lit(": "), pattern),
    })


def default_rules(spark) -> DataFrame:
    """The default rule set as a rules table."""
    lines = [
        *[(SQL_DENY, p) for p in DEFAULT_SQL_DENY],
        *[(SQL_WARN, p) for p in DEFAULT_SQL_WARN],
        *[(MACRO_DENY, p) for p in DEFAULT_MACRO_DENY],
        *[
            (MACRO_REQUIRED, p[len(REQUIRE_PREFIX):]) if p.startswith(REQUIRE_PREFIX) else (MACRO_WARN, p)
            for p in DEFAULT_MACRO_WARN
        ],
        *[(BLOCKED_FUNCTION, p) for p in DEFAULT_BLOCKED_FUNCTIONS],
    ]
    numbered = [(g, i, p) for i, (g, p) in enumerate(lines)]
    return with_code(local_table(spark, numbered, "group string, rule_no long, pattern string"))


def default_rule_set(spark) -> RuleSet:
    rows = collect_bounded(default_rules(spark), MAX_RULES, "rules")
    rows.sort(key=lambda r: r["rule_no"])
    return RuleSet(tuple(
        Rule(r["group"], r["code"], r["pattern"], r["severity"], r["message"]) for r in rows
    ))
