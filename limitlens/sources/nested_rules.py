"""Nested capital rule sets (JSON): structure checks, child tables, referential check."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from limitlens import schema as S
from limitlens.functions.dates import strict_date
from limitlens.functions.text import is_blank
from limitlens.operators.rules import RuleSet
from limitlens.operators.scan import sql_findings

_TEXT = T.StringType()


def _struct(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TEXT) for n in names])


COMPONENT = _struct("ComponentId", "Name", "Category", "ValuePolicy")
COMPONENT_MAP = T.StructType([
    *_struct("ComponentId", "SourceName", "ColumnName", "DataType").fields,
    T.StructField("Required", T.BooleanType()),
])
APPROVAL = _struct("Status", "ReviewerRole", "ApprovedAt", "Note")
RULE_SET = T.StructType([
    T.StructField("RuleSetId", _TEXT),
    T.StructField("RuleSetVersion", _TEXT),
    T.StructField("EffectiveDate", _TEXT),
    T.StructField("Components", T.ArrayType(COMPONENT)),
    T.StructField("ComponentMap", T.ArrayType(COMPONENT_MAP)),
    T.StructField("FormulaDescription", _TEXT),
    T.StructField("ValidationSqlTemplates", T.ArrayType(_TEXT)),
    T.StructField("RegulationBasis", _TEXT),
    T.StructField("ApprovalHistory", T.ArrayType(APPROVAL)),
])
# What must be filled.
REQUIRED_TEXT = ("RuleSetId", "RuleSetVersion", "FormulaDescription", "RegulationBasis")
REQUIRED_LISTS = ("Components", "ComponentMap", "ValidationSqlTemplates", "ApprovalHistory")


@dataclass(frozen=True)
class NestedRules:
    """One row per rule-set file, and its child tables; ``usable`` only has clean files."""

    rule_sets: DataFrame
    findings: DataFrame
    usable: DataFrame


def read_rule_sets(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON document; comments are allowed, names are matched in any case."""
    raw = (
        spark.read.option("multiLine", "true").option("allowComments", "true")
        .option("columnNameOfCorruptRecord", "_corrupt_record").option("mode", "PERMISSIVE")
        .schema(T.StructType([*RULE_SET.fields, T.StructField("_corrupt_record", _TEXT)])).json(path)
    )
    return raw.select("*", F.col("_metadata.file_path").alias("file"))


def parse_rule_sets(documents: DataFrame) -> DataFrame:
    """The same rows from a table of ``file`` and ``content``, one JSON document each.

    A null or empty document is an unreadable one.
    """
    schema = T.StructType([*RULE_SET.fields, T.StructField("_corrupt_record", _TEXT)])
    options = {"mode": "PERMISSIVE", "allowComments": "true", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = documents.select("file", "content", F.from_json("content", schema, options).alias("r"))
    broken = F.when(F.col("r").isNull(), F.coalesce("content", F.lit(""))).otherwise(F.col("r._corrupt_record"))
    return parsed.select(*[F.col(f"r.{f.name}") for f in RULE_SET.fields], broken.alias("_corrupt_record"), "file")


def _missing(field: str) -> Column:
    return S.finding("NCR_RULESET_REQUIRED_FIELD_MISSING", "Medium", field)


def _incomplete(items: str, fields: tuple[str, ...], code: str) -> Column:
    """One finding per child row with a blank field."""
    def broken(item: Column) -> Column:
        blank = item.isNull()
        for f in fields:
            blank = blank | is_blank(item.getField(f))
        return blank

    bad = F.filter(F.coalesce(F.col(items), F.array().cast(_type_of(items))), broken)
    return F.transform(bad, lambda i: S.finding(code, "Medium", F.coalesce(i.getField(fields[0]), F.lit(""))))


def _type_of(items: str) -> T.DataType:
    return RULE_SET[items].dataType


def load_rule_sets(rule_sets: DataFrame, rules: RuleSet) -> NestedRules:
    """Structure findings, SQL template findings of Medium or above, and the usable rule sets."""
    single = [
        F.when(F.col("_corrupt_record").isNotNull(), S.finding("NCR_RULESET_LOAD_FAILED", "Medium")),
        *[F.when(is_blank(f), _missing(f)) for f in REQUIRED_TEXT],
        F.when(strict_date("EffectiveDate").isNull(),
               S.finding("NCR_RULESET_EFFECTIVE_DATE_INVALID", "Medium")),
        *[F.when(F.coalesce(F.size(f), F.lit(0)) <= 0, _missing(f)) for f in REQUIRED_LISTS],
    ]
    structure = F.concat(
        F.array_compact(F.array(*single)),
        _incomplete("Components", ("ComponentId", "Name", "Category", "ValuePolicy"), "NCR_COMPONENT_INCOMPLETE"),
        _incomplete("ComponentMap", ("ComponentId", "SourceName", "ColumnName", "DataType"),
                    "NCR_COMPONENT_MAP_INCOMPLETE"),
    )
    by_file = rule_sets.select("file", F.explode(structure).alias("f")).select("file", "f.*")
    templates = rule_sets.select("file", F.explode("ValidationSqlTemplates").alias("sql"))
    by_template = (
        templates.select("file", F.explode(sql_findings(F.col("sql"), rules)).alias("f"))
        .filter(F.col("f.severity_rank") >= S.SEVERITY_RANK["Medium"])
        .select("file", "f.code", "f.severity", "f.severity_rank", "f.message")
    )
    findings = by_file.unionByName(by_template)
    usable = rule_sets.join(findings.select("file").distinct(), "file", "left_anti").drop("_corrupt_record")
    return NestedRules(rule_sets, findings, usable)


def children(rule_sets: DataFrame, items: str) -> DataFrame:
    """Child rows of one list, with their rule set."""
    return rule_sets.select("file", "RuleSetId", F.explode(items).alias("i")).select("file", "RuleSetId", "i.*")


def unmapped_components(rule_sets: DataFrame) -> DataFrame:
    """Mapped component ids that no component of the same rule set defines."""
    return children(rule_sets, "ComponentMap").join(
        children(rule_sets, "Components").select("file", "ComponentId"), ["file", "ComponentId"], "left_anti"
    )
