"""Regulation catalog and clause packs, with their row checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from limitlens.functions.dates import strict_date
from limitlens.functions.text import clean, is_blank
from limitlens.operators.search import CATALOG_FIELDS, catalog_entries, clause_ids
from limitlens.plans.order import ranked
from limitlens.plans.joins import lookup_join
from limitlens.plans.local import local_table
from limitlens.plans.reuse import materialized
from limitlens.sources.tables import CORRUPT, ROW_NO, TableError

# Required catalog fields and the metadata that should be filled.
REQUIRED_FIELDS = CATALOG_FIELDS[:7]
EXPECTED_METADATA = (
    "source", "version", "effective_date", "file_hash", "loaded_date", "approval_status", "license_status",
)
DATE_FIELDS = ("effective_date", "repeal_date", "loaded_date")
REQUIRED_DATES = ("effective_date", "loaded_date")
# Clause pack columns, and those that may not be blank.
CLAUSE_COLUMNS = ("clause_ref", "clause_body", "source_id", "effective_date", "repeal_date", "pack_version")
CLAUSE_VALUES = ("clause_ref", "clause_body", "source_id", "effective_date", "pack_version")
NATURAL_KEY = ("source_id", "clause_ref", "pack_version")


def _explode(df: DataFrame, keep: list[str], found: list[Column]) -> DataFrame:
    return df.select(*keep, F.explode(F.array_compact(F.array(*found))).alias("v")).select(*keep, "v.*")


def _problem(kind: str, field: str) -> Column:
    return F.struct(F.lit(kind).alias("problem"), F.lit(field).alias("field"))


@dataclass(frozen=True)
class Catalog:
    entries: DataFrame
    errors: DataFrame
    warnings: DataFrame


def load_catalog(table: DataFrame) -> Catalog:
    """Catalog entries with fatal errors and metadata warnings as tables.

    A missing required column is refused at once. Rows break the load when a required value
    is blank or the row has too few or too many fields; ``require_clean`` stops a job then.
    """
    present = {c.lower() for c in table.columns}
    missing = [c for c in REQUIRED_FIELDS if c not in present]
    if missing:
        raise TableError(f"catalog columns missing: {', '.join(missing)}")
    row_no = ROW_NO if ROW_NO in table.columns else None
    entries = catalog_entries(table, row_no)
    if CORRUPT in table.columns:
        ragged = table.select(F.col(CORRUPT).alias("line"), F.col(ROW_NO).alias("_row_no"))
        width = len([c for c in table.columns if c not in (CORRUPT, ROW_NO)])
        counted = ragged.filter(F.col("line").isNotNull()).withColumn("n", field_count(F.col("line")))
        lines = counted.select(F.lit("").alias("source_id"), F.explode(F.array_compact(F.array(
            F.when(F.col("n") > width, _problem("TOO_MANY_FIELDS", "")),
            F.when(F.col("n") < len(REQUIRED_FIELDS), _problem("TOO_FEW_FIELDS", "")),
            F.when((F.col("n") >= len(REQUIRED_FIELDS)) & (F.col("n") < width), _problem("FIELDS_MISSING", "")),
        ))).alias("v")).select("source_id", "v.*")
    else:
        lines = local_table(entries.sparkSession, [], "source_id string, problem string, field string")
    fatal = F.col("problem").isin("TOO_MANY_FIELDS", "TOO_FEW_FIELDS")

    blank = _explode(entries, ["source_id"], [
        F.when(is_blank(f), _problem("REQUIRED_VALUE_BLANK", f)) for f in REQUIRED_FIELDS
    ])
    soft = _explode(entries, ["source_id"], [
        *[F.when(is_blank(f), _problem("METADATA_BLANK", f)) for f in EXPECTED_METADATA],
        *[
            F.when(is_blank(f), _problem("DATE_BLANK", f) if f in REQUIRED_DATES else F.lit(None))
            .when(strict_date(f).isNull(), _problem("DATE_FORMAT", f))
            for f in DATE_FIELDS
        ],
    ])
    absent = [f for f in CATALOG_FIELDS[7:] if f not in present]
    columns = local_table(
        entries.sparkSession, [("", "METADATA_COLUMN_MISSING", f) for f in absent], "source_id string, problem string, field string"
    )
    return Catalog(
        entries,
        blank.unionByName(lines.filter(fatal)),
        soft.unionByName(lines.filter(~fatal)).unionByName(columns),
    )


def field_count(line: Column) -> Column:
    """Number of fields of a delimited line: separators outside quotes, plus one."""
    unquoted = F.regexp_replace(line, '"[^"]*"', "")
    return F.length(unquoted) - F.length(F.translate(unquoted, ",", "")) + 1


def require_clean(df: DataFrame, errors: DataFrame, what: str) -> DataFrame:
    """``df``, or a failed job when there is any error row."""
    count = errors.agg(F.count("*").alias("n")).scalar()
    failed = F.raise_error(F.concat(F.lit(what + ": errors "), count.cast("string"))).cast("boolean")
    return df.filter(F.when(count > 0, failed).otherwise(True))


@dataclass(frozen=True)
class ClausePack:
    clauses: DataFrame
    findings: DataFrame


def load_clause_pack(table: DataFrame) -> ClausePack:
    """Clauses of a pack; any finding rejects the whole pack.

    The first row of a (source, reference, version) counts. A later row with the same text
    is dropped, one with another text is a finding. Without a row order the smallest text hash
    counts as first. The graded rows are written once, so all parts see the same row order.
    """
    present = {c.lower() for c in table.columns}
    missing = [c for c in CLAUSE_COLUMNS if c not in present]
    if missing:
        spark = table.sparkSession
        return ClausePack(
            _shaped(table.withColumns({m: F.lit("") for m in missing})).filter(F.lit(False)),
            local_table(spark, [("KB_CLAUSE_PACK_HEADER_MISSING", m) for m in missing], "code string, detail string"),
        )
    rows = _shaped(table)
    first_blank = F.coalesce(*[
        F.when(is_blank("clause_text" if c == "clause_body" else c), F.lit(c)) for c in CLAUSE_VALUES
    ])
    skipped = F.when(F.col("too_many"), F.lit("TOO_MANY_FIELDS")).otherwise(first_blank)
    graded = materialized(clause_ids(rows.withColumn("skipped", skipped)))
    good = graded.filter(F.col("skipped").isNull())

    # First row per key by row order alone; texts are compared through their hash.
    first = good.groupBy(*NATURAL_KEY).agg(
        F.min(F.struct("_row_no", "source_text_hash", "effective_date", "repeal_date")).alias("first")
    )
    marked = lookup_join(good, first, NATURAL_KEY, "inner")
    is_first = F.struct("_row_no", "source_text_hash", "effective_date", "repeal_date") == F.col("first")
    conflict = F.col("source_text_hash") != F.col("first.source_text_hash")
    findings = graded.filter(F.col("skipped").isNotNull()).select(
        F.lit("KB_CLAUSE_PACK_ROW_SKIPPED").alias("code"), F.col("skipped").alias("detail")
    ).unionByName(marked.filter(conflict).select(
        F.lit("KB_CLAUSE_PACK_DUPLICATE_NATURAL_KEY").alias("code"),
        F.concat_ws("/", *NATURAL_KEY).alias("detail"),
    ))
    accepted = findings.agg(F.count("*").alias("n")).scalar() == 0
    clauses = marked.filter(is_first & accepted).drop("first", "skipped", "too_many", "_row_no")
    if ROW_NO not in table.columns:
        clauses = clauses.dropDuplicates(list(NATURAL_KEY))  # rows that are equal throughout
    return ClausePack(clauses, findings)


def _shaped(table: DataFrame) -> DataFrame:
    width = len([c for c in table.columns if c not in (CORRUPT, ROW_NO)])
    too_many = (
        F.coalesce(field_count(F.col(CORRUPT)) > width, F.lit(False)) if CORRUPT in table.columns else F.lit(False)
    )
    order = F.col(ROW_NO) if ROW_NO in table.columns else F.lit(0)
    return table.select(
        clean("clause_ref").alias("clause_ref"), clean("clause_body").alias("clause_text"),
        clean("source_id").alias("source_id"), clean("effective_date").alias("effective_date"),
        clean("repeal_date").alias("repeal_date"), clean("pack_version").alias("pack_version"),
        too_many.alias("too_many"), order.alias("_row_no"),
    )


def ranked_clauses(clauses: DataFrame) -> DataFrame:
    """Clauses with their place in the order by source, reference, version and id."""
    return ranked(clauses, ("source_id", "clause_ref", "pack_version", "chunk_id"))


def ordered_clauses(clauses: DataFrame) -> DataFrame:
    return clauses.orderBy("source_id", "clause_ref", "pack_version", "chunk_id")


def ordered_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.col("code"), F.col("detail"))


