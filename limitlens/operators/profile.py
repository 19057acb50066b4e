"""Table profile: nulls, duplicates, base dates, numeric columns, outliers.

Each part is one wide aggregate over the table, combined before the shuffle; columns are
turned into rows only after the aggregate, when one row is left.
"""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Context, Decimal

from pyspark.sql import Column, DataFrame, functions as F, types as T

from limitlens.functions.numbers import (
    PROFILE_NUMBER, parse_exact_profile, parse_profile_double, parse_profile_number,
)
from limitlens.functions.text import clean, fold, text_or_empty
from limitlens.plans.local import local_table
from limitlens.plans.reuse import materialized

# Texts that count as missing, besides blank.
NULL_TOKENS = ("", "NULL", "N/A", "NA")
_NULL_TEXT = rf"(?iU)\A\s*(?:{'|'.join(NULL_TOKENS)})\s*\z"
MIN_ROWS_FOR_OUTLIERS = 4
SIGMAS = 3.0
# Scan columns added by the readers, not part of the table.
SCAN_COLUMNS = ("_corrupt_record", "_row_no")


def table_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in SCAN_COLUMNS]


def _field(df: DataFrame, name: str) -> T.StructField:
    return next(f for f in df.schema.fields if f.name == name)


def is_null_token(df: DataFrame, name: str) -> Column:
    column = F.col(f"`{name}`")
    if isinstance(_field(df, name).dataType, T.StringType):
        return F.coalesce(column.rlike(_NULL_TEXT), F.lit(True))
    return column.isNull()


def number_of(df: DataFrame, name: str) -> Column:
    """Value as a profile number; NULL where missing or text."""
    column = F.col(f"`{name}`")
    kind = _field(df, name).dataType
    if isinstance(kind, T.NumericType):
        return column.try_cast(PROFILE_NUMBER)
    if isinstance(kind, T.StringType):
        return parse_profile_number(column)
    return F.lit(None).cast(PROFILE_NUMBER)


def null_counts(df: DataFrame) -> DataFrame:
    """Missing values per column."""
    names = table_columns(df)
    row = df.agg(*[F.count_if(is_null_token(df, c)).alias(f"n{i}") for i, c in enumerate(names)])
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("null_count"))
        for i, c in enumerate(names)
    ])
    return row.select(F.explode(pairs).alias("r")).select("r.*")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows, columns and repeated rows. Untrimmed values are compared through a digest, so
    32 bytes per row are shuffled instead of the row, and copies are merged before that."""
    names = table_columns(df)
    joined = F.concat_ws("\x1f", *[text_or_empty(F.col(f"`{c}`")) for c in names])
    digest = F.unhex(F.sha2(joined.cast("binary"), 256))
    return df.agg(
        F.count("*").alias("row_count"), F.count_distinct(digest).alias("distinct_count")
    ).select(
        "row_count",
        F.lit(len(names)).cast("long").alias("column_count"),
        (F.col("row_count") - F.col("distinct_count")).alias("duplicate_count"),
    )


def date_distribution(df: DataFrame, base_dt: str) -> DataFrame:
    """Rows per base date, missing dates left out; empty when the column is absent."""
    name = next((c for c in df.columns if c.lower() == base_dt.lower()), None)
    if name is None:
        return local_table(df.sparkSession, [], "base_dt string, row_count long")
    value = clean(F.col(f"`{name}`"))
    return (
        df.filter(~is_null_token(df, name))
        .select(value.alias("base_dt"))
        .groupBy(fold("base_dt").alias("key"))
        .agg(F.min("base_dt").alias("base_dt"), F.count("*").alias("row_count"))
        .drop("key")
    )


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(_field(df, name).dataType, T.StringType)


def double_of(df: DataFrame, name: str) -> Column:
    """Value as a double, for a column known to be numeric."""
    column = F.col(f"`{name}`")
    return parse_profile_double(column) if _is_text(df, name) else column.cast("double")


def _parsed(df: DataFrame, names: list[str]) -> DataFrame:
    """Parsed values of the text candidates beside the native ones, each parsed once."""
    columns: list[Column] = []
    for i, c in enumerate(names):
        if _is_text(df, c):
            number = parse_exact_profile(F.col(f"`{c}`"))
            columns += [
                number["amount"].alias(f"v{i}"), number["fine"].alias(f"f{i}"), double_of(df, c).alias(f"d{i}"),
                is_null_token(df, c).alias(f"z{i}"),
            ]
        else:
            columns.append(F.col(f"`{c}`").alias(f"v{i}"))
    return df.select(*columns)


def _first_pass(df: DataFrame, name: str, i: int) -> Column:
    """Count, text count, sum, range and double sum of one candidate column."""
    value, fine = F.col(f"v{i}"), F.lit(None).cast("decimal(28,0)")
    if _is_text(df, name):
        number, bad, rough = value, F.count_if(~F.col(f"z{i}") & value.isNull()), F.col(f"d{i}")
        fine = F.col(f"f{i}").cast("decimal(28,0)")
    else:
        # Native values need no parsing; their range is taken as it is.
        number, bad, rough = value.try_cast(PROFILE_NUMBER), F.lit(0).cast("long"), value.cast("double")
    return F.struct(
        F.count(value).alias("n"), bad.alias("bad"), F.try_sum(number).alias("total"),
        F.min(value).try_cast(PROFILE_NUMBER).alias("low"), F.max(value).try_cast(PROFILE_NUMBER).alias("high"),
        F.sum(rough).alias("dsum"), F.try_sum(fine).alias("total_fine"), F.count(fine).alias("fines"),
    )


def _with_fine_range(parsed: DataFrame, stats: dict[str, dict], names: list[str]) -> None:
    """Exact range of the columns that have finer values than nine decimals: one more pass over those."""
    finer = [c for c, s in stats.items() if s["fines"]]
    if not finer:
        return
    pairs = {c: F.when(F.col(f"v{names.index(c)}").isNotNull(), F.struct(f"v{names.index(c)}", F.coalesce(f"f{names.index(c)}", F.lit(0)).alias("fine"))) for c in finer}
    row = parsed.agg(*[f(p).alias(f"{n}{i}") for i, p in enumerate(pairs.values()) for f, n in ((F.min, "low"), (F.max, "high"))]).first()
    for i, c in enumerate(finer):
        for n in ("low", "high"):
            stats[c][n], stats[c][f"{n}_fine"] = row[f"{n}{i}"]


def _exact(stats: dict, metric: str) -> Decimal | None:
    """A statistic with all its decimals."""
    amount, fine = stats[metric], stats.get(f"{metric}_fine")
    return None if amount is None else _WIDE.add(amount, _WIDE.scaleb(fine or 0, -28))


def _exact_text(value: Decimal | None) -> str | None:
    if value is None:
        return None
    text = format(_WIDE.abs(value) if value == 0 else value, "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def numeric_profile(df: DataFrame, exact: bool = False) -> DataFrame:
    """Count, sum, minimum, maximum and 3-sigma outliers of the numeric columns.

    Sum and range are rounded to nine decimals; ``exact`` adds them as text with all decimals,
    up to the 28th (sum_exact, min_exact, max_exact).

    A column is numeric when it has a value and no value is other text. Outliers follow
    two-pass population deviation, so there are three passes: sums, squared deviations,
    outliers. The first two run here and hand their single result row on as constants;
    the later passes read the numeric columns only.
    """
    names = [
        c for c in table_columns(df)
        if isinstance(_field(df, c).dataType, (T.NumericType, T.StringType))
    ]
    schema = _NUMERIC_SCHEMA + (_EXACT_SCHEMA if exact else "")
    if not names:
        return local_table(df.sparkSession, [], schema)
    # An exact profile reads the parsed values four times; parsing texts costs far more than storing them.
    parsed = materialized(_parsed(df, names)) if exact else _parsed(df, names)
    first = parsed.agg(*[_first_pass(df, c, i).alias(f"s{i}") for i, c in enumerate(names)]).first()
    stats = {c: first[f"s{i}"].asDict() for i, c in enumerate(names)}
    numeric = {c: s for c, s in stats.items() if s["bad"] == 0 and s["n"] > 0}
    if not numeric:
        return local_table(df.sparkSession, [], schema)

    _with_fine_range(parsed, numeric, names)
    tested = [c for c, s in numeric.items() if s["n"] >= MIN_ROWS_FOR_OUTLIERS]

    def rough(c: str) -> Column:
        if not exact:
            return double_of(df, c)
        i = names.index(c)
        return F.col(f"d{i}") if _is_text(df, c) else F.col(f"v{i}").cast("double")

    gaps = (parsed if exact else df).select(*[
        (rough(c) - F.lit(numeric[c]["dsum"] / numeric[c]["n"])).alias(f"g{i}") for i, c in enumerate(tested)
    ])
    sigma: dict[str, float] = {}
    if tested:
        squares = gaps.agg(*[F.sum(F.col(f"g{i}") * F.col(f"g{i}")).alias(f"q{i}") for i in range(len(tested))]).first()
        sigma = {c: math.sqrt(squares[f"q{i}"] / numeric[c]["n"]) for i, c in enumerate(tested)}
    outliers = gaps.agg(F.lit(0).alias("none"), *[
        F.count_if(F.abs(f"g{i}") > F.lit(sigma[c] * SIGMAS)).alias(f"o{i}")
        for i, c in enumerate(tested) if sigma[c] != 0
    ])
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(s["n"]).cast("long").alias("non_null_count"),
            *[F.lit(_rounded(_exact(s, m))).cast(PROFILE_NUMBER).alias(n) for n, m in _METRICS],
            (F.col(f"o{tested.index(c)}") if sigma.get(c) else F.lit(0).cast("long")).alias("outlier_count"),
            *[F.lit(_exact_text(_exact(s, m))).cast("string").alias(f"{n}_exact") for n, m in _METRICS if exact],
        )
        for c, s in numeric.items()
    ])
    return outliers.select(F.explode(rows).alias("r")).select("r.*")


def _rounded(value: Decimal | None) -> Decimal | None:
    return None if value is None else value.quantize(Decimal("1e-9"), ROUND_HALF_UP, _WIDE)


_METRICS = (("sum", "total"), ("min", "low"), ("max", "high"))
_WIDE = Context(prec=80)
_EXACT_SCHEMA = ", sum_exact string, min_exact string, max_exact string"
_NUMERIC_SCHEMA = (
    "column_name string, non_null_count long, sum decimal(38,9), min decimal(38,9), "
    "max decimal(38,9), outlier_count long"
)


def profile_warnings(df: DataFrame, base_dt: str) -> DataFrame:
    """Ragged rows seen by the scan, and a missing base-date column."""
    spark = df.sparkSession
    found = local_table(spark, [], "code string, rows long")
    if "_corrupt_record" in df.columns:
        others = F.count(F.lit(1)).alias("__all")
        ragged = df.agg(F.count_if(F.col("_corrupt_record").isNotNull()).alias("rows"), others)
        found = found.unionByName(
            ragged.filter("rows > 0").select(F.lit("RAGGED_ROWS").alias("code"), "rows")
        )
    if base_dt.lower() not in {c.lower() for c in df.columns}:
        found = found.unionByName(
            local_table(spark, [("BASE_DATE_COLUMN_MISSING", 0)], "code string, rows long")
        )
    return found


def profile(df: DataFrame, base_dt: str) -> dict[str, DataFrame]:
    """All parts of the profile."""
    return {
        "nulls": null_counts(df),
        "dates": date_distribution(df, base_dt),
        "numeric": numeric_profile(df),
        "rows": duplicate_rows(df),
        "warnings": profile_warnings(df, base_dt),
    }


def profile_table(parts: dict[str, DataFrame]) -> DataFrame:
    """The profile in long form: section, name, metric, value."""
    def long(df: DataFrame, section: str, name: Column, metrics: dict[str, str]) -> DataFrame:
        values = F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(c).cast("string").alias("value"))
            for m, c in metrics.items()
        ])
        return df.select(
            F.lit(section).alias("section"), name.alias("name"), F.explode(values).alias("v")
        ).select("section", "name", "v.*")

    return (
        long(parts["nulls"], "NullCount", F.col("column_name"), {"Nulls": "null_count"})
        .unionByName(long(parts["dates"], "BaseDate", F.col("base_dt"), {"Rows": "row_count"}))
        .unionByName(long(parts["numeric"], "Numeric", F.col("column_name"), {
            "NonNullCount": "non_null_count", "Sum": "sum", "Min": "min", "Max": "max",
            "OutlierCount": "outlier_count",
        }))
        .unionByName(long(parts["rows"], "Table", F.lit("Rows"), {
            "RowCount": "row_count", "ColumnCount": "column_count", "DuplicateRows": "duplicate_count",
        }))
        .unionByName(long(parts["warnings"], "Warning", F.col("code"), {"Rows": "rows"}))
    )
