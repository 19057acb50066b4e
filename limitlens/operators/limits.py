"""Limit monitoring: exposures against the limit master of the same base date.

All results carry ``base_dt``: one job may analyse one base date or every date of the
tables. Each date is analysed on its own, exactly as a single-date run would.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from limitlens import schema as S
from limitlens.functions.dates import BaseDate
from limitlens.functions.numbers import (
    amount_column, carried, difference, exceeds, held, is_positive, nine_tenths_reached,
    nine_tenths_reached_exactly, quotient, quotient_of_parts,
)
from limitlens.functions.text import clean, equals_ignore_case, fold
from limitlens.plans.joins import lookup_join
from limitlens.plans.reuse import materialized
from limitlens.sources.mapping import (
    DESK, PRODUCT, ColumnMapping, has_column, missing_columns,
)
from limitlens.plans.local import local_table

KEYS = ("base_dt", "pf_key", "rf_key")


@dataclass(frozen=True)
class LimitInputs:
    """Exposures and limits under their logical names, with the dates to analyse.

    ``exposures`` / ``limits`` hold every row of the tables; ``every_date`` tells that all
    dates found in them are analysed. A side with missing columns keeps what it has.
    """

    exposures: DataFrame
    limits: DataFrame
    requested: tuple[BaseDate, ...]
    every_date: bool
    missing_exposure: tuple[str, ...]
    missing_limit: tuple[str, ...]
    currency_applicable: bool
    unit_applicable: bool
    mapping: ColumnMapping
    _known: dict = field(default_factory=dict, compare=False, repr=False)

    @property
    def dates(self) -> DataFrame:
        """The dates analysed, one row each. Where all are, they are stored when first needed."""
        if not self.every_date:
            return local_table(
                self.spark, [(d.normalized, d.requested, d.valid) for d in self.requested],
                "base_dt string, requested string, valid boolean",
            )
        if "dates" not in self._known:
            self.find_dates(self.exposures, self.limits)
        return self._known["dates"]

    def find_dates(self, *tables: DataFrame) -> None:
        """Take the dates from tables that hold all of them (e.g. grouped ones, cheaper to read)."""
        if self.every_date and "dates" not in self._known:
            self._known["dates"] = materialized(_dates_found(*tables))

    @property
    def limit_facts(self) -> DataFrame:
        """The limits of the analysed dates, grouped and written once for all who read them."""
        if "limit_facts" not in self._known:
            self._known["limit_facts"] = materialized(_limit_facts(self))
        return self._known["limit_facts"]

    @property
    def spark(self) -> SparkSession:
        return self.exposures.sparkSession

    def on_dates(self, df: DataFrame) -> DataFrame:
        if self.every_date:
            return df.filter(F.col("base_dt") != "")
        return df.filter(F.col("base_dt").isin([d.normalized for d in self.requested]))


def bind(
    exposures: DataFrame,
    limits: DataFrame,
    base_dts: str | Sequence[str] | None = None,
    mapping: ColumnMapping | None = None,
    row_no: str | None = None,
    trimmed: bool = False,
) -> LimitInputs:
    """Project both tables to logical names and parse their amounts.

    Without ``base_dts`` every date of either table is analysed.
    ``row_no`` names the column that gives the row order of both tables (any orderable
    type); without it the order is that of the values. ``trimmed`` tells that the tables
    hold trimmed text already, e.g. after ``sources.tables.write_standard``: the base-date
    filter then reaches the scan and prunes partitions.
    """
    mapping = mapping or ColumnMapping()
    dates: tuple[BaseDate, ...] = ()
    if base_dts is not None:
        wanted = [base_dts] if isinstance(base_dts, str) else list(base_dts)
        dates = tuple({d.normalized: d for d in map(BaseDate.of, wanted)}.values())
        if not dates:
            raise ValueError("no base date given")

    names = mapping.physical
    need_exposure = [names(c) for c in ("BaseDate", "PortfolioId", "RiskFactor", "ExposureAmount")]
    need_limit = [names(c) for c in ("BaseDate", "PortfolioId", "RiskFactor", "LimitAmount", "UseYn")]
    missing_exposure = tuple(missing_columns(exposures, need_exposure))
    missing_limit = tuple(missing_columns(limits, need_limit))
    if base_dts is None and names("BaseDate") in missing_exposure + missing_limit:
        raise ValueError("base dates must be given when a table has no base-date column")

    ccy, unit = mapping.find("CurrencyCode"), mapping.find("UnitCode")
    keyed = all(
        has_column(t, names(c)) for t in (exposures, limits) for c in ("PortfolioId", "RiskFactor")
    )
    text = _plain_text if trimmed else clean

    def side(df: DataFrame, extra: dict[str, Column]) -> DataFrame:
        def value(physical: str | None) -> Column:
            return text(F.col(f"`{physical}`")) if has_column(df, physical) else F.lit("")

        base = df.select(
            value(names("BaseDate")).alias("base_dt"),
            value(names("PortfolioId")).alias("portfolio_id"),
            value(names("RiskFactor")).alias("risk_factor"),
            value(ccy).alias("ccy_cd"),
            value(unit).alias("unit_cd"),
            *[(value(c) if isinstance(c, str) else c).alias(n) for n, c in extra.items()],
            (F.col(f"`{row_no}`") if has_column(df, row_no) else F.lit("")).alias("_row_no"),
        )
        return base.withColumns(
            {"pf_key": fold("portfolio_id"), "rf_key": fold("risk_factor")}
        )

    def amount(df: DataFrame, physical: str) -> Column:
        if has_column(df, physical):
            return amount_column(df, physical)
        return F.struct(F.lit(None).cast(S.AMOUNT).alias("amount"), F.lit(None).cast(S.FINE).alias("fine"))

    use_yn = names("UseYn")
    flag = text(F.col(f"`{use_yn}`")) if has_column(limits, use_yn) else F.lit("")
    exposed, allowed = amount(exposures, names("ExposureAmount")), amount(limits, names("LimitAmount"))
    exposure_side = side(exposures, {
        "desk_cd": DESK,
        "product_type": PRODUCT,
        "exposure_amt": exposed["amount"], "exposure_fine": exposed["fine"],
    })
    limit_side = side(limits, {
        "limit_amt": allowed["amount"], "limit_fine": allowed["fine"],
        "use_yn": flag,
        "in_use": equals_ignore_case(flag, "Y"),
    })
    return LimitInputs(
        exposures=exposure_side,
        limits=limit_side,
        requested=dates,
        every_date=base_dts is None,
        missing_exposure=missing_exposure,
        missing_limit=missing_limit,
        currency_applicable=keyed and has_column(exposures, ccy) and has_column(limits, ccy),
        unit_applicable=keyed and has_column(exposures, unit) and has_column(limits, unit),
        mapping=mapping,
    )


def _dates_found(*sides: DataFrame) -> DataFrame:
    """Base dates of the tables: a scan of one column, a few rows per task shuffled."""
    found = sides[0].select("base_dt")
    for side in sides[1:]:
        found = found.unionByName(side.select("base_dt"))
    return found.filter(F.col("base_dt") != "").distinct().select(
        "base_dt", F.col("base_dt").alias("requested"), F.lit(True).alias("valid")
    )


def _plain_text(value: Column) -> Column:
    return value.cast("string")


def _limit_facts(inputs: LimitInputs) -> DataFrame:
    """Limit rows grouped by key, spelling, currency and unit, combined before the shuffle."""
    amount = F.col("limit_amt")
    positive = is_positive(amount, F.col("limit_fine"))
    usable = F.coalesce(positive & F.col("in_use"), F.lit(False))
    return inputs.on_dates(inputs.limits).groupBy(
        *KEYS, "portfolio_id", "risk_factor", "ccy_cd", "unit_cd"
    ).agg(
        F.count("*").alias("limit_rows"),
        F.count_if(amount.isNull() | ~positive).alias("nonpositive"),
        F.max("limit_amt").alias("limit_amt"), F.max("limit_fine").alias("limit_fine"),
        F.max(usable.cast("int")).alias("usable"),
        F.min("_row_no").alias("_row_no"),
    )


def limit_lookup(inputs: LimitInputs) -> DataFrame:
    """One row per (date, key): row count, amount and usability of the limit.

    Amount and usability only count where the key has one row, so plain ``max`` does.
    """
    return inputs.limit_facts.groupBy(*KEYS).agg(
        F.sum("limit_rows").alias("limit_rows"),
        F.max("limit_amt").alias("limit_amt"), F.max("limit_fine").alias("limit_fine"),
        F.max("usable").alias("usable"),
    )


def classify(amount: Column, limit: Column, fine: Column, limit_fine: Column) -> Column:
    """BREACH above the limit, WARNING from 90 %, else NORMAL; exact, without division."""
    used = F.abs(amount)
    plain = F.when(used > limit, S.BREACH).when(nine_tenths_reached(used, limit), S.WARNING).otherwise(S.NORMAL)

    def exact(p: Column) -> Column:
        parts = (p["used"], p["used_fine"], p["limit"], p["limit_fine"])
        return F.when(exceeds(*parts), S.BREACH).when(nine_tenths_reached_exactly(*parts), S.WARNING).otherwise(S.NORMAL)

    return F.when(fine.isNotNull() | limit_fine.isNotNull(), held(_parts(used, fine, limit, limit_fine), exact)).otherwise(plain)


def _parts(used: Column, fine: Column, limit: Column, limit_fine: Column) -> dict[str, Column]:
    return {"used": used, "used_fine": F.abs(fine), "limit": limit, "limit_fine": limit_fine}


def limit_status(inputs: LimitInputs) -> DataFrame:
    """Every exposure row of the analysed dates with its state.

    Besides ``schema.STATUS_COLUMNS`` the result keeps the columns later steps join and
    group on: ``unit_cd``, ``pf_key``, ``rf_key``, ``limit_rows`` and ``_row_no``. Amounts have nine
    decimals; ``exposure_fine``, ``limit_fine`` and ``remaining_fine`` hold the following ones up to the
    28th, in units of it. States are decided by both.
    """
    if inputs.missing_exposure:
        return _synthetic(inputs, f"exposure columns missing: {', '.join(inputs.missing_exposure)}")
    exposures = inputs.on_dates(inputs.exposures)
    if inputs.missing_limit:
        return _all_mapping_errors(
            inputs, exposures, f"limit columns missing: {', '.join(inputs.missing_limit)}"
        )

    joined = lookup_join(
        exposures, limit_lookup(inputs), KEYS, "left", bound=inputs.limit_facts
    )
    status = (
        F.when(F.col("exposure_amt").isNull(), S.MAPPING_ERROR)
        .when(F.col("limit_rows") > 1, S.DUPLICATE_LIMIT)
        .when(F.col("limit_rows").isNull(), S.NO_LIMIT)
        .when(F.col("usable") == 0, S.INVALID_LIMIT)
        .otherwise(classify(*map(F.col, ("exposure_amt", "limit_amt", "exposure_fine", "limit_fine"))))
    )
    return _shape(joined.withColumn("status", status))


def _shape(joined: DataFrame) -> DataFrame:
    numeric = F.col("status").isin(*S.NUMERIC_STATUSES)
    zero = F.lit(0).cast(S.AMOUNT)
    used = F.abs("exposure_amt")
    note = (
        F.when(F.col("status") == S.BREACH, "limit exceeded, review")
        .when(F.col("status") == S.WARNING, "90 % or more of the limit used")
        .when(F.col("status") == S.NORMAL, "within the limit")
        .when(F.col("status") == S.NO_LIMIT, "no limit row for this base date")
        .when(F.col("status") == S.INVALID_LIMIT, "limit row is not usable")
        .when(
            F.col("status") == S.DUPLICATE_LIMIT,
            F.concat(F.col("limit_rows").cast("string"), F.lit(" limit rows for one key")),
        )
        .otherwise("exposure amount is not a number")
    )
    keeps_limit = numeric | (F.col("status") == S.INVALID_LIMIT)
    finer = F.col("limit_fine").isNotNull() | F.col("exposure_fine").isNotNull()
    parts = _parts(used, F.col("exposure_fine"), F.col("limit_amt"), F.col("limit_fine"))

    def remaining(p: Column) -> Column:
        none = F.lit(0).cast(S.FINE)
        return carried(difference(p["limit"], p["used"]), F.coalesce(p["limit_fine"], none) - F.coalesce(p["used_fine"], none))

    fine_left = F.when(finer, held(parts, remaining))
    return joined.select(
        "base_dt", "desk_cd", "portfolio_id", "product_type", "risk_factor", "ccy_cd",
        F.when(F.col("status") == S.MAPPING_ERROR, zero)
        .otherwise(F.col("exposure_amt")).alias("exposure_amt"),
        F.when(keeps_limit, F.coalesce("limit_amt", zero)).otherwise(zero).alias("limit_amt"),
        F.when(numeric & finer, held(parts, lambda p: quotient_of_parts(p["used"], p["used_fine"], p["limit"], p["limit_fine"])))
        .when(numeric, quotient(used, F.col("limit_amt")))
        .otherwise(F.lit(0).cast(S.RATIO)).alias("usage_ratio"),
        F.when(numeric, F.coalesce(fine_left["amount"], difference(F.col("limit_amt"), used))).otherwise(F.lit(0).cast(S.REMAINING)).alias("remaining_limit"),
        "status",
        note.alias("note"),
        "unit_cd", "pf_key", "rf_key",
        F.coalesce("limit_rows", F.lit(0).cast("long")).alias("limit_rows"),
        "_row_no",
        F.when(F.col("status") != S.MAPPING_ERROR, F.col("exposure_fine")).alias("exposure_fine"),
        F.when(keeps_limit, F.col("limit_fine")).alias("limit_fine"),
        F.when(numeric, fine_left["fine"]).alias("remaining_fine"),
    )


def _error_columns(message: str, limit_rows: Column) -> dict[str, Column]:
    return {
        "exposure_amt": F.lit(0).cast(S.AMOUNT),
        "limit_amt": F.lit(0).cast(S.AMOUNT),
        "usage_ratio": F.lit(0).cast(S.RATIO),
        "remaining_limit": F.lit(0).cast(S.REMAINING),
        "status": F.lit(S.MAPPING_ERROR),
        "note": F.lit(message),
        "limit_rows": limit_rows,
        **{c: F.lit(None).cast(S.FINE) for c in _FINE},
    }


#: What amounts have beyond nine decimals; NULL where nothing.
_FINE = ("exposure_fine", "limit_fine", "remaining_fine")
_STATUS_ALL = (*S.STATUS_COLUMNS, "unit_cd", "pf_key", "rf_key", "limit_rows", "_row_no", *_FINE)


def _synthetic(inputs: LimitInputs, message: str) -> DataFrame:
    """One MAPPING_ERROR row per date, for a table that lacks needed columns."""
    text = ("desk_cd", "portfolio_id", "product_type", "risk_factor", "ccy_cd", "unit_cd", "pf_key", "rf_key")
    row_no = inputs.exposures.schema["_row_no"].dataType
    return requested_dates(inputs).select(
        "base_dt", *[F.lit("").alias(c) for c in text], F.lit(None).cast(row_no).alias("_row_no")
    ).withColumns(_error_columns(message, F.lit(0).cast("long"))).select(*_STATUS_ALL)


def _all_mapping_errors(inputs: LimitInputs, exposures: DataFrame, message: str) -> DataFrame:
    """Every exposure row as MAPPING_ERROR, for a limit table that lacks needed columns."""
    names = {inputs.mapping.physical(c) for c in ("BaseDate", "PortfolioId", "RiskFactor")}
    limit_rows = F.lit(0).cast("long")
    if not names & set(inputs.missing_limit):
        counts = limit_lookup(inputs).select(*KEYS, "limit_rows")
        exposures = lookup_join(exposures, counts, KEYS, "left", bound=inputs.limit_facts)
        limit_rows = F.coalesce("limit_rows", limit_rows)
    rows = exposures.withColumns(_error_columns(message, limit_rows)).select(*_STATUS_ALL)
    empty = _synthetic(inputs, message).join(
        exposures.select("base_dt").distinct(), "base_dt", "left_anti"
    )
    return rows.unionByName(empty)


def requested_dates(inputs: LimitInputs) -> DataFrame:
    """The dates analysed, one row each."""
    return inputs.dates


# --- aggregates over the status table ------------------------------------------------------

def limit_kpis(status: DataFrame) -> DataFrame:
    """Row count, a count per state and three sums, per base date."""
    return status.groupBy("base_dt").agg(
        F.count("*").alias("total_count"),
        *[
            F.count_if(F.col("status") == s).alias(f"{s.lower()}_count")
            for s in S.STATUSES
        ],
        *[
            carried(F.sum(c), F.sum(fine))["amount"].alias(f"{c}_sum")
            for c, fine in zip(("exposure_amt", "limit_amt", "remaining_limit"), _FINE)
        ],
    )


def run_severity(kpis: DataFrame) -> DataFrame:
    """Overall severity of each date's run."""
    n = {s: F.col(f"{s.lower()}_count") for s in S.STATUSES}
    high = (n[S.BREACH] > 0) | (n[S.MAPPING_ERROR] > 0)
    medium = (
        (n[S.WARNING] > 0) | (n[S.NO_LIMIT] > 0) | (n[S.INVALID_LIMIT] > 0) | (n[S.DUPLICATE_LIMIT] > 0)
    )
    return kpis.select(
        "base_dt", F.when(high, "High").when(medium, "Medium").otherwise("Info").alias("severity")
    )


# Finding raised when a state occurs.
PRESENCE_FINDINGS = (
    (S.BREACH, "LIMIT_BREACH_DETECTED", "High"),
    (S.NO_LIMIT, "LIMIT_NO_LIMIT_DETECTED", "Medium"),
    (S.INVALID_LIMIT, "LIMIT_INVALID_LIMIT_DETECTED", "Medium"),
    (S.MAPPING_ERROR, "LIMIT_MAPPING_ERROR", "High"),
    (S.DUPLICATE_LIMIT, "LIMIT_DUPLICATE_LIMIT_DETECTED", "Medium"),
)


def limit_findings(inputs: LimitInputs, kpis: DataFrame) -> DataFrame:
    """Run findings per date: completion or no rows, states present, date and mapping problems."""
    by_date = requested_dates(inputs).join(kpis, "base_dt", "left").fillna(
        0, ["total_count", *[f"{s.lower()}_count" for s in S.STATUSES]]
    )
    raised: list[Column] = [
        F.when(~F.col("valid"), S.finding("LIMIT_BASEDATE_FORMAT_INVALID", "Low", F.col("requested"))),
        *[S.finding("COLUMN_MAPPING_FALLBACK", "Medium", w)
          for w in inputs.mapping.warnings],
    ]
    missing = inputs.missing_exposure or inputs.missing_limit
    if missing:
        raised.append(S.finding("LIMIT_MAPPING_ERROR", "High", f"missing columns: {', '.join(missing)}"))
    else:
        summary = F.concat_ws(
            ", ",
            F.concat(F.lit("rows="), F.col("total_count").cast("string")),
            F.concat(F.lit("warning="), F.col("warning_count").cast("string")),
            F.concat(F.lit("breach="), F.col("breach_count").cast("string")),
        )
        raised += [
            F.when(F.col("total_count") == 0, S.finding("LIMIT_MONITOR_NO_ROWS", "Low", "no exposure rows"))
            .otherwise(S.finding("LIMIT_MONITOR_COMPLETE", "Info", summary)),
            *[
                F.when(F.col(f"{s.lower()}_count") > 0, S.finding(code, severity, s))
                for s, code, severity in PRESENCE_FINDINGS
            ],
        ]
    return by_date.select(
        "base_dt", F.explode(F.array_compact(F.array(*raised))).alias("f")
    ).select("base_dt", "f.*")
