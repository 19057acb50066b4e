"""Nine reconciliation checks over exposures, limits and the status table.

Exceptions are kept counted (``n``): rows that raise the same exception for the same key
are one row. Exposure rows are grouped before any join, so a hot key costs one row.
``plans.expand.expand_counts`` gives one row per exception.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from limitlens import schema as S
from limitlens.functions.text import fold
from limitlens.operators.limits import KEYS, LimitInputs, requested_dates
from limitlens.plans.order import ranked
from limitlens.plans.reuse import materialized

_ORDER = {code: i for i, code in enumerate(S.RECON_CODES, start=1)}
EXCEPTION_COLUMNS = (
    "base_dt", "code", "severity", "severity_rank", "check_order", "message",
    "portfolio_id", "risk_factor", "n",
)


def _raise(code: str, severity: str, message: Column | str, n: Column | None = None) -> Column:
    text = message if isinstance(message, Column) else F.lit(message)
    return F.struct(
        F.lit(code).alias("code"),
        F.lit(severity).alias("severity"),
        F.lit(S.SEVERITY_RANK[severity]).alias("severity_rank"),
        F.lit(_ORDER.get(code, 0)).alias("check_order"),
        text.alias("message"),
        (F.col("n") if n is None else n).cast("long").alias("n"),
    )


def _exceptions(df: DataFrame, raised: list[Column]) -> DataFrame:
    """One row per exception struct that is not NULL."""
    for name in ("portfolio_id", "risk_factor"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(""))
    return df.select(
        "base_dt", "portfolio_id", "risk_factor",
        F.explode(F.array_compact(F.array(*raised))).alias("e"),
    ).select("base_dt", "e.*", "portfolio_id", "risk_factor").select(*EXCEPTION_COLUMNS)


def exposure_facts(status: DataFrame) -> DataFrame:
    """Status rows grouped by everything an exception can depend on.

    A hot key becomes one row per spelling, currency and state. All checks of single keys
    read this table, so the exposures are read once for them.
    """
    return status.groupBy(
        *KEYS, "portfolio_id", "risk_factor", "ccy_cd", "unit_cd", "status", "note", "limit_rows"
    ).agg(F.count("*").alias("n"), F.sum("exposure_amt").alias("amount"))


def key_facts(inputs: LimitInputs, facts: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Exposure rows per key, spelling, currency and unit, with the limit rows of the key.

    Where exposures lack a column the status table has no row per exposure row; the rows
    are then counted from the exposures.
    """
    keep = (*KEYS, "portfolio_id", "risk_factor", "ccy_cd", "unit_cd")
    if not inputs.missing_exposure:
        return facts.select(*keep, "n", "limit_rows")
    counted = inputs.on_dates(inputs.exposures).groupBy(*keep).agg(F.count("*").alias("n"))
    if groups is None:
        return counted.withColumn("limit_rows", F.lit(0).cast("long"))
    return counted.join(groups.select(*KEYS, "limit_rows"), list(KEYS), "left")


def limit_groups(facts: DataFrame) -> DataFrame:
    """Limit rows per key: count, unusable amounts; a key is spelled as in its first row."""
    return facts.groupBy(*KEYS).agg(
        F.sum("limit_rows").alias("limit_rows"),
        F.sum("nonpositive").alias("nonpositive"),
        F.min(F.struct("_row_no", "portfolio_id", "risk_factor")).alias("first"),
    ).select(*KEYS, "limit_rows", "nonpositive", "first.portfolio_id", "first.risk_factor")


def recon_exceptions(inputs: LimitInputs, status: DataFrame) -> DataFrame:
    """All exceptions, counted: those of the states and those of the nine checks.

    The grouped exposures and limits are written once, to be read by every check.
    """
    facts = materialized(exposure_facts(status))
    can_exposure, can_limit = _can_key(inputs, "exposure"), _can_key(inputs, "limit")
    limits = inputs.limit_facts if can_limit else None
    groups = limit_groups(limits) if limits is not None else None
    inputs.find_dates(facts, inputs.limits if limits is None else limits)
    keyed = key_facts(inputs, facts, groups)
    parts = [
        _from_states(facts),
        _from_dates(inputs, facts, keyed if can_exposure and can_limit else None, groups),
    ]
    if inputs.mapping.warnings or not all(d.valid for d in inputs.requested):
        parts.append(_from_parameters(inputs))
    if groups is not None:
        parts.append(_from_limits(inputs, groups, keyed if can_exposure else None))
    if inputs.currency_applicable:
        parts.append(_mismatch(limits, keyed, "ccy_cd", S.RECON_CURRENCY_MISMATCH))
    if inputs.unit_applicable:
        parts.append(_mismatch(limits, keyed, "unit_cd", S.RECON_UNIT_MISMATCH))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _can_key(inputs: LimitInputs, side: str) -> bool:
    missing = inputs.missing_exposure if side == "exposure" else inputs.missing_limit
    names = {inputs.mapping.physical(c) for c in ("PortfolioId", "RiskFactor")}
    return not names & set(missing)


def _has(inputs: LimitInputs, side: str, logical: str) -> bool:
    missing = inputs.missing_exposure if side == "exposure" else inputs.missing_limit
    return inputs.mapping.physical(logical) not in missing


def _from_parameters(inputs: LimitInputs) -> DataFrame:
    """Exceptions of the request itself: unusable base date, mapping fallback."""
    one = F.lit(1)
    return _exceptions(requested_dates(inputs), [
        F.when(~F.col("valid"), _raise(
            S.RECON_BASEDATE_MISMATCH, "Low",
            F.concat(F.lit("unusable base date: "), F.col("requested")), one,
        )),
        *[_raise("COLUMN_MAPPING_FALLBACK", "Medium", w, one) for w in inputs.mapping.warnings],
    ])


def _from_states(facts: DataFrame) -> DataFrame:
    """One exception per row in a non-numeric state, a second one where no limit exists."""
    grouped = facts.filter(~F.col("status").isin(*S.NUMERIC_STATUSES))
    state = F.col("status")
    return _exceptions(grouped, [
        *[
            F.when(state == code, _raise(code, severity, F.col("note")))
            for code, severity in (
                (S.NO_LIMIT, "Medium"), (S.INVALID_LIMIT, "Medium"),
                (S.DUPLICATE_LIMIT, "Medium"), (S.MAPPING_ERROR, "High"),
            )
        ],
        F.when(state == S.NO_LIMIT, _raise(
            S.RECON_EXPOSURE_NO_LIMIT, "Medium", "exposure without a limit row on its base date")),
    ])


def _from_limits(inputs: LimitInputs, groups: DataFrame, keyed: DataFrame | None) -> DataFrame:
    """Limits without exposure, duplicate limits, limits that are not positive."""
    orphan = F.lit(False)
    if keyed is not None:
        seen = keyed.select(*KEYS).distinct().withColumn("seen", F.lit(True))
        groups = groups.join(seen, list(KEYS), "left")
        orphan = F.col("seen").isNull()
    one = F.lit(1)
    raised = [
        F.when(orphan, _raise(
            S.RECON_LIMIT_NO_EXPOSURE, "Low", "limit without an exposure row on its base date", one)),
        F.when(F.col("limit_rows") > 1, _raise(
            S.RECON_DUPLICATE_LIMIT, "Medium",
            F.concat(F.col("limit_rows").cast("string"), F.lit(" limit rows for one key")), one)),
    ]
    if _has(inputs, "limit", "LimitAmount"):
        raised.append(F.when(F.col("nonpositive") > 0, _raise(
            S.RECON_NONPOSITIVE_LIMIT, "Medium", "limit amount is not a positive number",
            F.col("nonpositive"))))
    return _exceptions(groups, raised)


def _mismatch(limit_facts: DataFrame, keyed: DataFrame, column: str, code: str) -> DataFrame:
    """Exposure rows whose code differs from a limit row's code; blanks never differ."""
    limits = (
        limit_facts.filter(F.col(column) != "")
        .groupBy(*KEYS, fold(column).alias("limit_key"))
        .agg(F.min(column).alias("limit_code"))
    )
    pairs = (
        keyed.filter(F.col(column) != "")
        .join(limits, list(KEYS))
        .filter(fold(column) != F.col("limit_key"))
    )
    message = F.concat(F.lit("exposure "), F.col(column), F.lit(", limit "), F.col("limit_code"))
    return _exceptions(pairs, [_raise(code, "Medium", message)])


# What a date is summed up by, over all tables.
_DATE_METRICS = {
    "wanted": "long", "source_rows": "long", "source_amt": S.AMOUNT, "unparsed": "long",
    "status_rows": "long", "status_amt": S.AMOUNT, "join_rows": "long", "limit_count": "long",
}


def _per_date(df: DataFrame, **values: Column) -> DataFrame:
    return df.select("base_dt", *[
        values.get(m, F.lit(None)).cast(kind).alias(m) for m, kind in _DATE_METRICS.items()
    ])


def _from_dates(
    inputs: LimitInputs, facts: DataFrame, keyed: DataFrame | None, groups: DataFrame | None
) -> DataFrame:
    """Checks of whole dates: other dates only, row amplification, sum balance.

    The source side is summed from the exposures themselves, apart from the status table.
    """
    one, n = F.lit(1), F.col("n")
    parts = [
        _per_date(requested_dates(inputs), wanted=one),
        _per_date(
            inputs.on_dates(inputs.exposures), source_rows=one, source_amt=F.col("exposure_amt"),
            unparsed=F.col("exposure_amt").isNull().cast("int"),
        ),
        _per_date(facts, status_rows=n, status_amt=F.col("amount")),
    ]
    if keyed is not None:
        fanned = n * F.greatest(one, F.coalesce("limit_rows", one))
        parts.append(_per_date(keyed, join_rows=fanned))
    if groups is None:
        parts.append(_per_date(inputs.on_dates(inputs.limits), limit_count=one))
    else:
        parts.append(_per_date(groups, limit_count=F.col("limit_rows")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    # One aggregate over all sides instead of a join per side.
    dates = rows.groupBy("base_dt").agg(
        *[F.sum(m).alias(m) for m in _DATE_METRICS]
    ).filter("wanted > 0")

    def other_dates(table: DataFrame, grouped: DataFrame | None) -> Column:
        """Whether the table has any dated row: stops at the first one found.

        Where every date is analysed the grouped rows tell as much and are quicker to read.
        """
        read = grouped if inputs.every_date and grouped is not None else table
        found = read.filter(F.col("base_dt") != "").select(F.lit(True)).limit(1)
        return F.coalesce(found.scalar(), F.lit(False))

    def count(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    raised: list[Column] = []
    exposure_rows = None if inputs.missing_exposure else facts
    for side, counted, table, grouped in (
        ("exposure", "source_rows", inputs.exposures, exposure_rows),
        ("limit", "limit_count", inputs.limits, groups),
    ):
        if _has(inputs, side, "BaseDate"):
            raised.append(F.when((count(counted) == 0) & other_dates(table, grouped), _raise(
                S.RECON_BASEDATE_MISMATCH, "Low", f"only other base dates have {side} rows", one)))
    # Where keys cannot be built the rows analysed stand for the rows joined.
    potential = count("status_rows") if keyed is None else count("join_rows")
    compared = F.greatest(count("status_rows"), potential)
    raised.append(F.when(compared > count("source_rows"), _raise(
        S.RECON_ROW_AMPLIFICATION, "High", "more rows analysed or joined than exposure rows", one)))
    unparsed = count("unparsed") > 0
    if not _has(inputs, "exposure", "BaseDate"):
        unparsed = F.coalesce(
            inputs.exposures.select(F.lit(True)).limit(1).scalar(), F.lit(False)
        )
    raised.append(F.when(
        (count("source_amt") != count("status_amt")) | unparsed,
        _raise(S.RECON_SUM_BALANCE, "High", "exposure sum differs or amounts are unusable", one),
    ))
    return _exceptions(dates, raised)


def recon_summary(inputs: LimitInputs, exceptions: DataFrame) -> DataFrame:
    """Nine rows per date: applicability, exception count and highest severity."""
    applicable = {
        S.RECON_CURRENCY_MISMATCH: inputs.currency_applicable,
        S.RECON_UNIT_MISMATCH: inputs.unit_applicable,
    }
    checks = F.array(*[
        F.struct(
            F.lit(_ORDER[c]).alias("check_order"),
            F.lit(c).alias("code"),
            F.lit(applicable.get(c, True)).alias("applicable"),
        )
        for c in S.RECON_CODES
    ])
    counted = exceptions.groupBy("base_dt", "code").agg(
        F.sum("n").alias("n"), F.max("severity_rank").alias("severity_rank")
    )
    return (
        requested_dates(inputs)
        .select("base_dt", F.explode(checks).alias("c"))
        .select("base_dt", "c.*")
        .join(counted, ["base_dt", "code"], "left")
        .select(
            "base_dt", "check_order", "code", "applicable",
            F.coalesce("n", F.lit(0).cast("long")).alias("exception_count"),
            S.severity_of(F.coalesce("severity_rank", F.lit(0))).alias("max_severity"),
        )
    )


def recon_result(summary: DataFrame) -> DataFrame:
    """PASS / FAIL per date; failing is decided by code, not by severity."""
    failing = F.sum(
        F.when(F.col("code").isin(*S.RECON_FAIL_CODES), F.col("exception_count")).otherwise(0)
    )
    return summary.groupBy("base_dt").agg(
        F.count("*").alias("check_count"),
        failing.alias("failing"),
        F.sum("exception_count").alias("recon_exceptions"),
    ).select(
        "base_dt", "check_count", "recon_exceptions",
        F.when(F.col("check_count") == 0, "NOT_RUN")
        .when(F.col("failing") == 0, "PASS").otherwise("FAIL").alias("state"),
    )


def join_audit(inputs: LimitInputs, status: DataFrame) -> DataFrame:
    """Duplicate limit keys and rows, blocked exposure rows, applicability, per date."""
    repeated = limit_groups(inputs.limit_facts).filter("limit_rows > 1")
    duplicates = repeated.groupBy("base_dt").agg(
        F.count("*").alias("duplicate_keys"), F.sum("limit_rows").alias("duplicate_rows")
    )
    blocked = status.filter(F.col("status") == S.DUPLICATE_LIMIT).groupBy("base_dt").agg(
        F.count("*").alias("blocked_rows")
    )
    names = ("duplicate_keys", "duplicate_rows", "blocked_rows")
    return (
        requested_dates(inputs)
        .join(duplicates, "base_dt", "left")
        .join(blocked, "base_dt", "left")
        .fillna(0, list(names))
        .select(
            "base_dt", "requested", "valid", *names,
            F.lit(inputs.currency_applicable).alias("currency_applicable"),
            F.lit(inputs.unit_applicable).alias("unit_applicable"),
        )
    )


def ranked_exceptions(exceptions: DataFrame) -> DataFrame:
    """Exceptions with their place in that order; rows that it leaves equal follow code and spelling."""
    order = ("base_dt", "check_order", fold("portfolio_id"), fold("risk_factor"), "code", "portfolio_id", "risk_factor")
    return ranked(exceptions, order)


def ordered_exceptions(exceptions: DataFrame) -> DataFrame:
    """State exceptions first, then the checks in their order, portfolio, factor, message."""
    return exceptions.orderBy(
        "base_dt", "check_order", fold("portfolio_id"), fold("risk_factor"), "message"
    )
