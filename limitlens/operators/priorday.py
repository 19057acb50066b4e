"""Comparison of base-date pairs: movement classes, top movers, findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from limitlens import schema as S
from limitlens.functions.dates import BaseDate
from limitlens.functions.numbers import difference
from limitlens.plans.order import ranked
from limitlens.plans.ranking import top_n_per_group
from limitlens.plans.local import local_table

PAIR = ("current_dt", "prior_dt")
_MEASURES = ("usage_ratio", "exposure_amt", "limit_amt", "remaining_limit")
NUMERIC_MOVEMENTS = ("Increased", "Decreased", "Unchanged")


def date_pairs(pairs: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """Normalised (current, prior) pairs; both sides must be given and differ."""
    checked = []
    for current, prior in pairs:
        cur, pri = BaseDate.of(current).normalized, BaseDate.of(prior).normalized
        if cur == pri:
            raise ValueError(f"the two base dates are the same: {cur}")
        checked.append((cur, pri))
    if not checked:
        raise ValueError("no date pair given")
    return list(dict.fromkeys(checked))


def _pair_rows(status: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Each status row once per pair and side it belongs to."""
    roles = local_table(
        status.sparkSession, [(c, c, p, True) for c, p in pairs] + [(p, c, p, False) for c, p in pairs],
        "base_dt string, current_dt string, prior_dt string, is_current boolean",
    )
    # A local relation of two rows per pair: Spark knows its size and broadcasts it by that.
    return status.join(roles, "base_dt")


def _candidates(status: DataFrame) -> DataFrame:
    """First row of each spelling and state of a key, where the row order is a number.

    A hash aggregate over fixed-width values: rows are merged on the map side without
    sorting them. All measures come from one row, since they are picked by the same order
    over the same rows. Row orders of other types leave the rows as they are.
    """
    keep = ("base_dt", "pf_key", "rf_key", "portfolio_id", "risk_factor", "status")
    if not isinstance(status.schema["_row_no"].dataType, T.NumericType):
        return status.select(*keep, "_row_no", *_MEASURES)
    return status.groupBy(*keep).agg(
        F.min("_row_no").alias("_row_no"), *[F.min_by(m, "_row_no").alias(m) for m in _MEASURES]
    )


def prior_day(status: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """One row per key and pair, with both sides and their differences.

    ``status`` holds the states of every date named. Where a key has several rows on a
    date the first by portfolio, factor, state and row order stands for it. Rows are first
    merged per spelling and state; picking the row and pairing the dates is then one
    combinable aggregate, where a full outer join of two picked sides would need three.
    """
    checked = date_pairs(pairs)
    dates = sorted({d for pair in checked for d in pair})
    rows = _pair_rows(_candidates(status.filter(F.col("base_dt").isin(dates))), checked)
    packed = F.struct("portfolio_id", "risk_factor", "status", "_row_no", *_MEASURES)
    paired = rows.groupBy(*PAIR, "pf_key", "rf_key").agg(
        F.min(F.when(F.col("is_current"), packed)).alias("c"),
        F.min(F.when(~F.col("is_current"), packed)).alias("p"),
    )
    columns: list[Column] = [
        F.coalesce("c.portfolio_id", "p.portfolio_id").alias("portfolio_id"),
        F.coalesce("c.risk_factor", "p.risk_factor").alias("risk_factor"),
        F.col("c.status").alias("current_status"),
        F.col("p.status").alias("prior_status"),
    ]
    for name in _MEASURES:
        current, prior = (F.coalesce(f"{s}.{name}", F.lit(0)) for s in ("c", "p"))
        columns += [
            current.alias(f"current_{name}"),
            prior.alias(f"prior_{name}"),
            (current - prior if name == "usage_ratio" else difference(current, prior)).alias(f"{name}_delta"),
        ]
    compared = paired.select(*PAIR, *columns)
    return compared.withColumn("movement", movement())


def movement() -> Column:
    """Movement class of a compared row."""
    current, prior = F.col("current_status"), F.col("prior_status")
    used, before = F.col("current_usage_ratio"), F.col("prior_usage_ratio")
    return (
        F.when(current.isNull(), "Resolved")
        .when(prior.isNull(), "New")
        .when(~current.isin(*S.NUMERIC_STATUSES) | (current != prior), "StateTransition")
        .when(used > before, "Increased")
        .when(used < before, "Decreased")
        .otherwise("Unchanged")
    )


def prior_day_kpis(compared: DataFrame) -> DataFrame:
    return compared.groupBy(*PAIR).agg(
        F.count("*").alias("compared_count"),
        *[F.count_if(F.col("movement") == m).alias(f"{m.lower()}_count") for m in S.MOVEMENTS],
    )


def prior_day_movers(compared: DataFrame, n: int = 10) -> DataFrame:
    """Largest usage changes among keys in the same numeric state on both dates."""
    movers = compared.filter(F.col("movement").isin(*NUMERIC_MOVEMENTS))
    order = [F.desc(F.abs("usage_ratio_delta")), F.asc("portfolio_id"), F.asc("risk_factor")]
    return top_n_per_group(movers, list(PAIR), order, n)


def duplicate_keys(status: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Keys with several rows on one side of a pair."""
    rows = _pair_rows(status, date_pairs(pairs))
    side = F.when(F.col("is_current"), "Current").otherwise("Prior").alias("side")
    return (
        rows.groupBy(*PAIR, side, "base_dt", "pf_key", "rf_key")
        .agg(F.count("*").alias("row_count"), F.min(F.struct("portfolio_id", "risk_factor")).alias("k"))
        .filter("row_count > 1")
        .select(*PAIR, "side", "base_dt", "k.portfolio_id", "k.risk_factor", "row_count")
    )


def empty_sides(spark: SparkSession, status: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Sides of a pair that have no row at all."""
    checked = date_pairs(pairs)
    wanted = local_table(
        spark, [(c, p, s, c if s == "Current" else p) for c, p in checked for s in ("Current", "Prior")],
        "current_dt string, prior_dt string, side string, base_dt string",
    )
    return wanted.join(status.select("base_dt").distinct(), "base_dt", "left_anti").select(
        *PAIR, "side", "base_dt"
    )


def prior_day_findings(
    status: DataFrame, compared: DataFrame, pairs: Sequence[tuple[str, str]]
) -> DataFrame:
    """Empty sides, duplicate keys and state transitions as findings."""
    def shaped(df: DataFrame, code: str, severity: str, message: Column) -> DataFrame:
        return df.select(*PAIR, S.finding(code, severity, message).alias("f")).select(*PAIR, "f.*")

    slash, key = F.lit("/"), ("portfolio_id", "risk_factor")
    empty = shaped(
        empty_sides(status.sparkSession, status, pairs), "BASE_DT_FORMAT_MISMATCH", "Low",
        F.concat_ws(" ", "side", "base_dt"),
    )
    duplicate = shaped(
        duplicate_keys(status, pairs), "PRIOR_DAY_DUPLICATE_KEY", "Medium",
        F.concat(F.col("side"), F.lit(" "), F.col(key[0]), slash, F.col(key[1])),
    )
    changed = shaped(
        compared.filter(F.col("movement") == "StateTransition"), "PRIOR_DAY_STATE_TRANSITION", "Medium",
        F.concat(
            F.col(key[0]), slash, F.col(key[1]), F.lit(" "),
            F.col("prior_status"), F.lit(" to "), F.col("current_status"),
        ),
    )
    return empty.unionByName(duplicate).unionByName(changed)


def ranked_comparison(compared: DataFrame) -> DataFrame:
    """Compared rows with their place in the order by dates, portfolio and factor."""
    return ranked(compared, (*PAIR, "portfolio_id", "risk_factor"))


def ordered_comparison(compared: DataFrame) -> DataFrame:
    return compared.orderBy(*PAIR, "portfolio_id", "risk_factor")


def ordered_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*PAIR, "code", "message")
