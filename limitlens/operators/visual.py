"""Aggregates behind the risk charts, per base date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from limitlens import schema as S
from limitlens.functions.numbers import quotient, round_half_up
from limitlens.functions.text import fold_key
from limitlens.plans.order import ranked
from limitlens.plans.ranking import top_n_per_group

DEFAULT_TOP_N = 10


def status_mix(status: DataFrame) -> DataFrame:
    """Count and share of all seven states, zero-filled. One pass, no join."""
    counts = status.groupBy("base_dt").agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in S.STATUSES],
    )
    rows = F.array(*[
        F.struct(
            F.lit(i).alias("status_order"), F.lit(s).alias("status"), F.col(s).alias("row_count")
        )
        for i, s in enumerate(S.STATUSES, start=1)
    ])
    share = F.col("row_count").cast("decimal(20,0)") / F.col("total").cast("decimal(20,0)")
    return (
        counts.select("base_dt", "total", F.explode(rows).alias("r"))
        .select("base_dt", "total", "r.*")
        .select("base_dt", "status_order", "status", "row_count", round_half_up(share, 4).alias("ratio"))
    )


def top_exposures(status: DataFrame, n: int = DEFAULT_TOP_N) -> DataFrame:
    """Largest exposures by magnitude with their rank."""
    if n < 0:
        raise ValueError("top n must not be negative")
    rows = status.select(
        "base_dt", "portfolio_id", "risk_factor", "ccy_cd", "exposure_amt",
        F.abs("exposure_amt").alias("abs_exposure"), "usage_ratio", "status", "_row_no",
    )
    order = [F.desc("abs_exposure"), F.asc("portfolio_id"), F.asc("risk_factor"), F.asc("_row_no")]
    return top_n_per_group(rows, ["base_dt"], order, n).drop("_row_no")


def concentration(status: DataFrame, n: int = DEFAULT_TOP_N) -> DataFrame:
    """Total, top-n share and Herfindahl index of the exposure magnitudes.

    The index is sum(a^2) / sum(a)^2, so totals and index come from one aggregate.
    """
    size = F.abs("exposure_amt")
    totals = status.groupBy("base_dt").agg(
        F.sum(size).alias("total_abs_exposure"),
        F.sum(F.pow(size.cast("double"), F.lit(2.0))).alias("squares"),
        F.count("*").alias("row_count"),
    )
    top = top_exposures(status, n).groupBy("base_dt").agg(
        F.sum("abs_exposure").alias("top_abs_exposure"), F.count("*").alias("top_count")
    )
    total = F.col("total_abs_exposure")
    top_sum = F.coalesce("top_abs_exposure", F.lit(0).cast(S.AMOUNT))
    share = quotient(top_sum, total)
    hhi = F.try_divide(F.col("squares"), F.pow(total.cast("double"), F.lit(2.0)))
    zero = total == 0
    return totals.join(top, "base_dt", "left").select(
        "base_dt",
        "total_abs_exposure",
        top_sum.alias("top_abs_exposure"),
        F.when(zero, 0).otherwise(round_half_up(share, 4)).alias("top_share"),
        F.when(zero, 0.0).otherwise(round_half_up(hhi, 6)).alias("hhi"),
        "row_count",
        F.coalesce("top_count", F.lit(0).cast("long")).alias("top_count"),
    )


def heatmap_grade(ratio: Column) -> Column:
    """LOW below 0.8, MID up to 1.0, HIGH above."""
    return F.when(ratio < 0.8, "LOW").when(ratio <= 1, "MID").otherwise("HIGH")


def heatmap(status: DataFrame) -> DataFrame:
    """Grade of every row's usage."""
    return status.select(
        "base_dt", "portfolio_id", "risk_factor", "usage_ratio",
        heatmap_grade(F.col("usage_ratio")).alias("grade"), "status", "_row_no",
    )


def ranked_heatmap(rows: DataFrame) -> DataFrame:
    """Heatmap rows with their place in the order by portfolio, factor, date and row."""
    return ranked(rows, ("portfolio_id", "risk_factor", "base_dt", "_row_no"))


def ordered_heatmap(rows: DataFrame) -> DataFrame:
    return rows.orderBy("portfolio_id", "risk_factor", "base_dt")


def visual_findings(status: DataFrame) -> DataFrame:
    """Mixed currencies and a zero concentration denominator."""
    currencies = (
        status.select("base_dt", fold_key("ccy_cd").alias("ccy")).filter("ccy <> ''").distinct()
        .groupBy("base_dt").agg(F.array_sort(F.collect_list("ccy")).alias("codes"))
    )
    totals = status.groupBy("base_dt").agg(F.sum(F.abs("exposure_amt")).alias("total"))
    raised = [
        F.when(F.size("codes") > 1, S.finding(
            "MIXED_CURRENCY", "Medium", F.array_join("codes", "/"))),
        F.when(F.col("total") == 0, S.finding(
            "VISUAL_CONCENTRATION_ZERO_DENOMINATOR", "Low", "all exposures are zero")),
    ]
    return (
        totals.join(currencies, "base_dt", "left")
        .select("base_dt", F.explode(F.array_compact(F.array(*raised))).alias("f"))
        .select("base_dt", "f.*")
    )


def currency_codes(status: DataFrame) -> DataFrame:
    """(base_dt, ccy, n) of the dates with several currencies: a row per code, however many."""
    codes = (
        status.select("base_dt", fold_key("ccy_cd").alias("ccy")).filter("ccy <> ''")
        .groupBy("base_dt", "ccy").agg(F.count("*").alias("n"))
    )
    mixed = codes.groupBy("base_dt").agg(F.min("ccy").alias("low"), F.max("ccy").alias("high")).filter("low <> high")
    return codes.join(mixed.select("base_dt"), "base_dt")
