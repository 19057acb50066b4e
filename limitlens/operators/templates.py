"""Parameterised SQL reports over prepared exposure and limit tables.

The tables carry BASE_DT, DESK_CD, PORTFOLIO_ID, RISK_FACTOR, EXPOSURE_AMT (numeric) and
BASE_DT, PORTFOLIO_ID, RISK_FACTOR, LIMIT_AMT (numeric), USE_YN. The base date is a named
parameter; on tables partitioned by BASE_DT it prunes partitions. Unlike the seven-state
monitor the report sums exposures first, ignores limits not in use, and lets duplicate
limits repeat rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from limitlens.functions.numbers import difference, nine_tenths_reached, quotient
from limitlens.operators.limits import LimitInputs
from limitlens.plans.order import ranked
from limitlens.plans.joins import lookup_join


def prepared(inputs: LimitInputs) -> tuple[DataFrame, DataFrame]:
    """Both tables of a bound input in the shape the reports read.

    Identifiers and flags are the trimmed texts: the reports compare them as they are spelled.
    """
    exposures = inputs.exposures.select(
        F.col("base_dt").alias("BASE_DT"), F.col("desk_cd").alias("DESK_CD"),
        F.col("portfolio_id").alias("PORTFOLIO_ID"), F.col("risk_factor").alias("RISK_FACTOR"),
        F.col("exposure_amt").alias("EXPOSURE_AMT"),
    )
    limits = inputs.limits.select(
        F.col("base_dt").alias("BASE_DT"), F.col("portfolio_id").alias("PORTFOLIO_ID"),
        F.col("risk_factor").alias("RISK_FACTOR"), F.col("limit_amt").alias("LIMIT_AMT"),
        F.col("use_yn").alias("USE_YN"),
    )
    return exposures, limits


def _run(sql: str, base_dt: str, **tables: DataFrame) -> DataFrame:
    spark = next(iter(tables.values())).sparkSession
    return spark.sql(sql, args={"BASE_DT": base_dt}, **tables)


def limit_usage(exposures: DataFrame, limits: DataFrame, base_dt: str) -> DataFrame:
    """Usage rate in percent and one of four states per desk, portfolio and factor.

    A zero limit with zero exposure would divide by zero; it counts as NORMAL.
    """
    rows = _run(
        """
        WITH used AS (
          SELECT BASE_DT, DESK_CD, PORTFOLIO_ID, RISK_FACTOR, sum(EXPOSURE_AMT) AS EXPOSURE_AMT
          FROM {exposures} WHERE BASE_DT = :BASE_DT
          GROUP BY BASE_DT, DESK_CD, PORTFOLIO_ID, RISK_FACTOR),
        active AS (
          SELECT PORTFOLIO_ID, RISK_FACTOR, LIMIT_AMT
          FROM {limits} WHERE BASE_DT = :BASE_DT AND USE_YN = 'Y')
        SELECT u.BASE_DT, u.DESK_CD, u.PORTFOLIO_ID, u.RISK_FACTOR, u.EXPOSURE_AMT, a.LIMIT_AMT
        FROM used u LEFT JOIN active a USING (PORTFOLIO_ID, RISK_FACTOR)
        """,
        base_dt, exposures=exposures, limits=limits,
    )
    used, limit = F.abs("EXPOSURE_AMT"), F.col("LIMIT_AMT")
    return rows.withColumns({
        "LIMIT_USAGE_RATE": F.round(quotient(used, limit), 4) * 100,
        "LIMIT_STATUS": F.when(limit.isNull(), "NO_LIMIT")
        .when(used > limit, "BREACH")
        .when((limit != 0) & nine_tenths_reached(used, limit), "WARNING")
        .otherwise("NORMAL"),
    })


def ranked_usage(usage: DataFrame) -> DataFrame:
    """Usage rows with their place: by status, highest rate first, then by what they are about."""
    order = ("LIMIT_STATUS", F.desc_nulls_last("LIMIT_USAGE_RATE"), "DESK_CD", "PORTFOLIO_ID", "RISK_FACTOR", "LIMIT_AMT")
    return ranked(usage, order)


def ordered_usage(usage: DataFrame) -> DataFrame:
    return usage.orderBy("LIMIT_STATUS", F.desc("LIMIT_USAGE_RATE"))


def row_count(exposures: DataFrame, base_dt: str) -> DataFrame:
    return _run(
        "SELECT BASE_DT, count(*) AS ROW_CNT FROM {exposures} WHERE BASE_DT = :BASE_DT GROUP BY BASE_DT",
        base_dt, exposures=exposures,
    )


def unmapped(exposures: DataFrame, limits: DataFrame, base_dt: str) -> DataFrame:
    """Rows per key without a limit in use. Rows are counted per key before the anti join."""
    return _run(
        """
        SELECT e.PORTFOLIO_ID, e.RISK_FACTOR, e.ROW_CNT
        FROM (SELECT PORTFOLIO_ID, RISK_FACTOR, count(*) AS ROW_CNT
              FROM {exposures} WHERE BASE_DT = :BASE_DT GROUP BY PORTFOLIO_ID, RISK_FACTOR) e
        LEFT ANTI JOIN (SELECT PORTFOLIO_ID, RISK_FACTOR FROM {limits}
              WHERE BASE_DT = :BASE_DT AND USE_YN = 'Y') l
          ON l.PORTFOLIO_ID = e.PORTFOLIO_ID AND l.RISK_FACTOR = e.RISK_FACTOR
        """,
        base_dt, exposures=exposures, limits=limits,
    )


def control_total(exposures: DataFrame, base_dt: str) -> DataFrame:
    return _run(
        "SELECT sum(EXPOSURE_AMT) AS EXPOSURE_SUM FROM {exposures} WHERE BASE_DT = :BASE_DT",
        base_dt, exposures=exposures,
    )


def filtered_rows(exposures: DataFrame, base_dt: str) -> DataFrame:
    return _run(
        """SELECT BASE_DT, PORTFOLIO_ID, RISK_FACTOR, EXPOSURE_AMT
           FROM {exposures} WHERE BASE_DT = :BASE_DT""",
        base_dt, exposures=exposures,
    )


def grouped_exposure(exposures: DataFrame, base_dt: str) -> DataFrame:
    return _run(
        """SELECT BASE_DT, PORTFOLIO_ID, RISK_FACTOR, sum(EXPOSURE_AMT) AS EXPOSURE_AMT
           FROM {exposures} WHERE BASE_DT = :BASE_DT GROUP BY BASE_DT, PORTFOLIO_ID, RISK_FACTOR""",
        base_dt, exposures=exposures,
    )


def usage_ratio(exposures: DataFrame, limits: DataFrame, base_dt: str) -> DataFrame:
    """Ratio per exposure row and limit in use (inner join, zero limit gives NULL).

    Limits beyond the broadcast size are joined on salted keys.
    """
    active = _run(
        "SELECT PORTFOLIO_ID, RISK_FACTOR, LIMIT_AMT FROM {limits} WHERE BASE_DT = :BASE_DT AND USE_YN = 'Y'",
        base_dt, limits=limits,
    )
    rows = lookup_join(filtered_rows(exposures, base_dt), active, ("PORTFOLIO_ID", "RISK_FACTOR"), "inner")
    return rows.select(
        "BASE_DT", "PORTFOLIO_ID", "RISK_FACTOR", "EXPOSURE_AMT", "LIMIT_AMT",
        quotient(F.abs("EXPOSURE_AMT"), F.col("LIMIT_AMT")).alias("USAGE_RATIO"),
    )


def exposure_delta(exposures: DataFrame, current: str, prior: str) -> DataFrame:
    """Exposure of each key that has rows on both dates, and the change.

    The rows of a key are summed per date, so a key with many rows gives one row instead of
    every pairing of them; where a key has one row per date this is the plain self join.
    """
    sums = exposures.sparkSession.sql(
        """
        SELECT PORTFOLIO_ID, RISK_FACTOR,
          sum(CASE WHEN BASE_DT = :CURRENT_BASE_DT THEN EXPOSURE_AMT END) AS CURRENT_EXPOSURE_AMT,
          sum(CASE WHEN BASE_DT = :PRIOR_BASE_DT THEN EXPOSURE_AMT END) AS PRIOR_EXPOSURE_AMT
        FROM {rows} WHERE BASE_DT IN (:CURRENT_BASE_DT, :PRIOR_BASE_DT)
        GROUP BY PORTFOLIO_ID, RISK_FACTOR
        HAVING count_if(BASE_DT = :CURRENT_BASE_DT) > 0 AND count_if(BASE_DT = :PRIOR_BASE_DT) > 0
        """,
        args={"CURRENT_BASE_DT": current, "PRIOR_BASE_DT": prior}, rows=exposures,
    )
    change = difference(F.col("CURRENT_EXPOSURE_AMT"), F.col("PRIOR_EXPOSURE_AMT"))
    return sums.withColumn("EXPOSURE_DELTA", change)


def duplicate_join_keys(table: DataFrame, base_dt: str) -> DataFrame:
    return _run(
        """SELECT BASE_DT, PORTFOLIO_ID, RISK_FACTOR, count(*) AS ROW_COUNT
           FROM {rows} WHERE BASE_DT = :BASE_DT
           GROUP BY BASE_DT, PORTFOLIO_ID, RISK_FACTOR HAVING count(*) > 1""",
        base_dt, rows=table,
    )


def component_rows(components: DataFrame, base_dt: str) -> DataFrame:
    """Source amounts of the capital components on a date."""
    return _run(
        "SELECT base_dt, component_id, source_amount FROM {components} WHERE base_dt = :BASE_DT",
        base_dt, components=components,
    )


def component_results(results: DataFrame, base_dt: str) -> DataFrame:
    """Calculated amounts of the capital components on a date."""
    return _run(
        "SELECT base_dt, component_id, calculated_amount FROM {results} WHERE base_dt = :BASE_DT",
        base_dt, results=results,
    )
