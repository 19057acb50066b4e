"""Amounts finer than nine decimals and as wide as a 96-bit decimal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from limitlens.operators import limits as L, profile as P
from limitlens.registry import tables as T

_MAX = "79228162514264337593543950335"


def _fine_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exposure and a limit text per order, close to each other or very wide, by the order's key."""
    c, kind = F.col("o_custkey"), F.pmod("o_orderkey", F.lit(6))
    text = lambda x: x.cast("string")
    hundredths = lambda x: F.concat(text(F.floor(x / 100)), F.lit("."), F.lpad(text(F.pmod(x, F.lit(100))), 2, "0"))
    exposure = (
        F.when(kind == 0, F.concat(text(c + 1), F.lit(".500000000001"))).when(kind == 1, F.concat(text(c + 1), F.lit(".5")))
        .when(kind == 2, hundredths(90 * c + 135)).when(kind == 3, F.concat(hundredths(90 * c + 134), F.lit("9" * 18)))
        .when(kind == 4, F.concat(F.lit("-7" + "0" * 19), F.lpad(text(c), 9, "0"))).otherwise("8" + "0" * 28)
    )
    limit = F.when(kind >= 4, F.concat(F.lit("7" + "0" * 19), F.lpad(text(c + 1), 9, "0"))).otherwise(F.concat(text(c + 1), F.lit(".5")))
    return T.table(spark, sf_dir, "orders").select("o_orderkey", exposure.alias("exposure"), limit.alias("limit_text"))


def limit_status_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of amounts that differ in the twelfth or twentieth decimal, or have 29 digits."""
    rows = _fine_amounts(spark, sf_dir)
    key = [F.lit("20260617").alias("BASE_DT"), F.concat(F.lit("P"), "o_orderkey").alias("PORTFOLIO_ID"), F.lit("F").alias("RISK_FACTOR")]
    exposures = rows.select(*key, F.col("exposure").alias("EXPOSURE_AMT"), F.col("o_orderkey").alias("ROW_NO"))
    limits = rows.select(*key, F.col("limit_text").alias("LIMIT_AMT"), F.lit("Y").alias("USE_YN"), F.col("o_orderkey").alias("ROW_NO"))
    status = L.limit_status(L.bind(exposures, limits, "20260617", row_no="ROW_NO"))
    return status.select("portfolio_id", "status")


def profile_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact sums and ranges of texts with up to 28 decimals and exponents."""
    orders = T.table(spark, sf_dir, "orders")
    texts = orders.select(
        F.concat(F.lit("0."), F.lpad((F.col("o_orderkey") + 1).cast("string"), 28, "0")).alias("tiny"),
        F.concat((F.col("o_custkey") + 1).cast("string"), F.lit("e-12")).alias("power"),
    )
    return P.numeric_profile(texts, exact=True).select("column_name", "non_null_count", "sum_exact", "min_exact", "max_exact")


QUERIES = {"limit_status_fine": limit_status_fine, "profile_fine": profile_fine}


def _decimal_text(value: str, places: int) -> str:
    """A whole number of 10^-places units as text without zeros at its end."""
    scale = f"CAST(1{'0' * places} AS HUGEINT)"
    return f"rtrim(rtrim(({value} // {scale}) || '.' || lpad(CAST({value} % {scale} AS VARCHAR), {places}, '0'), '0'), '.')"


_TINY = ", ".join(f"{_decimal_text(f'CAST({f}(o_orderkey + 1) AS HUGEINT)', 28)} AS {n}" for f, n in (("sum", "sum_exact"), ("min", "min_exact"), ("max", "max_exact")))
_POWER = ", ".join(f"{_decimal_text(f'CAST({f}(o_custkey + 1) AS HUGEINT)', 12)} AS {n}" for f, n in (("sum", "sum_exact"), ("min", "min_exact"), ("max", "max_exact")))
SQL = {
    # In units of 10^-20, or of one for the wide amounts: whole numbers, nothing is rounded.
    "limit_status_fine": f"""WITH a AS (SELECT o_orderkey, o_orderkey % 6 AS kind, CAST(o_custkey AS HUGEINT) AS c, CAST(100000000000000000000 AS HUGEINT) AS one FROM orders),
      b AS (SELECT o_orderkey, kind, CASE kind WHEN 0 THEN (c + 1) * one + one // 2 + 100000000 WHEN 1 THEN (c + 1) * one + one // 2
          WHEN 2 THEN (90 * c + 135) * (one // 100) WHEN 3 THEN (90 * c + 135) * (one // 100) - 1
          WHEN 4 THEN CAST(70000000000000000000000000000 AS HUGEINT) + c ELSE CAST(80000000000000000000000000000 AS HUGEINT) END AS e,
        CASE WHEN kind >= 4 THEN CAST(70000000000000000000000000000 AS HUGEINT) + c + 1 ELSE (c + 1) * one + one // 2 END AS l FROM a)
      SELECT 'P' || o_orderkey AS portfolio_id, CASE WHEN kind >= 4 AND e > CAST({_MAX} AS HUGEINT) THEN 'MAPPING_ERROR'
        WHEN e > l THEN 'BREACH' WHEN 10 * e >= 9 * l THEN 'WARNING' ELSE 'NORMAL' END AS status FROM b""",
    "profile_fine": f"""SELECT 'tiny' AS column_name, count(*) AS non_null_count, {_TINY} FROM orders
      UNION ALL SELECT 'power', count(*), {_POWER} FROM orders""",
}
