"""Exposure, limit and log tables derived from the driver's tables.

Every derivation is given twice, as DataFrame code and as a SQL common table expression,
so that a query and its oracle start from the same rows. Derived tables cover the whole
driver tables.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from limitlens.operators.limits import LimitInputs, bind
from limitlens.sources.mapping import ColumnMapping

CURRENT = "19960101"
PRIOR = "19951201"


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. Its schema is read from the file once, not for every use."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def orders_by_nation(spark: SparkSession, sf_dir: str, months: tuple[str, ...] = ()) -> DataFrame:
    """Orders with their customer's nation and segment; the base date is the order's month.

    ``months`` (base dates) become ranges of the order date, which reach the scan.
    """
    orders = table(spark, sf_dir, "orders")
    if months:
        wanted = F.lit(False)
        for month in months:
            start = F.lit(f"{month[:4]}-{month[4:6]}-01").cast("timestamp_ntz")
            wanted = wanted | (
                (F.col("o_orderdate") >= start) & (F.col("o_orderdate") < start + F.expr("INTERVAL 1 MONTH"))
            )
        orders = orders.filter(wanted)
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).withColumn(
        "base_dt", F.concat(F.date_format("o_orderdate", "yyyyMM"), F.lit("01"))
    )


def _portfolio(nation: Column) -> Column:
    return F.concat(F.lit("PF_"), nation.cast("string"))


def exposures(spark: SparkSession, sf_dir: str, months: tuple[str, ...] = ()) -> DataFrame:
    """One exposure per order.

    Finished orders are short positions; urgent low-value orders carry no usable amount.
    Portfolio and factor spellings vary in case and white space.
    """
    rows = orders_by_nation(spark, sf_dir, months)
    price = F.col("o_totalprice").cast("decimal(18,2)")
    signed = F.when(F.col("o_orderstatus") == "F", -price).otherwise(price)
    odd = F.col("c_mktsegment") == "MACHINERY"
    return rows.select(
        F.col("base_dt").alias("BASE_DT"),
        F.col("c_mktsegment").alias("DESK_CD"),
        F.when(odd, F.concat(F.lit("pf_"), F.col("c_nationkey").cast("string"), F.lit(" ")))
        .otherwise(_portfolio(F.col("c_nationkey"))).alias("PORTFOLIO_ID"),
        F.lit("ORDER").alias("PRODUCT_TYPE"),
        F.when(odd, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority")).alias("RISK_FACTOR"),
        F.when(F.col("c_mktsegment") == "BUILDING", "USD")
        .when(F.col("c_mktsegment") == "FURNITURE", "")
        .otherwise("KRW").alias("CCY_CD"),
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", "KRW_MN").otherwise("krw").alias("UNIT_CD"),
        F.when((F.col("o_orderpriority") == "1-URGENT") & (price < 5000), "n/a")
        .otherwise(signed.cast("string")).alias("EXPOSURE_AMT"),
        F.col("o_orderkey").alias("ROW_NO"),
    )


EXPOSURES_SQL = """
ordernation AS (
  SELECT o.*, c.c_nationkey, c.c_mktsegment, strftime(o.o_orderdate, '%Y%m') || '01' AS base_dt
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
exposures AS (
  SELECT base_dt, c_mktsegment AS desk_cd,
    'PF_' || c_nationkey AS pf_key, o_orderpriority AS rf_key,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN 'pf_' || c_nationkey ELSE 'PF_' || c_nationkey END AS portfolio_id,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN lower(o_orderpriority) ELSE o_orderpriority END AS risk_factor,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'USD' WHEN 'FURNITURE' THEN '' ELSE 'KRW' END AS ccy_cd,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'KRW_MN' ELSE 'krw' END AS unit_cd,
    CASE WHEN o_orderpriority = '1-URGENT' AND CAST(o_totalprice AS DECIMAL(18,2)) < 5000 THEN NULL
         WHEN o_orderstatus = 'F' THEN -CAST(o_totalprice AS DECIMAL(18,2))
         ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS exposure_amt,
    o_orderkey AS row_no
  FROM ordernation)"""


def limits(spark: SparkSession, sf_dir: str, months: tuple[str, ...] = ()) -> DataFrame:
    """A limit per (month, nation, priority) with orders.

    Beside each limit of the lowest priority stands a reserve that no exposure uses; nation 12
    has no limits, nation 7 has each limit twice, nations 8 to 10 have unusable ones.
    """
    keys = (
        orders_by_nation(spark, sf_dir, months)
        .groupBy("base_dt", "c_nationkey", "o_orderpriority")
        .agg(
            F.max("c_mktsegment").alias("segment"),
            F.min("o_orderkey").alias("row_no"),
        )
        .filter("c_nationkey <> 12")
    )
    nation, lowest = F.col("c_nationkey"), F.col("o_orderpriority") == "5-LOW"
    factors = F.when(lowest, F.array("o_orderpriority", F.lit("6-RESERVE"))).otherwise(F.array("o_orderpriority"))
    keys = keys.withColumn("factor", F.explode(factors))
    level = nation * 7 + F.substring("factor", 1, 1).cast("int") * 3
    amount = F.lit(60000) * (1 + level % 5)
    amount = F.when(nation == 8, 0).otherwise(amount)
    copies = F.when(nation == 7, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return keys.withColumn("copy", F.explode(copies)).select(
        F.col("base_dt").alias("BASE_DT"),
        _portfolio(nation).alias("PORTFOLIO_ID"),
        F.col("factor").alias("RISK_FACTOR"),
        F.when(nation == 9, "unlimited").otherwise((amount + F.col("copy")).cast("string")).alias("LIMIT_AMT"),
        F.when(nation == 10, "N").when(nation == 11, "y").otherwise("Y").alias("USE_YN"),
        F.when(F.col("segment") == "BUILDING", "USD").otherwise("krw").alias("CCY_CD"),
        F.lit("KRW").alias("UNIT_CD"),
        (F.col("row_no") * 4 + F.when(F.col("factor") == "6-RESERVE", 2).otherwise(0) + F.col("copy")).alias("ROW_NO"),
    )


LIMITS_SQL = """
limitkeys AS (
  SELECT base_dt, c_nationkey, o_orderpriority, max(c_mktsegment) AS segment, min(o_orderkey) AS row_no
  FROM ordernation WHERE c_nationkey <> 12 GROUP BY ALL),
limits AS (
  SELECT base_dt, 'PF_' || c_nationkey AS pf_key, factor AS rf_key,
    CASE WHEN c_nationkey = 9 THEN NULL ELSE CAST(
      (CASE WHEN c_nationkey = 8 THEN 0 ELSE
        60000 * (1 + (c_nationkey * 7 + CAST(left(factor, 1) AS INTEGER) * 3) % 5) END)
      + copy AS DECIMAL(22,4)) END AS limit_amt,
    CASE c_nationkey WHEN 10 THEN 'N' WHEN 11 THEN 'y' ELSE 'Y' END AS use_yn,
    CASE WHEN segment = 'BUILDING' THEN 'USD' ELSE 'KRW' END AS ccy_cd,
    'KRW' AS unit_cd, row_no * 4 + CASE factor WHEN '6-RESERVE' THEN 2 ELSE 0 END + copy AS row_no
  FROM limitkeys, LATERAL (SELECT unnest(CASE WHEN o_orderpriority = '5-LOW' THEN [o_orderpriority, '6-RESERVE']
      ELSE [o_orderpriority] END) AS factor), LATERAL (SELECT unnest(CASE WHEN c_nationkey = 7 THEN [0, 1] ELSE [0] END) AS copy))"""

# Status of every exposure row, as SQL.
STATUS_SQL = f"""{EXPOSURES_SQL},{LIMITS_SQL},
lookup AS (
  SELECT base_dt, pf_key, rf_key, count(*) AS limit_rows, max(limit_amt) AS l,
    max(CASE WHEN limit_amt > 0 AND upper(use_yn) = 'Y' THEN 1 ELSE 0 END) AS usable
  FROM limits GROUP BY ALL),
joined AS (
  SELECT e.*, k.limit_rows, k.l, k.usable FROM exposures e LEFT JOIN lookup k USING (base_dt, pf_key, rf_key)),
graded AS (
  SELECT *, CASE
    WHEN exposure_amt IS NULL THEN 'MAPPING_ERROR'
    WHEN limit_rows > 1 THEN 'DUPLICATE_LIMIT'
    WHEN limit_rows IS NULL THEN 'NO_LIMIT'
    WHEN usable = 0 THEN 'INVALID_LIMIT'
    WHEN abs(exposure_amt) > l THEN 'BREACH'
    WHEN abs(exposure_amt) * 10 >= l * 9 THEN 'WARNING'
    ELSE 'NORMAL' END AS status FROM joined),
status AS (
  SELECT base_dt, desk_cd, portfolio_id, risk_factor, pf_key, rf_key, ccy_cd, unit_cd, row_no, status,
    coalesce(limit_rows, 0) AS limit_rows,
    CASE WHEN status = 'MAPPING_ERROR' THEN 0 ELSE exposure_amt END AS exposure_amt,
    CASE WHEN status IN ('NORMAL','WARNING','BREACH','INVALID_LIMIT') THEN coalesce(l, 0) ELSE 0 END AS limit_amt,
    CASE WHEN status IN ('NORMAL','WARNING','BREACH')
      THEN CAST(abs(exposure_amt) AS DOUBLE) / CAST(l AS DOUBLE) ELSE 0 END AS usage_ratio,
    CASE WHEN status IN ('NORMAL','WARNING','BREACH') THEN l - abs(exposure_amt) ELSE 0 END AS remaining_limit
  FROM graded)"""


def limit_inputs(
    spark: SparkSession, sf_dir: str, base_dts: str | list[str] | None = None, months: tuple[str, ...] = ()
) -> LimitInputs:
    return bind(
        exposures(spark, sf_dir, months), limits(spark, sf_dir, months), base_dts, ColumnMapping(),
        row_no="ROW_NO",
    )


def edge_inputs(spark: SparkSession, sf_dir: str) -> LimitInputs:
    """A limit per line item, and a position at 90 % or 100 % of it or a millionth beside that."""
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    share = F.when(F.col("l_linenumber") % 2 == 0, Decimal("0.9")).otherwise(Decimal("1.0"))
    step = F.when(F.col("l_orderkey") % 3 == 0, Decimal("-0.000001")).when(
        F.col("l_orderkey") % 3 == 1, Decimal("0.000000")).otherwise(Decimal("0.000001"))
    items = table(spark, sf_dir, "lineitem").select(
        F.concat(F.date_format("l_shipdate", "yyyyMM"), F.lit("01")).alias("BASE_DT"),
        F.col("l_orderkey").cast("string").alias("PORTFOLIO_ID"),
        F.col("l_linenumber").cast("string").alias("RISK_FACTOR"),
        ((price * share).cast("decimal(24,6)") + step).cast("string").alias("EXPOSURE_AMT"),
        price.cast("string").alias("LIMIT_AMT"), F.lit("Y").alias("USE_YN"),
    )
    return bind(items.drop("LIMIT_AMT", "USE_YN"), items.drop("EXPOSURE_AMT"), None, ColumnMapping())


EDGES_SQL = """
edges AS (
  SELECT strftime(l_shipdate, '%Y%m') || '01' AS base_dt, CAST(l_orderkey AS VARCHAR) AS portfolio_id,
    CAST(l_linenumber AS VARCHAR) AS risk_factor, CAST(l_extendedprice AS DECIMAL(18,2)) AS l,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CASE WHEN l_linenumber % 2 = 0 THEN 0.9 ELSE 1.0 END AS DECIMAL(24,6))
      + CASE l_orderkey % 3 WHEN 0 THEN -0.000001 WHEN 1 THEN 0.000000 ELSE 0.000001 END AS e FROM lineitem),
edge_status AS (
  SELECT *, CASE WHEN count(*) OVER (PARTITION BY base_dt, portfolio_id, risk_factor) > 1 THEN 'DUPLICATE_LIMIT'
    WHEN l <= 0 THEN 'INVALID_LIMIT' WHEN abs(e) > l THEN 'BREACH' WHEN abs(e) * 10 >= l * 9 THEN 'WARNING'
    ELSE 'NORMAL' END AS status FROM edges)"""


def doubles(df: DataFrame, *names: str, places: int | None = None) -> DataFrame:
    """Decimals as doubles, so both engines return the same type."""
    return df.withColumns({
        n: F.round(F.col(n).cast("double"), places) if places is not None else F.col(n).cast("double")
        for n in names
    })
