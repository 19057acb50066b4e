"""Profiles of whole driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from limitlens.operators import profile as P
from limitlens.registry import tables as T


def profile_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.null_counts(T.exposures(spark, sf_dir))


def profile_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.date_distribution(T.exposures(spark, sf_dir), "base_dt")


def profile_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items: sums, ranges and outliers of all columns in one table."""
    rows = P.numeric_profile(T.table(spark, sf_dir, "lineitem"))
    return T.doubles(rows, "sum", "min", "max")


def profile_numeric_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over columns held as text, with thousands separators and null tokens."""
    orders = T.table(spark, sf_dir, "orders")
    text = orders.select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.when(F.col("o_orderstatus") == "P", " n/a ")
        .otherwise(F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)).alias("o_totalprice"),
        "o_orderpriority",
    )
    return T.doubles(P.numeric_profile(text), "sum", "min", "max")


def profile_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents compared by text and language."""
    return P.duplicate_rows(T.table(spark, sf_dir, "documents").select("text", "lang"))


def profile_duplicates_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.duplicate_rows(
        T.table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_discount", "l_returnflag")
    )


def _outliers(table: str, columns: list[str]) -> str:
    parts = [
        f"""SELECT '{c}' AS column_name, count(v) AS non_null_count, CAST(sum(d) AS DOUBLE) AS sum,
        CAST(min(d) AS DOUBLE) AS min, CAST(max(d) AS DOUBLE) AS max,
        CAST(count(*) FILTER (WHERE abs(v - m) > 3 * sd AND sd <> 0) AS BIGINT) AS outlier_count
      FROM (SELECT v, d, avg(v) OVER () AS m, sqrt(var_pop(v) OVER ()) AS sd FROM
        (SELECT CAST({c} AS DOUBLE) AS v, CAST({c} AS DECIMAL(30,8)) AS d FROM {table}))"""
        for c in columns
    ]
    return " UNION ALL ".join(parts)


def profile_duplicates_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated whole rows of the line items."""
    return P.duplicate_rows(T.table(spark, sf_dir, "lineitem")).drop("column_count")


QUERIES = {
    f.__name__: f
    for f in (
        profile_nulls, profile_dates, profile_numeric, profile_numeric_text,
        profile_duplicates, profile_duplicates_lineitem, profile_duplicates_rows,
    )
}
_COLUMNS = {
    "BASE_DT": "FALSE", "DESK_CD": "desk_cd IS NULL", "PORTFOLIO_ID": "FALSE", "PRODUCT_TYPE": "FALSE",
    "RISK_FACTOR": "FALSE", "CCY_CD": "ccy_cd = ''", "UNIT_CD": "FALSE",
    "EXPOSURE_AMT": "exposure_amt IS NULL", "ROW_NO": "row_no IS NULL",
}
SQL = {
    "profile_nulls": f"WITH {T.EXPOSURES_SQL} " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {p}) AS null_count FROM exposures"
        for c, p in _COLUMNS.items()
    ),
    "profile_dates": f"WITH {T.EXPOSURES_SQL} SELECT base_dt, count(*) AS row_count FROM exposures GROUP BY base_dt",
    "profile_numeric": _outliers("lineitem", [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax"]),
    "profile_numeric_text": "WITH t AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_totalprice AS DECIMAL(18,2)) END "
        "AS o_totalprice FROM orders) " + _outliers("t", ["o_orderkey", "o_totalprice"]),
    "profile_duplicates": """SELECT count(*) AS row_count, CAST(2 AS BIGINT) AS column_count,
      count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS duplicate_count FROM documents""",
    "profile_duplicates_rows": """SELECT count(*) AS row_count,
      count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS duplicate_count FROM lineitem""",
    "profile_duplicates_lineitem": """SELECT count(*) AS row_count, CAST(4 AS BIGINT) AS column_count,
      count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_quantity, l_discount, l_returnflag FROM lineitem))
      AS duplicate_count FROM lineitem""",
}
