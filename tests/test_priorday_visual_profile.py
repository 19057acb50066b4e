"""Date comparison, chart aggregates and profiles on small tables."""

from decimal import Decimal

import pytest
from pyspark.sql.functions import lpad

from limitlens.operators import limits as L, priorday as P, profile as F, visual as V
from limitlens.plans.ranking import first_per_key, top_n_per_group
from tests.helpers import DAY, exposures, limits, table

PRIOR = "20260616"


def as_text(column):
    """A number as text of fixed width, so text order is number order."""
    return lpad(column.cast("string"), 6, "0")


PAIR = [(DAY, PRIOR)]


def compared(spark, exposure_rows, limit_rows, pairs=PAIR):
    inputs = L.bind(exposures(spark, exposure_rows), limits(spark, limit_rows), [DAY, PRIOR], row_no="ROW_NO")
    status = L.limit_status(inputs)
    return status, P.prior_day(status, pairs)


def both(portfolios, amount=100, factor="F"):
    return [(p, factor, amount, "Y", d) for p in portfolios for d in (DAY, PRIOR)]


def by_portfolio(df):
    return {r["portfolio_id"]: r for r in df.collect()}


def test_movements(spark):
    _, df = compared(spark, [
        ("A", "F", 60), ("A", "F", 40, PRIOR), ("B", "F", 30), ("B", "F", 80, PRIOR), ("C", "F", 50), ("C", "F", 50, PRIOR),
    ], both("ABC"))
    rows = by_portfolio(df)
    assert rows["A"]["movement"] == "Increased" and rows["A"]["usage_ratio_delta"] == Decimal("0.2")
    assert rows["B"]["movement"] == "Decreased" and rows["B"]["usage_ratio_delta"] == Decimal("-0.5")
    assert rows["C"]["movement"] == "Unchanged"
    kpi = P.prior_day_kpis(df).first()
    assert (kpi["compared_count"], kpi["increased_count"], kpi["decreased_count"], kpi["unchanged_count"]) == (3, 1, 1, 1)


def test_new_and_resolved(spark):
    _, df = compared(spark, [("A", "F", 10), ("B", "F", 20, PRIOR)], both("AB"))
    rows = by_portfolio(df)
    assert rows["A"]["movement"] == "New" and rows["A"]["prior_exposure_amt"] == 0 and rows["A"]["prior_status"] is None
    assert rows["B"]["movement"] == "Resolved" and rows["B"]["current_exposure_amt"] == 0


def test_top_movers(spark):
    _, df = compared(spark, [
        ("PF_BIG", "F", 50), ("PF_BIG", "F", 10, PRIOR), ("PF_B", "F", 30), ("PF_B", "F", 10, PRIOR),
        ("PF_A", "F", 30), ("PF_A", "F", 10, PRIOR), ("PF_C", "F", 11), ("PF_C", "F", 10, PRIOR),
    ], both(["PF_BIG", "PF_A", "PF_B", "PF_C"]))
    movers = P.prior_day_movers(df, 3).orderBy("rank").collect()
    assert [r["portfolio_id"] for r in movers] == ["PF_BIG", "PF_A", "PF_B"]
    assert P.prior_day_movers(df, -1).count() == 0


def test_state_transitions_are_no_movers(spark):
    limit = [("A", "F", 100, "Y", PRIOR)] + [("D", "F", 100, "Y", d) for d in (DAY, PRIOR)] * 2
    status, df = compared(spark, [
        ("A", "F", 10), ("A", "F", 10, PRIOR), ("D", "F", 10), ("D", "F", 10, PRIOR),
    ], limit)
    rows = by_portfolio(df)
    assert rows["A"]["movement"] == rows["D"]["movement"] == "StateTransition"
    assert P.prior_day_movers(df).count() == 0
    codes = [r["code"] for r in P.prior_day_findings(status, df, PAIR).collect()]
    assert codes == ["PRIOR_DAY_STATE_TRANSITION"] * 2


def test_limit_only_change(spark):
    _, df = compared(spark, [("A", "F", 50), ("A", "F", 50, PRIOR)], [("A", "F", 80), ("A", "F", 100, "Y", PRIOR)])
    row = df.first()
    assert (row["limit_amt_delta"], row["exposure_amt_delta"], row["movement"]) == (-20, 0, "Increased")


def test_duplicate_key_and_empty_side(spark):
    status, df = compared(spark, [("A", "F", 60), ("A", "F", 40), ("a", "F", 10, PRIOR)], both("A"))
    assert df.count() == 1
    row = df.first()
    # First by portfolio, factor, state, then row order.
    assert row["current_exposure_amt"] == 60
    duplicate = P.duplicate_keys(status, PAIR).collect()
    assert [(r["side"], r["row_count"]) for r in duplicate] == [("Current", 2)]
    empty = P.empty_sides(spark, status, [(DAY, "20260101")]).collect()
    assert [(r["side"], r["base_dt"]) for r in empty] == [("Prior", "20260101")]


def test_row_orders_of_any_type_agree(spark):
    rows = [(p, "F", 10 * i + 1, d) for i in range(6) for p in "AaB" for d in (DAY, PRIOR)]
    exposure, limit = exposures(spark, rows), limits(spark, both("AB"))
    text = exposure.withColumn("ROW_NO", as_text(exposure["ROW_NO"]))
    seen = []
    for table_, order in ((exposure, "ROW_NO"), (text, "ROW_NO"), (exposure, None)):
        lim = limit if table_ is exposure else limit.withColumn("ROW_NO", as_text(limit["ROW_NO"]))
        status = L.limit_status(L.bind(table_, lim, [DAY, PRIOR], row_no=order))
        seen.append(sorted(map(str, P.prior_day(status, PAIR).collect())))
    assert seen[0] == seen[1] == seen[2]


def test_same_date_is_refused(spark):
    with pytest.raises(ValueError):
        P.date_pairs([("20260617", "2026-06-17")])
    with pytest.raises(ValueError):
        P.date_pairs([("20260617", " ")])


def test_many_pairs_equal_single_pairs(spark):
    rows = [(p, "F", 10 * d + i, f"2026061{d}") for d in range(4) for i, p in enumerate("ABC") if (d + i) % 3]
    lim = [(p, "F", 100, "Y", f"2026061{d}") for d in range(4) for p in "ABC"]
    inputs = L.bind(exposures(spark, rows), limits(spark, lim), None, row_no="ROW_NO")
    status = L.limit_status(inputs)
    pairs = [(f"2026061{d + 1}", f"2026061{d}") for d in range(3)] + [("20260613", "20260610")]
    every = P.prior_day(status, pairs)
    for pair in pairs:
        one = sorted(map(str, P.prior_day(status, [pair]).collect()))
        many = every.filter(f"current_dt = '{pair[0]}' and prior_dt = '{pair[1]}'")
        assert sorted(map(str, many.collect())) == one


# --- charts --------------------------------------------------------------------------------

def status_table(spark, rows):
    """Rows of (portfolio, exposure, ratio, status, currency)."""
    full = [(DAY, p, "F", c, Decimal(str(e)), Decimal(str(u)), s, i) for i, (p, e, u, s, c) in enumerate(rows)]
    return spark.createDataFrame(
        full, "base_dt string, portfolio_id string, risk_factor string, ccy_cd string, exposure_amt decimal(22,4), "
        "usage_ratio decimal(38,16), status string, _row_no long",
    )


def test_visual(spark):
    df = status_table(spark, [
        ("PF_HIGH", -200, 1.01, "BREACH", "KRW"), ("PF_B", 100, 1.0, "WARNING", "usd"), ("PF_A", -100, 0.8, "NORMAL", "KRW"),
        ("PF_C", 50, 0.79, "NORMAL", ""), ("PF_D", 30, 0, "NO_LIMIT", "krw"), ("PF_E", 20, 0, "MAPPING_ERROR", "KRW"),
    ])
    top = V.top_exposures(df, 3).orderBy("rank").collect()
    assert [r["portfolio_id"] for r in top] == ["PF_HIGH", "PF_A", "PF_B"]
    grades = {r["portfolio_id"]: r["grade"] for r in V.heatmap(df).collect()}
    assert [grades[p] for p in ("PF_C", "PF_A", "PF_B", "PF_HIGH")] == ["LOW", "MID", "MID", "HIGH"]
    mix = {r["status"]: (r["row_count"], r["ratio"]) for r in V.status_mix(df).collect()}
    assert len(mix) == 7 and mix["NORMAL"] == (2, Decimal("0.3333")) and mix["DUPLICATE_LIMIT"] == (0, Decimal(0))
    total = V.concentration(df, 3).first()
    assert total["total_abs_exposure"] == 500 and total["top_share"] == Decimal("0.8")
    assert total["hhi"] == pytest.approx((200**2 + 100**2 * 2 + 50**2 + 30**2 + 20**2) / 500**2, abs=1e-6)
    findings = {r["code"]: r["message"] for r in V.visual_findings(df).collect()}
    assert findings == {"MIXED_CURRENCY": "KRW/USD"}
    with pytest.raises(ValueError):
        V.top_exposures(df, -1)


def test_zero_denominator(spark):
    df = status_table(spark, [("A", 0, 0, "NORMAL", "KRW"), ("B", 0, 0, "NORMAL", "KRW")])
    row = V.concentration(df).first()
    assert row["top_share"] == 0 and row["hhi"] == 0
    assert [r["code"] for r in V.visual_findings(df).collect()] == ["VISUAL_CONCENTRATION_ZERO_DENOMINATOR"]


def test_bucketed_ranking_agrees(spark):
    df = spark.createDataFrame([("g", (i * 7919) % 5003) for i in range(5003)], "g string, v long")
    wide = top_n_per_group(df, ["g"], [df.v.desc()], 1500).orderBy("rank").collect()
    assert [r["v"] for r in wide] == sorted((r for r in range(5003)), reverse=True)[:1500]
    assert [r["rank"] for r in wide] == list(range(1, 1501))


def test_first_per_key(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "z"), ("j", 5, "c")], "k string, n int, v string")
    assert sorted(map(tuple, first_per_key(df, ["k"], ["n"]).collect())) == [("j", 5, "c"), ("k", 1, "z")]


# --- profile -------------------------------------------------------------------------------

def frame(spark, columns, rows):
    return table(spark, columns, rows).withColumnRenamed("ROW_NO", "_row_no")


def numeric(df):
    return {r["column_name"]: r for r in F.numeric_profile(df).collect()}


def test_profile_small(spark):
    df = frame(spark, ["BASE_DT", "DESK_CD", "AMT"], [(DAY, "EQD", 10), (DAY, "EQD", 10), ("20260618", "", 20)])
    rows = F.duplicate_rows(df).first()
    assert (rows["row_count"], rows["column_count"], rows["duplicate_count"]) == (3, 3, 1)
    assert {r["column_name"]: r["null_count"] for r in F.null_counts(df).collect()} == {"BASE_DT": 0, "DESK_CD": 1, "AMT": 0}
    assert {r["base_dt"]: r["row_count"] for r in F.date_distribution(df, "base_dt").collect()} == {DAY: 2, "20260618": 1}
    found = numeric(df)
    assert found["AMT"]["sum"] == 40 and "DESK_CD" not in found
    assert F.profile_table(F.profile(df, "BASE_DT")).filter("section = 'Numeric' and metric = 'Sum' and name = 'AMT'").count() == 1


def test_profile_of_tiny_values(spark):
    df = frame(spark, ["AMT"], [("1e-9",), ("0.000000002",), ("3e-9",), ("4e-9",)])
    found = numeric(df)["AMT"]
    assert (found["sum"], found["min"], found["max"]) == (Decimal("1E-8"), Decimal("1E-9"), Decimal("4E-9"))


@pytest.mark.parametrize("values, outliers", [
    ([0] * 10 + [1000], 1), ([10**15] * 9 + [10**15 + 1], 1), ([1, 2, 1000], 0), ([5, 5, 5, 5], 0),
])
def test_outliers(spark, values, outliers):
    found = numeric(frame(spark, ["AMT"], [(v,) for v in values]))["AMT"]
    assert found["non_null_count"] == len(values) and found["outlier_count"] == outliers
    assert found["sum"] == sum(values)


def test_text_makes_a_column_non_numeric(spark):
    huge = "79228162514264337593543950335"
    assert numeric(frame(spark, ["AMT"], [(huge,), (huge,), ("text",)])) == {}
    assert numeric(frame(spark, ["AMT"], [("NULL",), ("n/a",), (" ",)])) == {}
    mixed = numeric(frame(spark, ["AMT"], [("NA",), ("1e3",), ("1,000",), ("5-",)]))["AMT"]
    assert (mixed["non_null_count"], mixed["sum"], mixed["min"]) == (3, 1995, -5)


def test_profile_many_rows(spark):
    found = numeric(frame(spark, ["AMT"], [(i % 10,) for i in range(4096)]))["AMT"]
    assert found["sum"] == 18_420


def test_profile_warnings(spark):
    df = frame(spark, ["AMT"], [(1,)])
    assert [r["code"] for r in F.profile_warnings(df, "BASE_DT").collect()] == ["BASE_DATE_COLUMN_MISSING"]
    assert F.date_distribution(df, "BASE_DT").count() == 0


def test_currency_codes_are_rows(spark):
    rows = [("20260616", "usd"), ("20260616", " USD "), ("20260616", "krw"), ("20260617", "eur"), ("20260617", ""), ("20260618", None)]
    status = spark.createDataFrame(rows, "base_dt string, ccy_cd string")
    found = {tuple(r) for r in V.currency_codes(status).select("base_dt", "ccy", "n").collect()}
    assert found == {("20260616", "USD", 2), ("20260616", "KRW", 1)}


def test_an_exact_profile_parses_its_texts_once(spark):
    df = spark.createDataFrame([(f"0.{i:028d}", i) for i in range(1, 20)] + [("1e-12", 5000)], "t string, n long")
    got = F.numeric_profile(df, exact=True)
    assert "RLIKE" not in got._jdf.queryExecution().optimizedPlan().toString().upper()
    rows = {r["column_name"]: r for r in got.collect()}
    assert rows["t"]["sum_exact"] == "0." + f"{190 + 10**16:028d}".rstrip("0") and rows["n"]["max_exact"] == "5000"
    assert rows["n"]["outlier_count"] == 1 and rows["t"]["min_exact"] == "0." + "0" * 27 + "1"
    plain = {r["column_name"]: r for r in F.numeric_profile(df).collect()}
    assert all(plain[c]["outlier_count"] == rows[c]["outlier_count"] for c in rows)
