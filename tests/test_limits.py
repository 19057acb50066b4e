"""Limit states and reconciliation on small tables."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from limitlens import schema as S
from limitlens.functions.dates import BaseDate
from limitlens.operators import limits as L, reconcile as R, report, templates as M
from limitlens.plans import joins
from limitlens.plans.expand import expand_counts
from limitlens.sources.mapping import DEFAULT_NAMES, ColumnMapping
from tests.helpers import DAY, EXPOSURE, LIMIT, Run, exposures, limits, table

SAMPLE_EXPOSURES = [
    (DAY, "RATES", "BOOK-1", "SWAP", "EUR-10Y", "EUR", "700"),
    (DAY, "RATES", "BOOK-2", "SWAP", "USD-2Y", "USD", "455"),
    (DAY, "EQUITY", "BOOK-3", "OPTION", "DAX", "EUR", "-240"),
    (DAY, "EQUITY", "BOOK-4", "FUTURE", "NIKKEI", "JPY", "9300"),
    (DAY, "CREDIT", "BOOK-5", "CDS", "ITRAXX", "EUR", "81.5"),
    ("20260616", "RATES", "BOOK-1", "SWAP", "EUR-10Y", "EUR", "650"),
]
SAMPLE_LIMITS = [
    (DAY, "BOOK-1", "EUR-10Y", "1000", "Y"),
    (DAY, "BOOK-2", "USD-2Y", "500", "Y"),
    (DAY, "BOOK-3", "DAX", "320", "Y"),
    (DAY, "BOOK-4", "NIKKEI", "10000", "Y"),
    (DAY, "BOOK-5", "ITRAXX", "80", "Y"),
]


def test_sample_tables(spark):
    run = Run(table(spark, EXPOSURE, SAMPLE_EXPOSURES), table(spark, LIMIT, SAMPLE_LIMITS))
    rows = {r["portfolio_id"]: r for r in run.status.collect()}
    assert len(rows) == 5
    assert sorted(r["status"] for r in rows.values()) == ["BREACH", "NORMAL", "NORMAL", "WARNING", "WARNING"]
    assert rows["BOOK-3"]["exposure_amt"] == -240
    assert rows["BOOK-3"]["usage_ratio"] == Decimal("0.75")
    assert run.result() == "PASS"
    summary = run.summary()
    assert list(S.RECON_CODES) == [r["code"] for r in sorted(summary.values(), key=lambda r: r["check_order"])]
    assert not summary[S.RECON_CURRENCY_MISMATCH]["applicable"]
    assert not summary[S.RECON_UNIT_MISMATCH]["applicable"]


def test_six_states(spark):
    run = Run(
        exposures(spark, [("A", "F", 50), ("B", "F", 95), ("C", "F", 110), ("D", "F", 10), ("E", "F", 10), ("G", "F", 10)]),
        limits(spark, [("A", "F", 100), ("B", "F", 100), ("C", "F", 100), ("E", "F", 100, "N"), ("G", "F", 0)]),
    )
    assert run.states() == {
        "A": "NORMAL", "B": "WARNING", "C": "BREACH", "D": "NO_LIMIT", "E": "INVALID_LIMIT", "G": "INVALID_LIMIT",
    }
    counts = run.counts()
    assert run.result() == "FAIL"
    assert counts[S.RECON_EXPOSURE_NO_LIMIT] == 1
    assert counts[S.RECON_NONPOSITIVE_LIMIT] == 1
    assert counts[S.RECON_SUM_BALANCE] == 0
    kpi = run.kpis()[0]
    # An invalid limit still counts in the limit sum.
    assert kpi["limit_amt_sum"] == 400
    assert kpi["remaining_limit_sum"] == 50 + 5 - 10
    severity = L.run_severity(L.limit_kpis(run.status)).first()["severity"]
    assert severity == "High"
    codes = {r["code"] for r in L.limit_findings(run.inputs, L.limit_kpis(run.status)).collect()}
    assert codes == {
        "LIMIT_MONITOR_COMPLETE", "LIMIT_BREACH_DETECTED", "LIMIT_NO_LIMIT_DETECTED", "LIMIT_INVALID_LIMIT_DETECTED",
    }


def test_boundaries(spark):
    run = Run(
        exposures(spark, [("A", "F", "89.99"), ("B", "F", 90), ("C", "F", 100), ("D", "F", "100.0001")]),
        limits(spark, [(p, "F", 100) for p in "ABCD"]),
    )
    assert run.states() == {"A": "NORMAL", "B": "WARNING", "C": "WARNING", "D": "BREACH"}


def test_amounts_are_compared_as_given(spark):
    whole = "1234567890123456789012345"
    rows = [
        ("A", "100.00004", 100, "BREACH"), ("B", "0.899996", 1, "NORMAL"), ("C", "0.9000000001", 1, "WARNING"),
        ("D", "0.8999999999", 1, "NORMAL"), ("E", whole, whole, "WARNING"), ("F", whole, whole[:-1] + "4", "BREACH"),
        ("G", "9" * 28, "9" * 28, "WARNING"), ("H", "8" * 28, "9" * 28, "NORMAL"), ("I", "0.0000000002", "0.0000000001", "BREACH"),
        ("J", "1" + "0" * 28, 1, "BREACH"), ("K", "8" + "0" * 28, 1, "MAPPING_ERROR"),
        ("L", "100.00000000001", 100, "BREACH"), ("M", "89.9999999999999999999", 100, "NORMAL"), ("N", "12345678901234567890123456789", "12345678901234567890123456790", "WARNING"),
    ]
    run = Run(exposures(spark, [(p, "F", e) for p, e, _, _ in rows]), limits(spark, [(p, "F", l) for p, _, l, _ in rows]))
    assert run.states() == {p: s for p, _, _, s in rows}
    found = {r["portfolio_id"]: r for r in run.status.collect()}
    assert found["B"]["usage_ratio"] == Decimal("0.899996") and found["B"]["remaining_limit"] == Decimal("0.100004")
    assert found["F"]["remaining_limit"] == -1 and found["I"]["usage_ratio"] == 2
    assert (found["D"]["remaining_limit"], found["D"]["remaining_fine"]) == (Decimal("0.1"), 10**18)
    assert (found["L"]["remaining_limit"], found["L"]["remaining_fine"]) == (0, -(10**17)) and found["M"]["remaining_fine"] == 10**9


def test_reports_compare_ids_and_flags_as_spelled(spark):
    inputs = L.bind(
        exposures(spark, [("p", "F", 10), ("P", "F", 5), ("P", "F", "4.00004"), ("q", "F", 1)]),
        limits(spark, [("p", "F", 100, "y"), ("P", "F", 10), ("q", "F", 0)]), [DAY],
    )
    prepared = M.prepared(inputs)
    usage = {r["PORTFOLIO_ID"]: r for r in M.limit_usage(*prepared, DAY).collect()}
    assert {p: r["LIMIT_STATUS"] for p, r in usage.items()} == {"p": "NO_LIMIT", "P": "WARNING", "q": "BREACH"}
    assert usage["P"]["EXPOSURE_AMT"] == Decimal("9.00004") and usage["q"]["LIMIT_USAGE_RATE"] is None
    rows = M.usage_ratio(*prepared, DAY).collect()
    assert sorted((r["PORTFOLIO_ID"], r["USAGE_RATIO"]) for r in rows if r["USAGE_RATIO"] is not None) == [
        ("P", Decimal("0.400004")), ("P", Decimal("0.5"))
    ]
    assert {r["PORTFOLIO_ID"] for r in M.unmapped(*prepared, DAY).collect()} == {"p"}


def test_exposure_delta_has_a_row_per_key(spark):
    rows = [("A", "F", 1), ("A", "F", 2), ("A", "F", 5, "20260616"), ("A", "F", 7, "20260616"), ("B", "F", 1)]
    prepared = M.prepared(L.bind(exposures(spark, rows), limits(spark, [("A", "F", 1)]), [DAY, "20260616"]))[0]
    found = M.exposure_delta(prepared, DAY, "20260616").collect()
    assert [tuple(map(float, r[2:])) for r in found] == [(3.0, 12.0, -9.0)]


def test_date_formats(spark):
    exposure, limit = exposures(spark, [("A", "F", 1)]), limits(spark, [("A", "F", 10)])
    run = Run(exposure, limit, "2026-06-17")
    assert run.states() == {"A": "NORMAL"} and run.result() == "PASS"
    bad = Run(exposure, limit, "2026/06/17")
    assert bad.states() == {}
    assert bad.counts()[S.RECON_BASEDATE_MISMATCH] == 3
    assert bad.result() == "PASS"
    codes = {r["code"] for r in L.limit_findings(bad.inputs, L.limit_kpis(bad.status)).collect()}
    assert {"LIMIT_BASEDATE_FORMAT_INVALID", "LIMIT_MONITOR_NO_ROWS"} <= codes
    with pytest.raises(ValueError):
        BaseDate.of("  ")
    assert not BaseDate.of("2026-02-30").valid and not BaseDate.of("2026-6-7").valid


def test_orphan_limit(spark):
    run = Run(exposures(spark, [("A", "F", 1)]), limits(spark, [("A", "F", 10), ("Z", "F", 10)]))
    assert run.counts()[S.RECON_LIMIT_NO_EXPOSURE] == 1 and run.result() == "PASS"


def test_duplicate_limit(spark):
    run = Run(exposures(spark, [("A", "F", 1)]), limits(spark, [("A", "F", 100), ("a ", "f", 120)]))
    assert run.states() == {"A": "DUPLICATE_LIMIT"}
    counts = run.counts()
    assert counts[S.RECON_DUPLICATE_LIMIT] == 1 and counts[S.RECON_ROW_AMPLIFICATION] == 1
    assert run.result() == "FAIL"
    audit = R.join_audit(run.inputs, run.status).first()
    assert (audit["duplicate_keys"], audit["duplicate_rows"], audit["blocked_rows"]) == (1, 2, 1)


def test_only_other_date(spark):
    run = Run(exposures(spark, [("A", "F", 1, "20260616")]), limits(spark, [("A", "F", 1, "Y", "20260616")]))
    assert run.counts()[S.RECON_BASEDATE_MISMATCH] == 2 and run.result() == "PASS"


def test_bad_amount(spark):
    run = Run(exposures(spark, [("A", "F", "BAD")]), limits(spark, [("A", "F", 1)]))
    assert run.states() == {"A": "MAPPING_ERROR"}
    assert run.counts()[S.RECON_SUM_BALANCE] == 1 and run.result() == "FAIL"


def test_mapped_columns_and_mismatches(spark):
    mapping = ColumnMapping({
        "BaseDate": "BASE_DATE", "PortfolioId": "PORT_ID", "RiskFactor": "RISK_NAME", "ExposureAmount": "EXPOSURE",
        "LimitAmount": "LIMIT", "UseYn": "ACTIVE_YN", "CurrencyCode": "CCY_CUSTOM", "UnitCode": "UNIT_CUSTOM",
    })
    exposure = table(
        spark, ["BASE_DATE", "PORT_ID", "RISK_NAME", "EXPOSURE", "CCY_CUSTOM", "UNIT_CUSTOM"],
        [(DAY, "P", "R", 50, "KRW", "KRW_MN"), (DAY, "P", "R", 51, "KRW", "KRW_MN"), (DAY, "P", "R", 5, "", "krw")],
    )
    limit = table(
        spark, ["BASE_DATE", "PORT_ID", "RISK_NAME", "LIMIT", "ACTIVE_YN", "CCY_CUSTOM", "UNIT_CUSTOM"],
        [(DAY, "P", "R", 100, "Y", "USD", "KRW")],
    )
    run = Run(exposure, limit, mapping=mapping)
    counts = run.counts()
    assert counts[S.RECON_CURRENCY_MISMATCH] == 2 and counts[S.RECON_UNIT_MISMATCH] == 2
    assert run.result() == "PASS"


def test_missing_exposure_column(spark):
    exposure = exposures(spark, [("A", "F", 1)]).drop("EXPOSURE_AMT")
    run = Run(exposure, limits(spark, [("A", "F", 1)]))
    rows = run.status.collect()
    assert [r["status"] for r in rows] == ["MAPPING_ERROR"] and rows[0]["portfolio_id"] == ""
    assert run.codes()["MAPPING_ERROR"] == 1
    assert run.counts()[S.RECON_SUM_BALANCE] == 1 and run.result() == "FAIL"


def test_missing_limit_column(spark):
    limit = limits(spark, [("A", "F", 1)]).drop("LIMIT_AMT")
    run = Run(exposures(spark, [("A", "F", 1), ("B", "F", 2)]), limit)
    assert run.states() == {"A": "MAPPING_ERROR", "B": "MAPPING_ERROR"}
    # Without an exposure row one synthetic row stands for the date; it exceeds zero rows.
    empty = Run(exposures(spark, [("A", "F", 1, "20260101")]), limit)
    assert empty.status.count() == 1
    assert empty.counts()[S.RECON_ROW_AMPLIFICATION] == 1


def test_number_grammar(spark):
    texts = ["1,234.5", "-5", "5-", "+7", "1e3", "", "abc", ".5", "5.", "--5", "1,,2", "12 -", "-5-", " 8 ", "1 2"]
    want = ["1234.5", "-5", "-5", "7", None, None, None, "0.5", "5", None, "12", "-12", None, "8", None]
    from limitlens.functions.numbers import parse_amount, parse_profile_number

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["v"] for r in df.select("i", parse_amount("t").alias("v")).orderBy("i").collect()]
    assert got == [None if w is None else Decimal(w) for w in want]
    profile = df.sparkSession.createDataFrame([("1e3",), ("1E-2",), ("79228162514264337593543950336",)], "t string")
    values = [r["v"] for r in profile.select(parse_profile_number("t").alias("v")).collect()]
    assert values == [Decimal(1000), Decimal("0.01"), None]


def test_two_part_numbers(spark):
    from limitlens.functions.numbers import carried, parse_exact_profile, plain_text

    texts = {
        "100.00000000001": "100.00000000001", "79228162514264337593543950335": "79228162514264337593543950335", "79228162514264337593543950336": None,
        "-0.0000000000001": "-0.0000000000001", "1,234.5-": "-1234.5", ".5": "0.5", "5.": "5", "1e-10": "0.0000000001", "1E+27": "1" + "0" * 27, "1e400": None,
        "1e-400": "0", "-1.5e3": "-1500", "12.34567890123456789012345678901": "12.345678901234567890123456789", "-0": "0", "00012.10": "12.1", "x": None, "": None,
        "1e-9999999999": "0", "1e9999999999": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["v"] for r in df.select("t", parse_exact_profile("t").alias("p")).select("t", plain_text(F.col("p.amount"), F.col("p.fine")).alias("v")).collect()}
    assert got == texts
    values = ["0.9999999999999999999999999999"] * 3 + ["-5.0000000000000000000000000004", "1e-10", "-2.5"]
    sums = spark.createDataFrame([(v,) for v in values], "t string").select(parse_exact_profile("t").alias("p")).agg(F.sum("p.amount").alias("a"), F.sum("p.fine").alias("f"))
    total = sums.select(carried(F.col("a"), F.col("f")).alias("p")).select(plain_text(F.col("p.amount"), F.col("p.fine"))).first()[0]
    import decimal

    with decimal.localcontext(prec=60):
        assert Decimal(total) == sum(map(Decimal, values))


def test_all_dates_equal_single_dates(spark):
    exposure = exposures(spark, [("A", "F", 95), ("B", "F", 5), ("A", "F", 120, "20260616"), ("C", "F", 1, "20260615")])
    limit = limits(spark, [("A", "F", 100), ("A", "F", 100, "Y", "20260616"), ("Q", "F", 1, "Y", "20260614")])
    every = Run(exposure, limit, None)
    got = {(r["base_dt"], r["code"]): r["exception_count"] for r in every.summary_df.collect()}
    for day in ("20260617", "20260616", "20260615", "20260614"):
        single = Run(exposure, limit, day)
        assert {c: got[(day, c)] for c in S.RECON_CODES} == single.counts(), day
        one = sorted(map(str, single.status.drop("note").collect()))
        assert one == sorted(map(str, every.status.filter(F.col("base_dt") == day).drop("note").collect()))


def test_broadcast_and_salted_join_agree(spark):
    exposure = exposures(spark, [(f"P{i % 3}", "F", i) for i in range(300)])
    limit = limits(spark, [("P0", "F", 100), ("P1", "F", 150)])
    near = sorted(map(str, Run(exposure, limit).status.collect()))
    spark.conf.set("limitlens.broadcastBytes", "0")
    try:
        run = Run(exposure, limit)
        plan = run.status._jdf.queryExecution().optimizedPlan().toString()
        assert "__salt" in plan
        assert sorted(map(str, run.status.collect())) == near
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert sorted(map(str, Run(exposure, limit).status.collect())) == near
    finally:
        spark.conf.unset("limitlens.broadcastBytes")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_shuffled_lookup_copies_hot_keys_only(spark):
    """A lookup as long as the large side isn't copied, nor broadcast however small its files are."""
    big = spark.range(4000).select(F.when(F.col("id") < 1500, -1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    lookup = spark.range(-1, 4000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    joined = joins.salted_join(big, lookup, ["k"])
    assert {tuple(r) for r in joined.collect()} == {(-1 if v < 1500 else v, v, -2 if v < 1500 else v * 2) for v in range(4000)}
    assert len(joins.hot_buckets(big, ["k"])) == 1
    copies = lookup.withColumn("hot", joins._key_bucket(lookup, ["k"]).isin(joins.hot_buckets(big, ["k"]))).filter("hot").count()
    assert copies < 20
    even = joins.salted_join(big.filter("v >= 1500"), lookup, ["k"])
    assert even.count() == 2500
    for df in (joined, even):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert "__salt" not in even._jdf.queryExecution().optimizedPlan().toString()


def test_salt_depends_on_the_row_only(spark):
    df = spark.createDataFrame([(i, "x") for i in range(1000)], "i int, k string")
    buckets = lambda d: {r["i"]: r["b"] for r in d.withColumn("b", joins.row_bucket(df, 8)).collect()}
    assert buckets(df) == buckets(df.repartition(7))
    assert len(set(buckets(df).values())) == 8


def test_expand_counts(spark):
    df = spark.createDataFrame([("a", 25_001), ("b", 1), ("c", 0)], "k string, n long")
    got = {r["k"]: r["count"] for r in expand_counts(df).groupBy("k").count().collect()}
    assert got == {"a": 25_001, "b": 1}


def test_exception_order(spark):
    run = Run(
        exposures(spark, [("B", "F", 1), ("a", "F", "BAD"), ("C", "F", 1)]), limits(spark, [("C", "F", 0), ("D", "F", 1)]),
    )
    rows = [(r["code"], r["portfolio_id"]) for r in R.ordered_exceptions(run.exceptions).collect()]
    assert rows[0] == ("MAPPING_ERROR", "a")
    recon = [code for code, _ in rows if code.startswith("RECON_")]
    assert recon == sorted(recon, key=S.RECON_CODES.index)


def test_report(spark, tmp_path):
    inputs = L.bind(table(spark, EXPOSURE, SAMPLE_EXPOSURES), table(spark, LIMIT, SAMPLE_LIMITS), DAY, row_no="ROW_NO")
    analysis = report.analyze(inputs)
    sections = report.report_tables(analysis)
    report.write_report(sections, str(tmp_path / "report"))
    back = spark.read.parquet(str(tmp_path / "report" / "summary")).first()
    assert back["reconciliation"] == "PASS" and back["total_count"] == 5
    findings = spark.createDataFrame(
        [("X", "High", 3, "m"), ("Y", "Medium", 2, "m")], "code string, severity string, severity_rank int, message string"
    )
    total = report.exception_count(analysis.exceptions, findings).first()["exception_count"]
    assert total == sum(r["n"] for r in analysis.exceptions.collect()) + 1
    assert {r["code"] for r in analysis.findings.collect()} >= {"RECON_SUMMARY", "LIMIT_MONITOR_COMPLETE"}


def test_default_mapping_is_complete():
    assert set(DEFAULT_NAMES) >= {"BaseDate", "PortfolioId", "RiskFactor", "ExposureAmount", "LimitAmount", "UseYn"}


def test_report_keeps_other_dates(spark, tmp_path):
    """A daily run replaces its own date only."""
    path = str(tmp_path / "report")
    day = lambda d, v: {"KPI": spark.createDataFrame([(d, v)], "base_dt string, value int")}
    for d, v in (("20260616", 1), ("20260617", 2), ("20260616", 3)):
        report.write_report(day(d, v), path)
    got = {(str(r["base_dt"]), r["value"]) for r in spark.read.parquet(f"{path}/kpi").collect()}
    assert got == {("20260616", 3), ("20260617", 2)}
