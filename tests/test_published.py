"""Published reports appear as a whole; rules that don't compile do no harm."""

import pytest
from pyspark.sql import functions as F

from limitlens.operators import published, rule_scan, rules as R
from limitlens.sources import rule_files


def sections(spark, dates, value):
    rows = [(d, value) for d in dates]
    return {
        "SUMMARY": spark.createDataFrame(rows, "base_dt string, n int"),
        "LIMIT_MONITORING": spark.createDataFrame([(d, value * 10 + i) for d in dates for i in range(3)], "base_dt string, amount int"),
        "RAW_DATA": spark.createDataFrame([(f"file{value}",)], "source_name string"),
    }


def test_readers_see_the_last_whole_report_of_each_date(spark, tmp_path):
    path = str(tmp_path / "reports")
    assert published.commits(spark, path).count() == 0
    with pytest.raises(ValueError):
        published.read_section(spark, path, "SUMMARY")
    assert published.publish(sections(spark, ["20260101", "20260102"], 1), path) == 0
    assert published.publish(sections(spark, ["20260102"], 2), path) == 1
    # A run that died before its commit.
    from limitlens.operators.report import write_report

    write_report({"SUMMARY": sections(spark, ["20260101", "20260103"], 9)["SUMMARY"]}, f"{path}/runs/dead")
    assert sorted(map(tuple, published.read_section(spark, path, "SUMMARY").select("base_dt", "n").collect())) == [("20260101", 1), ("20260102", 2)]
    amounts = published.read_section(spark, path, "LIMIT_MONITORING").groupBy("base_dt").agg(F.max("amount").alias("m")).collect()
    assert {r["base_dt"]: r["m"] for r in amounts} == {"20260101": 12, "20260102": 22}
    assert published.read_section(spark, path, "RAW_DATA").first()[0] == "file2"
    assert published.commits(spark, path).count() == 3 and published.current(spark, path).count() == 2
    assert published.publish(sections(spark, ["20260103"], 3), path) == 2
    assert {r["base_dt"]: r["n"] for r in published.read_section(spark, path, "SUMMARY").collect()} == {"20260101": 1, "20260102": 2, "20260103": 3}


BROKEN = ["(open", "[class", "*x", "x{2,1}", r"\p{NoSuch}", None]


def test_broken_patterns_are_found_and_left_out(spark, tmp_path):
    lines = [(R.SQL_DENY, i, p) for i, p in enumerate([*BROKEN, r"\bDROP\b", "a{1,2}"])] + [(R.BLOCKED_FUNCTION, 0, "F("), (R.MACRO_DENY, 0, "(")]
    rules = R.with_code(spark.createDataFrame(lines, "group string, rule_no long, pattern string"))
    found = R.pattern_findings(rules)
    assert sorted((r["group"], r["rule_no"]) for r in found.collect()) == sorted([(R.SQL_DENY, i) for i in range(len(BROKEN))] + [(R.MACRO_DENY, 0)])
    good = R.usable_rules(rules).collect()
    assert {r["pattern"] for r in good if r["group"] == R.SQL_DENY} == {r"\bDROP\b", "a{1,2}"}
    assert {r["pattern"] for r in good if r["group"] == R.BLOCKED_FUNCTION} == {"F("}
    assert {r["pattern"] for r in good if r["group"] == R.MACRO_DENY} == set(R.DEFAULT_MACRO_DENY)
    texts = spark.createDataFrame([(1, "drop table (open")], "id int, text string")
    hits = rule_scan.scan_table(texts, "text", rules.filter(F.col("group") == R.SQL_DENY), ["id"]).collect()
    assert [(r["matched"]) for r in sorted(hits, key=lambda r: r["position"])] == ["drop", "a"]


def test_rule_files_with_a_broken_pattern_load(spark, tmp_path):
    files = {
        "sql_deny_patterns.txt": "(\n\\bDROP\\b\n", "vba_deny_patterns.txt": "[\n", "vba_warn_patterns.txt": "REQUIRE_PRESENT:Option\n",
        "excel_2021_blocked_functions.txt": "TAKE\n", "excel_2021_completion_allow_functions.txt": "SUM\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    loaded = rule_files.load_rule_set(spark, str(tmp_path))
    assert [r.pattern for r in loaded.of(R.SQL_DENY)] == [r"\bDROP\b"]
    assert {r.pattern for r in loaded.of(R.MACRO_DENY)} == set(R.DEFAULT_MACRO_DENY)
