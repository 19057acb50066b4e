"""Rules and queries as tables, the containment join and the stored index."""

import re

import pytest
from pyspark.sql import functions as F

from limitlens.functions.factors import literal_factors
from limitlens.operators import postings, query_table, rule_scan, rules as R, scan, search
from limitlens.plans import contain
from limitlens.plans.contain import containing

TEXTS = [
    (1, "select * from t where 1 = 1"), (2, "Sub Run()\nKILL f"), (3, None), (4, " \n "), (5, "Kill K and İnsert ſelect"),
    (6, "=take (A1) + A.B"), (7, "straße ab"), (8, "a"), (8, "a"), (9, "x" * 30_000 + " drop table"), (10, "한국어 문장"),
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "id long, text string")


def rows(df, columns=None):
    return sorted((tuple(r) for r in (df.select(columns) if columns else df).collect()), key=repr)


@pytest.mark.parametrize("limit", [None, "400"])
def test_containing_equals_all_pairs(spark, texts, limit):
    needles = ["", "a", "ab", "B", "k", "SELECT", "straSSE", "kill k", "drop TABLE", "한국", "문", "x" * 40, "none at all", None]
    table = spark.createDataFrame(list(enumerate(needles)) + [(99, "ab")], "no int, needle string")
    if limit:
        spark.conf.set("limitlens.broadcastBytes", limit)  # the needles go in several blocks
    try:
        got = rows(containing(texts, F.col("text"), table).select("id", "no"))
    finally:
        spark.conf.unset("limitlens.broadcastBytes")
    fold = lambda t: t.upper().replace("K", "K").replace("İ", "I")
    want = [(i, n) for i, t in TEXTS for n, needle in [*enumerate(needles), (99, "ab")] if t is not None and needle is not None and fold(needle) in fold(t)]
    assert got == sorted(want, key=repr)
    assert containing(texts, F.col("text"), table.limit(0)).count() == 0
    assert containing(texts.limit(0), F.col("text"), table).count() == 0


def test_crowded_lengths_get_grams_of_their_own(spark, monkeypatch):
    """Ids of one length share few grams of five: without longer ones a text met many needles in vain."""
    monkeypatch.setattr(contain, "CROWD", 100)
    ids = spark.range(1000, 2000).select(F.concat(F.lit("p000"), F.col("id").cast("string")).alias("needle"))
    few = spark.createDataFrame([("p0",), ("",), ("p000100",), (" ",)], "needle string")
    texts = spark.range(0, 3000, 7).select("id", F.concat(F.lit("Item P000"), F.col("id").cast("string"), F.lit(" x")).alias("text"))
    assert contain.gram_sizes(ids.unionByName(few)) == [0, 8]
    got = {(r["id"], r["needle"]) for r in containing(texts, F.col("text"), ids.unionByName(few)).collect()}
    needles = [r[0] for r in ids.unionByName(few).collect()]
    assert got == {(i, n) for i in range(0, 3000, 7) for n in needles if n.upper() in f"ITEM P000{i} X"}
    # The few are tried as they are; the rest meet by grams.
    assert contain.gram_sizes(few) == [0]


def test_points_are_summed_where_the_needles_met(spark):
    """One shuffle, of the documents, before the best per query."""
    asked = query_table.needles(spark.createDataFrame(QUERIES, "query_id string, query string"), lambda q: F.split(q, " "))
    found = query_table.hits(entries(spark, CATALOG), ["source_id", "_row_no"], asked, search.CATALOG_WEIGHTS, search.CATALOG_TERM_WEIGHTS)
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1, plan


PATTERNS = [
    r"\bINSERT\b", r"SELECT\s+\*", r"a|", "(", r"(api[_-]?key|secret)", r"x{2,3}y", r"(ab)?c", r"(?:foo|ba)r", r"(?x)a b", r"[]a]b", r"(?i)kill",
    r"a+b*c?d{0,1}e{2}", r"foo(?=bar)", r"(?<!x)kill", r"\Qa.b\E", r"\d{3}-", "", r"^(is|the)\s", r"a\|b", r"(?:(?:ab|cd)e|f)g",
]


def test_factors_occur_in_every_match():
    found = {p: literal_factors(p) for p in PATTERNS}
    assert found[r"\bINSERT\b"] == ["INSERT"] and found[r"(api[_-]?key|secret)"] == ["api", "secret"]
    assert found["a|"] == found["("] == found[r"(?x)a b"] == found[r"\Qa.b\E"] == found[""] == [""]
    assert found[r"(?:(?:ab|cd)e|f)g"] and literal_factors(None) == [""]
    samples = ["insert", "select  *", "apikey", "api_key", "secret", "xxy", "xxxy", "abc", "c", "foor", "bar", "a]b", "]b", "kill", "aee", "abbcdee", "foobar", "a.b", "123-", "the ", "a|b", "abeg", "fg"]
    for pattern, factors in found.items():
        try:
            compiled = re.compile(pattern, re.I)
        except re.error:
            continue
        for text in samples:
            match = compiled.search(text)
            if match:
                assert any(f.upper() in text.upper() for f in factors), (pattern, text)


def test_rule_tables_equal_rules_as_parameters(spark, texts):
    table, rule_set = R.default_rules(spark), R.default_rule_set(spark)
    for small, large in ((scan.sql_findings, rule_scan.sql_scan), (scan.macro_findings, rule_scan.macro_scan), (scan.formula_findings, rule_scan.formula_scan)):
        want = scan.finding_rows(scan.with_findings(texts, small(F.col("text"), rule_set)), ["id"])
        assert rows(large(texts, "text", table, ["id"]), want.columns) == rows(want)
        assert large(texts.limit(0), "text", table, ["id"]).count() == 0
    assert rule_scan.scan_table(texts, "text", table.limit(0), ["id"]).count() == 0


def test_plan_does_not_grow_with_rules(spark, texts):
    def plan(n):
        rules = spark.range(n).select(F.concat(F.lit("R"), "id").alias("code"), F.concat(F.lit("word"), "id").alias("pattern"), F.lit("Low").alias("severity"), F.lit("m").alias("message"))
        return rule_scan.scan_table(texts, "text", rules, ["id"])._jdf.queryExecution().optimizedPlan().toString()

    assert abs(len(plan(2000)) - len(plan(5))) < 300


def entries(spark, rows):
    made = spark.createDataFrame(rows, "source_id string, title string, note string, category string, row_no long")
    return search.catalog_entries(made, "row_no")


CATALOG = [
    ("A1", "Market risk limits", "daily", "Risk", 1), ("A2", "Credit limits", "limits weekly", "Credit", 2), ("A1", "Market risk limits new", "daily", "Risk", 3),
    ("b3", "순자본비율 산정", "자본 기준", "Capital", 4), ("c4", None, "", "", 5),
]
QUERIES = [("1", "limits"), ("2", " risk limits "), ("3", "자본"), ("4", "a"), ("5", "limits limits daily"), ("6", ""), ("7", "순자본비율 산정 기준이 되는 아주 긴 질의 문장으로 서른두 글자를 넘는다"), ("8", "zzz")]


def test_query_table_equals_queries_as_parameters(spark):
    catalog = entries(spark, CATALOG)
    asked = spark.createDataFrame(QUERIES, "query_id string, query string")
    want = search.catalog_search(catalog, QUERIES, 3)
    columns = sorted(want.columns)
    assert rows(query_table.catalog_search(catalog, asked, 3), columns) == rows(want, columns)
    assert query_table.catalog_search(catalog.limit(0), asked).count() == 0
    assert query_table.catalog_search(catalog, asked.limit(0)).count() == 0
    clauses = search.clause_ids(spark.createDataFrame([
        ("A1", "Art. 1", "Limits apply   daily to 순자본비율 산정.", "2020-01-01", "", "v"), ("a1", "Art. 2 limits", "Nothing.", "2020-01-01", "2021-01-01", "v"),
        ("zz", "Art. 3", "limits, again: a clause longer than thirty-two characters", "2020-01-01", "", "v"), ("A2", "Art. 4 daily", "limits", "bad", "", "v"),
    ], "source_id string, clause_ref string, clause_text string, effective_date string, repeal_date string, pack_version string"))
    more = [*QUERIES, ("9", "again: a clause longer than thirty-two characters"), ("10", "again: a clause longer than thirty-two letters")]
    found = search.clause_search(clauses, catalog, more, "2020-06-01", 2)
    columns = sorted(found.columns)
    assert rows(query_table.clause_search(clauses, catalog, spark.createDataFrame(more, "query_id string, query string"), "2020-06-01", 2), columns) == rows(found, columns)


def test_stored_index_equals_search_and_reads_its_buckets_only(spark, tmp_path):
    path = str(tmp_path / "index")
    assert postings.open_index(spark, path).segments == ()
    asked = spark.createDataFrame(QUERIES, "query_id string, query string")
    assert postings.catalog_search(postings.open_index(spark, path), asked).count() == 0
    old = entries(spark, [("A1", "zzz stale", "zzz", "Risk", 1), *CATALOG[3:]])
    assert postings.append(old, path, 16) == 0
    before = postings.open_index(spark, path)
    assert postings.append(entries(spark, CATALOG[:3]), path) == 1
    index = postings.open_index(spark, path)
    assert (before.segments, index.segments, index.buckets) == ((0,), (0, 1), 16)
    current = entries(spark, CATALOG)
    want = search.catalog_search(current, QUERIES, 3)
    columns = sorted(want.columns)
    assert rows(postings.catalog_search(index, asked, 3), columns) == rows(want, columns)
    one = spark.createDataFrame([("1", "weekly")], "query_id string, query string")
    needles = query_table.needles(one, lambda q: F.split(q, " "))
    terms = needles.select(F.upper("needle").alias("t")).distinct().withColumn("bucket", postings._bucket(F.col("t"), 16))
    plan = postings.in_buckets(index.postings(), terms)._jdf.queryExecution().executedPlan().toString()
    number = terms.first()["bucket"]
    assert re.search(rf"PartitionFilters: \[[^\]]*\(bucket#\d+ = {number}\)", plan), plan
    files = {r[0] for r in postings.in_buckets(index.postings(), terms).select(F.input_file_name()).distinct().collect()}
    assert files and all(f"bucket={number}/" in f for f in files)
    stored = postings.signature(spark, path).first()
    whole = str(tmp_path / "whole")
    postings.append(entries(spark, [("A1", "zzz stale", "zzz", "Risk", 1), *CATALOG[3:], *CATALOG[:3]]), whole, 4)
    assert stored["segments"] == 2 and postings.signature(spark, whole).first()["documents"] == 6


def test_a_segment_without_commit_is_not_seen(spark, tmp_path):
    path = tmp_path / "index"
    postings.append(entries(spark, CATALOG[:2]), str(path), 4)
    (path / "segments" / "1" / "postings").mkdir(parents=True)
    assert postings.open_index(spark, str(path)).segments == (0,)
    assert postings.append(entries(spark, CATALOG[2:]), str(path)) == 1
