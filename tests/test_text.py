"""Text helpers, rule scans, search, feedback and audit on small tables."""

import hashlib
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from limitlens.functions import dates as D, text as X
from limitlens.operators import audit as A, feedback as B, rules as R, scan as C, search as K

HASH = hashlib.sha256(b"user").hexdigest()


def values(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_trim_and_fold(spark):
    texts = ["\u00a0a b\u3000", "\t\n", None, "x\u2003"]
    assert values(spark, texts, X.clean("t")) == ["a b", "", "", "x"]
    assert values(spark, texts, X.is_blank("t")) == [False, True, True, False]
    assert values(spark, [" Ab "], X.fold_key("t")) == ["AB"]
    assert len(X.WHITE_SPACE) == 25 and all(c.isspace() for c in X.WHITE_SPACE)


def test_hashes(spark):
    assert values(spark, ["user"], X.sha256_hex("t")) == [HASH]
    assert values(spark, [HASH, HASH.upper(), HASH + "\n", "g" * 64, None], X.is_sha256_hex("t")) == [True, True, False, False, False]
    assert values(spark, [f" {HASH} ", "ab", None], X.hash_prefix("t")) == [HASH[:12], "ab", ""]
    assert values(spark, ["ab"], X.length_prefixed("t", F.lit("c"))) == ["2:ab1:c"]


def test_regex(spark):
    assert values(spark, ["x DROP y", "dropped", "éDROP"], X.regex_position("t", r"\bdrop\b")) == [2, -1, -1]
    assert values(spark, ["a\nOption  Explicit"], X.regex_absent("t", r"^Option\s+Explicit")) == [False]
    assert X.call_pattern("A.B") == r"\bA\.B\s*\("


def test_substring_test_never_hides_a_match(spark):
    texts = ["a kill b", "a \u212aill b", "skill", "\u0130NSERT x", "\u0131nsert", "ma\u017fter shell", "\u017fhell", "SHELL", "insert",
             "cross \n join", "CROSSJOIN", "Declare  ptrsafe", "stra\u00dfe", "x/*+ y", "update\u00e9", "\ufb01lesystemobject"]
    patterns = [*R.DEFAULT_SQL_DENY, *R.DEFAULT_SQL_WARN, *R.DEFAULT_MACRO_DENY, X.call_pattern("TAKE")]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    hidden = [F.when(~X.may_match("t", p) & (X.regex_position("t", p) >= 0), F.lit(p)) for p in patterns]
    assert df.select(F.array_compact(F.array(*hidden)).alias("h")).filter(F.size("h") > 0).collect() == []
    assert X.required_word(r"\bDROP\b") == "DROP" and X.required_word("ab+c") is None and X.required_word("a|b") is None
    assert X.required_word(r"Colou?r") is None and X.required_word(r"[a-z]+") is None


def test_tokenizers(spark):
    assert values(spark, ["a-b_c, 가나 1"], X.word_tokens("t")) == [["a", "b_c", "가나", "1"]]
    assert X.query_word_terms("a-b_c, 가나 1") == ["a", "b_c", "가나", "1"]
    assert values(spark, [" a  b\tc "], X.space_tokens("t")) == [["a", "b\tc"]]
    assert X.query_space_terms(" a  b\tc ") == ["a", "b\tc"]
    assert values(spark, ["a,B;(b) a/c"], X.delimiter_tokens("t")) == [["a", "B", "c"]]
    assert values(spark, ["", None, "z b Z a B z"], X.delimiter_tokens("t")) == [[], None, ["z", "b", "a"]]
    assert X.query_delimiter_terms("a,B;(b) a/c") == ["a", "B", "c"]


def test_substrings_and_snippet(spark):
    got = values(spark, ["abcd", ""], X.bounded_substrings("t", 2))
    assert sorted(got[0]) == ["a", "ab", "b", "bc", "c", "cd", "d"] and got[1] == []
    text = "  one\n\ttwo   three " + "x" * 40
    assert values(spark, [text], X.snippet("t", ["THREE", "zzz"])) == [("three " + "x" * 40)[:32]]
    assert values(spark, [text], X.snippet("t", [])) == ["one two three " + "x" * 18]
    assert values(spark, ["CONFIRM_X", "not_loaded", " ", "ok"], X.display_value("t")) == [
        "(needs confirmation)", "(needs confirmation)", "(missing)", "ok"]


def test_dates(spark):
    texts = ["20260617", " 2026-06-17 ", "2026/06/17", "2026-02-30", "2026-6-7"]
    assert values(spark, texts, D.normalize_base_date("t")) == [
        "20260617", "20260617", "2026/06/17", "2026-02-30", "2026-6-7"]
    assert D.search_date(" 2026-01-02 ", date(2020, 1, 1)) == (date(2026, 1, 2), True)
    assert D.search_date("2026/01/02", date(2020, 1, 1)) == (date(2020, 1, 1), False)
    assert D.search_date(None, date(2020, 1, 1)) == (date(2020, 1, 1), True)


# --- rules ---------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def rules(spark):
    return R.default_rule_set(spark)


def codes(spark, texts, findings):
    found = values(spark, texts, findings)
    return [[f["code"] for f in row] for row in found]


def test_sql_scan(spark, rules):
    got = codes(spark, ["select a from t", "SELECT * FROM t WHERE 1=1", "drop table x", "  ", "updated selection"],
                C.sql_findings(F.col("t"), rules))
    assert got == [[], ["SQL_SELECT_STAR", "SQL_WHERE_ALWAYS_TRUE"], ["SQL_DDL_DROP", "SQL_NO_SELECT"], ["SQL_EMPTY"],
                   ["SQL_NO_SELECT"]]
    row = values(spark, ["select 1; delete from t"], C.sql_findings(F.col("t"), rules))[0][0]
    assert (row["code"], row["severity"], row["matched"], row["position"]) == ("SQL_DML_DELETE", "Blocker", "delete", 10)


def test_macro_and_formula_scan(spark, rules):
    got = codes(spark, ["Option Explicit\nShell x", "Application.EnableEvents = False", "", "CreateObject(\"wscript.shell\")"],
                C.macro_findings(F.col("t"), rules))
    assert got == [["VBA_SHELL"], ["VBA_ENABLE_EVENTS_DISABLED", "VBA_OPTION_EXPLICIT_MISSING"], ["VBA_EMPTY"],
                   ["VBA_SHELL", "VBA_WSCRIPT", "VBA_OPTION_EXPLICIT_MISSING"]]
    assert codes(spark, ["=TAKE (A1,2)", "=MISTAKE(A1)", ""], C.formula_findings(F.col("t"), rules)) == [
        ["EXCEL_365_FUNCTION"], [], []]


def test_forbidden_scan(spark):
    got = codes(spark, ["has real_table_name", "800101-1234567", "1800101-1234567", "800101-5234567", None],
                C.forbidden_findings(F.col("t")))
    assert got == [["FEEDBACK_FORBIDDEN_TERM"], ["FEEDBACK_PII_PATTERN"], [], [], []]


def test_rule_codes(spark):
    lines = [(R.SQL_DENY, r"\bCALL\b"), (R.SQL_DENY, "foo"), (R.SQL_WARN, r"/\*\+"), (R.SQL_WARN, "x"),
             (R.MACRO_DENY, r"WScript\.Shell"), (R.MACRO_DENY, r"Outlook\.Application"), (R.MACRO_DENY, "x"),
             (R.MACRO_REQUIRED, "x"), (R.MACRO_WARN, "DisplayAlerts")]
    df = spark.createDataFrame([(g, i, p) for i, (g, p) in enumerate(lines)], "group string, rule_no long, pattern string")
    got = [(r["code"], r["severity"]) for r in R.with_code(df).orderBy("rule_no").collect()]
    assert got == [
        ("SQL_EXEC_CALL", "Blocker"), ("SQL_DENY_PATTERN", "Blocker"), ("SQL_OPTIMIZER_HINT", "Medium"),
        ("SQL_WARN_PATTERN", "Medium"), ("VBA_WSCRIPT", "Blocker"), ("VBA_OUTLOOK", "High"), ("VBA_DENY_PATTERN", "Blocker"),
        ("VBA_REQUIRED_PATTERN_MISSING", "Medium"), ("VBA_DISPLAY_ALERTS_DISABLED", "Medium")]
    with pytest.raises(ValueError):
        R.RuleSet.from_table(R.with_code(df))


def test_roll_up(spark, rules):
    df = spark.createDataFrame([(1, "drop x"), (2, "Declare PtrSafe"), (3, "fine")], "id int, t string")
    found = F.concat(C.sql_findings(F.col("t"), rules), C.macro_findings(F.col("t"), rules))
    scanned = C.with_findings(df, found)
    want = {1: "BLOCKED", 2: "REVIEW_REQUIRED", 3: "PASS"}
    assert {r["id"]: r["safety_result"] for r in C.safety_result(scanned, ["id"]).collect()} == want
    rows = C.finding_rows(scanned, ["id"])
    assert {r["id"]: r["safety_result"] for r in C.safety_result_of_findings(rows, ["id"]).collect()} == want
    assert C.at_least(rows, "High").count() == 2


# --- search --------------------------------------------------------------------------------

CATALOG = [
    ("FIA_REG", "PUBLIC_REG", "Investment regulation", "Law centre", "Public regulation", "CATALOG_ONLY", "check date", "v1", "2026-01-01", "OK", "PUBLIC"),
    ("NCR_GUIDE", "NCR_GUIDE", "NCR guide", "Company", "Manual upload", "MANUAL_APPROVAL_REQUIRED", "no source text", "NOT_LOADED", "", "OK", "X"),
    ("RULES", "INTERNAL", "Internal rules", "Company", "Internal", "PROD_ONLY", "restricted", "NOT_LOADED", "", "", "CONFIRM_ME"),
    ("ODD", "X", "Odd entry", "Company", "Internal", "whatever", "ncr note", "v1", "2026-01-01", "OK", "PUBLIC"),
]
CATALOG_SCHEMA = ("source_id string, category string, title string, source_org string, source_type string, status string, "
                  "note string, version string, effective_date string, approval_status string, license_status string, row_no int")


def entries(spark, rows=CATALOG):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], CATALOG_SCHEMA)
    return K.catalog_entries(df, "row_no")


def test_catalog_search(spark):
    hits = K.catalog_search(entries(spark), "NCR").orderBy("rank").collect()
    assert [(h["source_id"], h["score"]) for h in hits] == [("NCR_GUIDE", 10 + 8 + 5 + 2), ("ODD", 1 + 1)]
    assert hits[0]["disclosure"] == "ApprovalRequired" and not hits[0]["snippet_allowed"]
    assert [f["code"] for f in hits[1]["findings"]] == ["KB_UNKNOWN_STATUS"]
    rules_row = K.catalog_search(entries(spark), "Internal rules", k=1).first()
    assert rules_row["disclosure"] == "MetadataOnly"
    assert [f["code"] for f in rules_row["findings"]] == ["KB_PROD_ONLY_METADATA", "KB_LICENSE_MISSING", "KB_APPROVAL_MISSING"]
    warnings = K.citation_warnings(K.catalog_search(entries(spark), "Internal rules", k=1)).collect()
    assert {(w["field"], w["value"]) for w in warnings} == {("version", "NOT_LOADED"), ("license_status", "CONFIRM_ME")}


def test_last_entry_of_an_id_counts(spark):
    rows = CATALOG + [("NCR_GUIDE", "C", "Renamed", "O", "T", "PUBLIC_APPROVED", "n", "v", "d", "a", "l")]
    hits = {h["source_id"]: h for h in K.catalog_search(entries(spark, rows), "guide").collect()}
    assert hits["NCR_GUIDE"]["title"] == "Renamed" and hits["NCR_GUIDE"]["score"] == 10


def test_index_equals_linear_scan(spark):
    df = entries(spark)
    postings = K.ngram_postings(df)
    queries = ["NCR", "ncr guide", "o", "zz", "law centre public", "reg_rule", "Internal rules of the company"]
    shape = lambda hits: sorted((h["query_id"], h["source_id"], h["score"], h["rank"]) for h in hits.collect())
    assert shape(K.catalog_search(df, queries, postings=postings)) == shape(K.catalog_search(df, queries))
    stats = K.index_statistics(postings).first()
    terms = {
        (r["source_id"], f[s:s + n].upper())
        for r in df.collect() for f in (r[c].strip() for c in K.CATALOG_WEIGHTS)
        for s in range(len(f)) for n in range(1, min(32, len(f) - s) + 1)
    }
    assert stats["postings"] == len(terms) and stats["indexed_terms"] == len({t for _, t in terms})


def clause_table(spark):
    rows = [
        ("FIA_REG", "Article-1", "Alpha  text about\ncapital ratio", "2026-01-01", "2026-02-01"),
        ("FIA_REG", "Article-2", "Capital again and again and again and again", "2026-01-01", ""),
        ("UNKNOWN", "Article-3", "capital", "2026/01/01", ""),
        ("NOWHERE", "Capital-4", "other", "2026-01-01", "bad"),
        ("MISSING", "Capital-5", "other", "2025-01-01", ""),
    ]
    df = spark.createDataFrame([(*r, "p1") for r in rows],
                               "source_id string, clause_ref string, clause_text string, effective_date string, repeal_date string, pack_version string")
    return K.clause_ids(df)


def test_clause_validity(spark):
    clauses = clause_table(spark).filter("source_id = 'FIA_REG'")
    count = lambda d: clauses.filter(K.active_on(date.fromisoformat(d))).count()
    assert [count(d) for d in ("2025-12-31", "2026-01-01", "2026-01-31", "2026-02-01")] == [0, 2, 2, 1]
    bad = {(r["source_id"], r["field"]) for r in K.date_warnings(clause_table(spark)).collect()}
    assert bad == {("UNKNOWN", "effective_date"), ("NOWHERE", "repeal_date")}


def test_clause_search(spark):
    hits = {h["clause_ref"]: h for h in K.clause_search(clause_table(spark), entries(spark), "capital ratio", "2026-01-15").collect()}
    assert hits["Article-1"]["score"] == 10 + 2 + 2 and hits["Article-1"]["snippet"] == "capital ratio"
    assert hits["Article-2"]["score"] == 2 and hits["Article-2"]["snippet"] == "Capital again and again and agai"
    assert hits["Capital-5"]["score"] == 4 and hits["Capital-5"]["snippet"] == ""
    assert not hits["Capital-5"]["catalog_found"]
    assert [f["code"] for f in hits["Capital-5"]["findings"]] == ["KB_CLAUSE_CATALOG_MISSING"]
    long = "capital again and again and again and"
    assert [h["clause_ref"] for h in K.clause_search(clause_table(spark), entries(spark), long, "2026-01-15").collect()] == ["Article-2"]
    assert K.clause_search(clause_table(spark), entries(spark), long + "x", "2026-01-15").count() == 0
    for as_of, valid in (("2026-01-15", True), ("15.01.2026", False)):
        found = K.clause_search(clause_table(spark), entries(spark), "capital ratio", as_of)
        assert {h["search_date_valid"] for h in found.collect()} <= {valid}


def test_queries(spark):
    table = spark.createDataFrame([("a", " x "), ("b", " "), ("c", None)], "query_id string, query string")
    assert K.as_queries(table) == [K.Query("a", "x")]
    assert K.as_queries(["p", ("q", "r")]) == [K.Query("p", "p"), K.Query("q", "r")]
    with pytest.raises(ValueError):
        K.catalog_search(entries(spark), " ")


# --- feedback ------------------------------------------------------------------------------

FEEDBACK = "feedbackId string, taskId string, userId string, feedbackCode string, reviewStatus string, _row_no int"
BODY = "feedbackId string, taskId string, draftBody string, kind string, _row_no int"


def promote(spark, rules, feedback, bodies=None):
    feedback = spark.createDataFrame([(*r, i) for i, r in enumerate(feedback)], FEEDBACK)
    if bodies is not None:
        bodies = spark.createDataFrame([(*r, i) for i, r in enumerate(bodies)], BODY)
    return B.promote_approved(feedback, bodies, rules, F.lit("2026-01-01 00:00:00"))


def test_promotion(spark, rules):
    result = promote(spark, rules, [
        ("f1", "t1", HASH, "approved", ""), ("f2", "t1", HASH, "REJECTED", "PENDING"), ("f3", "t1", HASH, "", "PENDING"),
        ("f1", "t1", HASH, "", "reviewerapproved"), ("f4", "t1", "plain", "APPROVED", ""),
    ])
    promoted = result.promoted.collect()
    assert [(p["feedbackId"], p["exampleBodyKind"], p["exampleBodyLength"]) for p in promoted] == [("f1", "None", 0)]
    assert promoted[0]["exampleId"] == "example-" + hashlib.sha256(b"f1|t1").hexdigest()[:12]
    reasons = sorted((r["feedbackId"], r["reason"]) for r in result.skipped.collect())
    assert reasons == [("f1", "DUPLICATE"), ("f2", "NOT_APPROVED"), ("f3", "NOT_APPROVED"), ("f4", "USER_NOT_HASHED")]
    assert sorted(r["warning"] for r in result.warnings.collect()) == ["DUPLICATE_FEEDBACK", "USER_NOT_HASHED"]


def test_promotion_bodies(spark, rules):
    bodies = {
        "ok": ("SELECT a FROM t", ""), "drop": ("DROP TABLE x", "Sql"), "term": ("uses MODEL_WEIGHT_FILE", "text"),
        "pii": ("id 800101-1234567", "General"), "kind": ("just words", "?"), "macro": ("Function f()\nEnd Function", ""),
        "blank": (" ", "Sql"), "word": ("selected withdrawals", "x"),
    }
    feedback = [(k, "t", HASH, "APPROVED", "") for k in bodies]
    drafts = [(k, "t", *v) for k, v in bodies.items()] + [("ok", "t", "second body", "Sql")]
    result = promote(spark, rules, feedback, drafts)
    rows = {p["feedbackId"]: p for p in result.promoted.collect()}
    assert len(rows) == len(bodies)
    assert {k: r["exampleBodyKind"] for k, r in rows.items()} == {
        "ok": "Sql", "drop": "None", "term": "None", "pii": "None", "kind": "None", "macro": "Vba", "blank": "None", "word": "None"}
    assert rows["ok"]["exampleBody"] == "SELECT a FROM t" and rows["ok"]["exampleBodyLength"] == 15
    warnings = {(w["feedbackId"], w["warning"]): w["codes"] for w in result.warnings.collect()}
    assert warnings == {
        ("drop", "BODY_BLOCKED"): ["SQL_DDL_DROP"], ("term", "BODY_BLOCKED"): ["FEEDBACK_FORBIDDEN_TERM"],
        ("pii", "BODY_BLOCKED"): ["FEEDBACK_PII_PATTERN"], ("kind", "BODY_UNCERTAIN"): [], ("word", "BODY_UNCERTAIN"): [],
        ("ok", "DUPLICATE_BODY"): []}
    assert A.check_promoted_examples(result.promoted).filter(F.size("violations") > 0).count() == 0
    broken = result.promoted.withColumn("exampleBodyLength", F.lit(3))
    assert A.check_promoted_examples(broken).filter(F.size("violations") > 0).count() == len(bodies)
    hits = K.example_search(result.promoted, "select from", 5).collect()
    assert [(h["feedbackId"], h["score"]) for h in hits] == [("ok", 3 + 3)]
    tie = K.example_search(result.promoted, "APPROVED", 3).orderBy("rank").collect()
    assert [h["exampleId"] for h in tie] == sorted(p["exampleId"] for p in rows.values())[:3]


def test_promotion_with_salted_join(spark, rules):
    feedback = [("hot", "t", HASH, "APPROVED", "")] * 50 + [("cold", "t", HASH, "APPROVED", "")]
    spark.conf.set("limitlens.broadcastBytes", "0")
    try:
        result = promote(spark, rules, feedback)
        assert result.promoted.count() == 2 and result.skipped.count() == 49
    finally:
        spark.conf.unset("limitlens.broadcastBytes")


# --- audit ---------------------------------------------------------------------------------

def test_audit_history(spark):
    tasks = spark.createDataFrame(
        [(f"t{i}", i, HASH, "Scan", "Tool", HASH, None, "PASS", "ruleset-" + "0" * 12) for i in range(5)],
        "taskId string, s long, userId string, taskType string, toolType string, requestHash string, outputHash string, safetyResult string, ruleVersion string",
    ).withColumn("createdAt", F.timestamp_seconds("s"))
    feedback = spark.createDataFrame(
        [("f9", "t1", 4, HASH, "APPROVED", "PENDING")],
        "feedbackId string, taskId string, s long, userId string, feedbackCode string, reviewStatus string",
    ).withColumn("createdAt", F.timestamp_seconds("s"))
    rows = A.audit_history(tasks, feedback, 3).collect()
    assert [(r["source"], r["entry_id"]) for r in rows] == [("FeedbackLog", "f9"), ("TaskLog", "t4"), ("TaskLog", "t3")]
    assert rows[1]["user_hash_prefix"] == HASH[:12] and rows[1]["output_hash_prefix"] == ""
    assert tuple(A.audit_records(tasks, feedback).columns) == A.AUDIT_COLUMNS
    with pytest.raises(ValueError):
        A.audit_history(tasks, feedback, 0)


def test_indexed_search_looks_up_its_postings_once(spark):
    """An id twice: its last entry counts, found through the first one's words or not."""
    rows = [("P1", "red bolt", 1), ("P1", "blue nut", 2), ("P2", "red nut", 1), ("P3", "green cap", 1)]
    entries = K.catalog_entries(spark.createDataFrame(rows, "source_id string, title string, row_no int"), "row_no")
    queries = [("a", "red"), ("b", "nut"), ("c", "zzz")]
    postings = K.ngram_postings(entries)
    found = K.catalog_search(entries, queries, 5, postings=postings)
    plain = K.catalog_search(entries, queries, 5)
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))
    assert {(r["query_id"], r["source_id"]) for r in found.collect()} == {("a", "P2"), ("b", "P1"), ("b", "P2")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Join Inner, \(term#", plan)) == 1
    pairs = K.candidates(postings, queries)
    assert K.candidates(postings, queries, by_query=False).collect() and pairs.columns == ["query_id", "source_id"]
    ids = lambda df: sorted(r["source_id"] for r in df.select("source_id").distinct().collect())
    assert ids(K.candidates(postings, queries, by_query=False)) == ids(pairs)
