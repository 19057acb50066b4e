"""Plain patterns: read, and looked for all at once."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from limitlens.functions import plain as N
from limitlens.functions.text import REGEX_FLAGS, is_blank
from limitlens.operators import rule_scan
from limitlens.plans import spots

PLAIN = [
    r"\bkill\b", "select", "(?:nnet[a-z]|nnet\\.)", "api[_-]?key", r"a\|b", "ab|abc", "(abc|ab)c?d", r"\.B", "x[0-9a-c]y", "SS", "is", r"\bé", "a",
    "drop table from the long text", r"[ks]i\b", "net[a-z]", r"\b\b1", "]x"[1:], "naïve"[:2], "t", r"\b한"[:2] + "m", "abcdefghijklmnopqrstuvwxyz[0-9]z",
]
TEXTS = [
    "Kill K and İnsert ſelect kıll", "killé kill", "skill KILL", "nnetX nnet. NNETz", "api_key apikey api-KEY", "A|B", "abc abcd abd", "x5y xBy xdy", "straße ss",
    "ékilĺ kill", "kill‍kill \U0001f600kill 𝐀kill", "ⓐkill kill", "", " \n ", None, "nul\0kill\0", "a", "1", "x" * 70 + " kill", "İs this ıs", "ski ksi",
    "ab" * 40 + "cd", "drop  table drop table from the long text", "한kill 한 m", "abcdefghijklmnopqrstuvwxyz7zabcdefghijklmnopqrstuvwxyz8z", "y" * (spots.SLICE_BYTES + 5) + "é kill select kill",
]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_other_patterns_are_not_plain():
    for pattern in (r"a+", r"a{2}", r"a.b", r"\d", r"[^a]b", r"[a&&b]c", r"(?i)a", r"(?=a)b", "(", "a)", "é", "^a", "a$", "", "a|", "a??b", r"\Bx", "[a-]?", r"\bx{2}", "kay|[ab]", None, "\ta", r"\x41", "(a|b)*c", "ab+"):
        assert N.plain_alternatives(pattern) is None, pattern
    assert [a.places for a in N.plain_alternatives("(?:ab|C)[x-z]?")] == [("a", "b", frozenset("xyz")), ("a", "b"), ("c", frozenset("xyz")), ("c",)]
    assert N._encoded("(?:word[a-z]|word)", "ORD")[0] == [5, 4] and N._encoded("word|other", "word")[0] is None


def test_plain_rules_equal_the_regex_engine_and_try_none(spark):
    texts = spark.createDataFrame([(i // 2, t) for i, t in enumerate(TEXTS)], "id long, text string")
    rules = spark.createDataFrame([(f"R{i % 9}", p, "Low", f"m {i % 5}") for i, p in enumerate([*PLAIN, PLAIN[0], None])], "code string, pattern string, severity string, message string")
    found = rule_scan.scan_table(texts, "text", rules, ["id", "text"])
    pattern = F.concat(F.lit(REGEX_FLAGS), F.col("pattern"))
    every = texts.filter(~is_blank("text")).crossJoin(rules).withColumn("position", F.regexp_instr("text", pattern) - 1).filter("position >= 0")
    want = every.select("id", "text", "code", "severity", F.lit(1).alias("severity_rank"), "message", F.regexp_substr("text", pattern).alias("matched"), "position")
    assert rows(found) == rows(want)
    only = rule_scan.scan_table(texts, "text", rules.filter("pattern = 'select'"), ["id"])
    # Before, the pattern was compiled and tried for each text and rule that met.
    assert "regexp_instr" not in only._jdf.queryExecution().optimizedPlan().toString().lower()
    assert rows(only.select("id")) == [(0,), (12,)]


def test_rules_beyond_a_broadcast_go_in_blocks(spark):
    texts = spark.range(50).select("id", F.concat(F.lit("word"), F.col("id").cast("string"), F.lit(" x")).alias("text"))
    rules = spark.range(50).select(F.concat(F.lit("R"), "id").alias("code"), F.concat(F.lit("word"), "id", F.lit(r"\b")).alias("pattern"), F.lit("Low").alias("severity"), F.lit("m").alias("message"))
    spark.conf.set("limitlens.broadcastBytes", "5000")
    try:
        found = rule_scan.scan_table(texts, "text", rules, ["id"])
        assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") > 1
        assert rows(found.select("id", "code")) == sorted(((i, f"R{i}") for i in range(50)), key=repr)
    finally:
        spark.conf.unset("limitlens.broadcastBytes")


@pytest.mark.parametrize("size", [16, 100, 1 << 20])
def test_slices_and_windows_do_not_show(spark, monkeypatch, size):
    monkeypatch.setattr(spots, "SLICE_BYTES", size)
    names = [x.split()[0] for x in N.ENCODED.split(", ")]
    made = [dict(zip(names, N._encoded(p, None))) | {"number": 10 * i} for i, p in enumerate(PLAIN) if N.plain_alternatives(p)]
    kinds = [("number", pa.int64()), ("held", pa.string()), *[(n, pa.list_(pa.int64() if n in ("low", "high") else pa.int32())) for n in names if n != "held"]]
    table = pa.table([pa.chunked_array([pa.array([m[n] for m in made], kind)]) for n, kind in kinds], names=[n for n, _ in kinds])
    spotter = spots.Spotter(table, spots.word_characters(spark))
    batch = pa.RecordBatch.from_arrays([pa.array([t for t in TEXTS if t and len(t) < 200], pa.string())], ["text"])
    got = sorted((int(r), int(n), int(p), m) for row, rule, place, matched in spots._found(spotter, batch) for r, n, p, m in zip(row, rule, place, matched.to_pylist()))
    monkeypatch.setattr(spots, "SLICE_BYTES", 1 << 22)
    assert got and got == sorted((int(r), int(n), int(p), m) for row, rule, place, matched in spots._found(spotter, batch) for r, n, p, m in zip(row, rule, place, matched.to_pylist()))
