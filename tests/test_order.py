"""Global ranks and line numbers do not depend on partitions and splits."""

from pyspark.sql import functions as F

from limitlens.plans.order import ranked
from limitlens.sources.lines import field_count, numbered_lines, ragged_lines


def test_ranks_equal_a_sort(spark):
    rows = [("hot", i) for i in range(300)] + [(f"k{i % 7}", i) for i in range(50)] + [(None, 1), ("hot", 5)]
    df = spark.createDataFrame(rows, "k string, n int")
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", -r[1]))
    for parts in (1, 5):
        out = ranked(df.repartition(parts), ("k", F.desc("n")), "place").orderBy("place").collect()
        assert [r["place"] for r in out] == list(range(1, len(rows) + 1))
        assert [(r["k"], r["n"]) for r in out] == want
    assert ranked(df.limit(0), ("k",)).count() == 0


def test_a_value_many_rows_share_is_spread(spark):
    df = spark.range(4000).select(F.lit("same").alias("k"), "id")
    out = ranked(df, ("k",))
    assert len(out.inputFiles()) > 4  # several ranges, and their counts
    assert sorted(r["rank"] for r in out.collect()) == list(range(1, 4001))


def test_line_numbers_do_not_depend_on_splits(spark, tmp_path):
    texts = {"a.csv": ["K,V,W"] + [f"{i},x,y" if i % 3 else f"{i},x" for i in range(400)] + ["", "  ", "9,x,y,z"], "b.csv": ["", "K", "1", "1,2", '"a,""b"', '"a",b']}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    want = sorted((name, i, line) for name, lines in texts.items() for i, line in enumerate(lines, 1))
    ragged = sorted(
        [("a.csv", i, 2, 3) for i, line in enumerate(texts["a.csv"], 1) if line.count(",") == 1] + [("a.csv", 404, 4, 3), ("b.csv", 4, 2, 1), ("b.csv", 6, 2, 1)]
    )
    try:
        for size in ("128m", "300"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0" if size == "300" else "4m")
            lines = numbered_lines(spark, str(tmp_path))
            name = F.substring_index("file", "/", -1)
            assert sorted(map(tuple, lines.select(name, "line_no", "value").collect())) == want
            assert sorted(map(tuple, ragged_lines(lines).select(name, "line_no", "fields", "expected").collect())) == ragged
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_field_count(spark):
    lines = {"a": 1, "": 1, "a,b": 2, '"a,b"': 1, '"a,""b",c': 2, ',"x,y",': 3, 'a"b,c"': 2, ",,": 3, '"a","b","c,d"': 3}
    df = spark.createDataFrame([(k,) for k in lines], "v string")
    assert {r["v"]: r["n"] for r in df.select("v", field_count(F.col("v")).alias("n")).collect()} == lines


def test_ranked_clauses_move_no_texts(spark, tmp_path, monkeypatch):
    from limitlens.registry import order_queries

    texts = ["b text", "a text", "b text", "c text"]
    docs = [(i, t, "en", "src1", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    seen, ranked_clauses = [], order_queries.G.ranked_clauses
    monkeypatch.setattr(order_queries.G, "ranked_clauses", lambda df: seen.append(df.columns) or ranked_clauses(df))
    got = order_queries.clauses_ranked(spark, str(tmp_path)).collect()
    assert sorted(r["rank"] for r in got) == [1, 2, 3]
    by_place = [r["clause_ref"] for r in sorted(got, key=lambda r: r["rank"])]
    assert by_place == sorted(by_place) and "clause_text" not in seen[0]
