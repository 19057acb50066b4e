"""Operators over pages, the queries with SQL, and the pipeline."""

import base64
import hashlib
import itertools

import pytest

import corpus_pipeline
from limitlens.llm import url_filter, web_archive
from limitlens.llm.queries import QUERIES, SQL
from tests.oracle import compare, connect


@pytest.fixture(scope="session")
def pages(spark):
    rows = [(i, f"http://host{i % 3}.Example.com/p/{i}?q=1", f"<p>page {i % 7}</p>", "x") for i in range(60)]
    rows += [(60, None, None, "x"), (61, "no scheme", "", "x"), (62, "https://a\nb.org/x", "é" * 5000, "x"), (3, "http://other/", "<p>page 3</p>", "x"), rows[5], rows[5]]
    rows += [(None, "http://n/", "<p>page 2</p>", "x"), (None, None, "alone", "x")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3).cache()


def test_archive_round_trip(pages):
    data = pages.collect()
    first = {}
    for r in data:
        if r["page_id"] is not None:
            first[r["html"] or ""] = min(first.get(r["html"] or "", 1 << 60), r["page_id"])
    want = []
    for r in data:
        payload = (r["html"] or "").encode()
        ref = first.get(r["html"] or "")
        ref = None if ref == r["page_id"] else ref
        want.append((r["page_id"], len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if ref is None else "revisit", ref))
    got = web_archive.archived(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert web_archive.archived(pages.limit(0)).count() == 0


def test_lookup_reads_one_page_only(spark, pages):
    folder = web_archive.archive_folder(spark)
    captures = web_archive.write_archive(web_archive.with_references(pages, "page_id", "url", "html"), folder, file_bytes=500)
    parts = web_archive.build_index(captures, folder, block=4)
    wanted = captures.filter("page_id = 9").select("urlkey", "page_id")
    found = web_archive.lookup(wanted, folder, parts)
    row = web_archive.read_records(found, folder, with_payload=True).collect()
    assert [r["page_id"] for r in row] == [9] and row[0]["refers_to"] == 2
    missing = spark.createDataFrame([("zz)/", 1), ("", -5)], "urlkey string, page_id long")
    assert web_archive.lookup(missing, folder, parts).count() == 0
    every = web_archive.lookup(captures.select("urlkey", "page_id"), folder, parts)
    assert sorted(map(tuple, every.collect()), key=repr) == sorted(map(tuple, captures.collect()), key=repr)


def test_url_rules(spark):
    urls = [None, "x.org/", "http://a.org", "http://a.org/es/", "https://sub.example.org/es/1", "http://Example.ORG/en/12?x", "ftp://b.com/de/x#y", "http://com/fr/", "http://notexample.org/es/", "http://c.com?/fr/", "a://b://c/d"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "cast(null as string) html", "1 host")
    got = {r["page_id"]: r for r in url_filter.url_verdicts(df).collect()}
    rule = lambda i: (got[i]["host"], got[i]["path"], got[i]["rule"])
    assert rule(0) == ("", "", None) and rule(1) == ("", "", None) and rule(2) == ("a.org", "", None)
    assert rule(3) == ("a.org", "/es/", "org/") and rule(4) == ("sub.example.org", "/es/1", "example.org/es/")
    assert rule(5) == ("example.org", "/en/12", "example.org/en/1") and got[5]["verdict"] == "block"
    assert rule(6) == ("b.com", "/de/x", "com/de/") and rule(7) == ("com", "/fr/", "com/fr/") and got[7]["verdict"] == "allow"
    assert rule(8)[2] == "org/" and rule(9) == ("c.com", "", None) and rule(10) == ("b:", "//c/d", None)
    assert all(r["verdict"] in ("allow", "block") for r in got.values())


def test_segmentation_is_most_likely():
    model = {"cheap": -2.0, "pills": -2.5, "heap": -3.0, "c": -4.0, "pill": -2.2, "s": -3.0}
    name = "cheappills"

    def cost(cuts):
        ends = (0, *cuts, len(name))
        return sum(model.get(name[a:b], -25.0 * (b - a)) for a, b in itertools.pairwise(ends))

    best = max(cost(c) for k in range(4) for c in itertools.combinations(range(1, len(name)), k))
    words = url_filter.segment(name, model)
    assert words == ["cheap", "pills"] and sum(model[w] for w in words) == best


def test_url_verdicts_do_not_depend_on_heads(spark):
    """Rare words and tokens count like broadcast ones."""
    names = ["river", "mountain", "garden", "window", "cheap", "casino", "stone", "letter"]
    rows = [(i, f"http://{names[i % 8]}{names[i % 7]}.net/{names[i % 5]}{names[i % 3]}/x{i}", "<p>" + f"{names[i % 8]} " * (1 + i % 4) + "</p>") for i in range(80)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    whole = {r["page_id"]: r for r in url_filter.url_verdicts(df).collect()}
    assert len({r["score"] for r in whole.values()}) > 10 and {r["verdict"] for r in whole.values()} == {"allow", "block"}
    for heads in ((0, 0), (2, 3)):
        got = url_filter.url_verdicts(df, head_words=heads[0], head_tokens=heads[1]).collect()
        assert len(got) == 80
        for r in got:
            assert r["verdict"] == whole[r["page_id"]]["verdict"] and abs(r["score"] - whole[r["page_id"]]["score"]) < 1e-9


def test_long_runs_are_segmented(spark):
    """A seed, and a rare word, are found in runs of thousands of letters."""
    runs = spark.createDataFrame([("river" * 600 + "casino" + "stone" * 3, 1), ("river" * 3, 1)], "run string, n long")
    texts = spark.createDataFrame([("river river river stone",)], "html string")
    for size in (0, 10):
        got = {r["run"]: r["words"] for r in url_filter.split_runs(runs, url_filter.word_model(texts, "html", size=size)).collect()}
        assert sorted(map(len, got.values())) == [3, 604] and got["river" * 600 + "casino" + "stone" * 3][600:] == ["casino"] + ["stone"] * 3


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), name, QUERIES[name], SQL.get(name), sf_dir) == ""


def test_pipeline_stages(spark, docs, labels, benchmark, tmp_path):
    """Each stage against what its operator says; all but the last keep the columns."""
    for name, table in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    held = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, held, str(tmp_path))
        if name != "packing":
            assert out.columns == held.columns and out.schema.simpleString() == held.schema.simpleString()
        out.write.parquet(f"{tmp_path}/out-{name}")
        held = spark.read.parquet(f"{tmp_path}/out-{name}")
    assert held.count() > 100
    run = corpus_pipeline.run(spark, str(tmp_path))
    key = ["doc_id", "chunk", "n_tokens", "bucket", "batch"]
    assert sorted(map(tuple, run.select(key).collect()), key=repr) == sorted(map(tuple, held.select(key).collect()), key=repr)
    kept = {r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/out-decontamination").collect()}
    assert kept == {r["doc_id"] for r in held.select("doc_id").collect()}
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
