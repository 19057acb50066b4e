"""The best texts of a table of queries, against a search text by text."""

from collections import defaultdict

import pyarrow as pa
import pytest

from limitlens.operators import query_table, search
from limitlens.plans import held

LONG = "a title of more than thirty-two characters for a window"
ROWS = [
    ("A1", "Market risk limits", "daily limits", "Risk", 1), ("A2", "Credit limits", "limits weekly", "Credit", 2), ("A1", "Market risk limits new", "daily", "Risk", 3),
    ("b3", "순자본비율 산정", "자본 기준", "Capital", 4), ("c4", None, "", "", 5), ("d5", LONG, "straße", "Risk", 6), ("d5", LONG, "Daily risk", "Risk", 6),
    ("d5", LONG, "Daily risk", "Risk", 6), ("e6", "a\0b", "b", "\0", 7), ("f7", "K İi", "limits", "x", 8), ("g8", "limits", "limits", "limits", None), ("", "limits", "", "", 9),
]
QUERIES = [
    ("1", "limits"), ("1", "daily"), ("2", " Risk limits "), ("3", "자본"), ("4", "a"), ("5", "limits LIMITS daily limits"), ("6", " "), ("7", LONG), ("8", LONG + "!"),
    ("9", "a\0b"), ("10", "b\0"), ("11", "strasse risk"), ("12", "k i"), ("13", None), ("2", " Risk limits "), ("14", "x" * 40), ("15", "of more than thirty-two characters"),
]


def wanted_rows(k, unique):
    docs = defaultdict(set)
    for source_id, title, note, category, row_no in ROWS:
        docs[source_id, row_no].add((source_id, category or "", title or "", note or ""))
    last = {s: max([r for x, r in docs if x == s and r is not None], default=None) for s, _ in docs}
    out = set()
    for query_id in {q for q, _ in QUERIES}:
        found = []
        for query in {q.strip() for i, q in QUERIES if i == query_id and q and q.strip()}:
            terms = [t for t in query.split(" ") if len(t) >= 2]
            for (source_id, row_no), variants in docs.items():
                if row_no is None or (not unique and last[source_id] != row_no):
                    continue
                fields = [{"source_id": s, "category": c, "title": t, "note": n} for s, c, t, n in variants]
                points = lambda needle, weights: max(sum(w for f, w in weights.items() if needle.upper() in v.get(f, "").upper()) for v in fields)
                score = points(query, search.CATALOG_WEIGHTS) + sum(points(t, search.CATALOG_TERM_WEIGHTS) for t in terms)
                if score:
                    found.append((-score, source_id, row_no))
        out |= {(query_id, source_id, -score, rank) for rank, (score, source_id, row_no) in enumerate(sorted(found)[:k], 1)}
    return out


@pytest.mark.parametrize(("k", "limit"), [(1, None), (3, None), (3, "300")])
def test_best_entries_equal_a_search_text_by_text(spark, k, limit):
    catalog = search.catalog_entries(spark.createDataFrame(ROWS, "source_id string, title string, note string, category string, row_no long"), "row_no")
    asked = spark.createDataFrame(QUERIES, "query_id string, query string")
    if limit:
        spark.conf.set("limitlens.broadcastBytes", limit)  # the queries go in several blocks
    try:
        got = query_table.catalog_search(catalog, asked, k)
        assert sorted(map(tuple, got.select("query_id", "source_id", "score", "rank").collect())) == sorted(wanted_rows(k, False))
    finally:
        spark.conf.unset("limitlens.broadcastBytes")


def test_queries_bring_their_best_few_only(spark):
    """Before, each query and entry that met was a row until the best were picked."""
    catalog = search.catalog_entries(spark.range(3000).selectExpr("concat('E', id) source_id", "'limits of desk' title", "'size 5' note", "id row_no"), "row_no")
    asked = spark.createDataFrame([("1", "limits of desk"), ("2", "size 5"), ("3", "E17")], "query_id string, query string")
    wanted = query_table.needles(asked, query_table.space_tokens)
    parts = catalog.sparkSession.sparkContext.defaultParallelism
    assert query_table._catalog_found(catalog, wanted, 5, False).count() <= 5 * 3 * parts * 2
    best = {(r["query_id"], r["rank"]): r["source_id"] for r in query_table.catalog_search(catalog, asked, 2).collect()}
    assert best == {("1", 1): "E0", ("1", 2): "E1", ("2", 1): "E0", ("2", 2): "E1", ("3", 1): "E17", ("3", 2): "E170"}


def test_windows_of_long_texts_do_not_show(monkeypatch):
    forms = ["A", "AB", LONG.upper(), "ZZZ", "É", "한국 기준", "X" * 8, "X" * 9, "X" * 17, "X" * 21, LONG.upper() + "1", LONG.upper() + "2"]
    rows = pa.table({"form": pa.chunked_array([forms]), "query": pa.chunked_array([list(range(len(forms)))]), "whole": pa.chunked_array([pa.array([1] * len(forms), pa.int32())]), "times": pa.chunked_array([pa.array([0] * len(forms), pa.int32())])})
    texts = ["", "XAB" * 30, LONG.upper() + "2 É", "X" * 18, "한국 기준 " + "X" * 40, "ZZ", "Z", LONG.upper()]
    needles = held.Needles(rows)
    names = list(rows["form"].to_pylist())
    want = sorted((i, f) for i, t in enumerate(texts) for f in forms if f in t)
    for size in (7, 50, 1 << 20):
        monkeypatch.setattr("limitlens.plans.spots.SLICE_BYTES", size)
        monkeypatch.setattr(held, "SLICE_BYTES", size)
        at, needle = needles.found(pa.array(texts, pa.large_string()))
        codes = rows["form"].combine_chunks().dictionary_encode().dictionary.to_pylist()
        assert sorted((int(a), codes[n]) for a, n in zip(at, needle)) == want and names
