"""The stored index: what it holds, counted against the plain postings."""

import pytest
from pyspark.sql import functions as F

from limitlens.operators import postings, query_table, search

ROWS = [
    ("A1", "Market risk", "daily", "Risk", 1), ("A2", "Market risk", "daily", "Risk", 2), ("A1", "Market risk limits", "aaa", "Risk", 3), ("b3", "순자본비율 산정 \U0001f600", "ß", "Capital", 4),
    ("", None, "", "", 5), (None, "risk " * 20, "x", "", 6), ("c4", "a", "A", " a ", None), ("c4", "a", "A", " a ", None),
]


@pytest.fixture(scope="module")
def catalog(spark):
    return search.catalog_entries(spark.createDataFrame(ROWS, "source_id string, title string, note string, category string, row_no long"), "row_no")


@pytest.mark.parametrize("many", [1000, 1])
def test_counted_postings_are_those_of_the_entries(spark, catalog, tmp_path, monkeypatch, many):
    monkeypatch.setattr(postings, "MANY_TEXTS", many)
    path = str(tmp_path / "index")
    postings.append(catalog, path, 4)
    want = search.ngram_postings(catalog).distinct()
    found = postings.signature(spark, path).first()
    assert (found["documents"], found["postings"]) == (len(ROWS), want.count())
    index = postings.open_index(spark, path)
    joined = index.postings().join(index.owners(), "text_key").select("term", "source_id").distinct()
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, want.collect()))
    other = str(tmp_path / "other")
    postings.append(catalog.repartition(3), other, 8)
    assert postings.signature(spark, other).first()["signature"] == found["signature"]


def test_terms_are_stored_once_for_a_text_that_entries_share(spark, tmp_path):
    """Before, each entry had a row for each of its terms."""
    entries = search.catalog_entries(spark.range(200).selectExpr("concat('E', id) source_id", "'one title for all of them' title", "id row_no"), "row_no")
    path = str(tmp_path / "index")
    postings.append(entries, path, 4)
    index = postings.open_index(spark, path)
    assert index.postings().filter(F.col("term") == "TITLE").count() == 1
    assert index.postings().count() < postings.signature(spark, path).first()["postings"] / 10
    asked = query_table.needles(spark.createDataFrame([("1", "title for"), ("2", "E77"), ("3", "zzz")], "query_id string, query string"), query_table.space_tokens)
    assert postings.looked_up(index, asked).count() == 200
    assert [r[0] for r in postings.looked_up(index, asked.filter("query_id = '2'")).select("source_id").collect()] == ["E77"]
    assert postings.looked_up(index, asked.filter("query_id = '3'")).count() == 0
