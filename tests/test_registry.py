"""Every registered query against DuckDB, and the driver contract."""

import pytest

import __spark_entry__ as entry
from limitlens.registry.all_queries import QUERIES
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    assert compare(spark, duck, name, entry.queries()[name], entry.oracle_sql().get(name), sf_dir) == ""


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(entry.queries()) and set(QUERIES) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "status" in df.columns
