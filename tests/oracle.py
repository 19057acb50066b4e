"""Side-by-side run of registered queries: Spark against DuckDB on the same parquet files."""

from __future__ import annotations

import math
import os
import sys
import time
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def normal(names: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, connection, name: str, query, sql: str | None, sf_dir: str) -> str:
    """Empty when equal, else a description of the difference."""
    started = time.time()
    df = query(spark, sf_dir)
    got = normal(df.columns, df.collect())
    spark_seconds = time.time() - started
    if sql is None:
        print(f"{name:34s} rows={len(got):7d} spark={spark_seconds:5.2f}s (no oracle)")
        return ""
    started = time.time()
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    want = normal(names, result.fetchall())
    print(f"{name:34s} rows={len(got):7d} spark={spark_seconds:5.2f}s duckdb={time.time() - started:5.2f}s")
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if got != want:
        only_spark = [r for r in got if r not in set(want)][:3]
        only_sql = [r for r in want if r not in set(got)][:3]
        return f"{len(got)} vs {len(want)} rows; spark only {only_spark}; sql only {only_sql}"
    return ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from limitlens.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    session, duck = local_session(), connect(sf)
    if os.environ.get("NO_BROADCAST"):
        # The way of the queries where no side is small enough to broadcast.
        session.conf.set("limitlens.broadcastBytes", "0")
        session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        session.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    oracle = entry.oracle_sql()
    failed = 0
    for key, run in entry.queries().items():
        if wanted and not any(w in key for w in wanted):
            continue
        try:
            problem = compare(session, duck, key, run, oracle.get(key), sf)
        except Exception as error:  # report every query, then fail
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        if problem:
            failed += 1
            print("  FAIL", key, problem)
    print("failed:", failed)
    sys.exit(1 if failed else 0)
