import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from quiver.plans import catalogue as C

TABLES = [p.stem for p in Path("/root/testdata/sf0.01").glob("*.parquet")]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(C.ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    df = C.QUERIES[name](spark, sf)
    want = duck.execute(f"SELECT {', '.join(df.columns)} FROM ({C.ORACLES[name]})").fetchall()
    assert len(duck.execute(C.ORACLES[name]).description) == len(df.columns)
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", [n for n in C.QUERIES if n not in C.ORACLES])
def test_query_runs(spark, sf, name):
    rows = C.QUERIES[name](spark, sf).collect()
    assert rows


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries()) and os.path.exists(entry.SMOKE)
