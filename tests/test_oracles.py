"""Every query with SQL gives what DuckDB gives on the same tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from barwright import oracles
from barwright.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain(value):
    if value is None or value != value:
        return None
    return round(value, 9) + 0.0 if isinstance(value, float) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(oracles.ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    left = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=repr)
    right = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert left == right


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
