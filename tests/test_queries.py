"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from midbase import file_queries, queries

QUERIES, SQL = queries.queries() | file_queries.queries(), queries.oracle_sql() | file_queries.oracle_sql()

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(FOLDER):
        c.execute(f"create view {name.split('.')[0]} as select * from '{FOLDER}/{name}'")
    return c


def shown(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    found = con.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(map(shown, r)) for r in found.fetchall())
    assert sorted(tuple(shown(r[c]) for c in columns) for r in df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "flanks"
    assert set(entry.oracle_sql()) <= set(entry.queries())
