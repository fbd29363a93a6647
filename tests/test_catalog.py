"""Every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(TABLES):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{TABLES}/{name}')")
    return con


def plain(rows) -> list[tuple]:
    def one(x):
        if hasattr(x, "isoformat"):
            return x.isoformat()
        return int(x) if isinstance(x, float) and x.is_integer() else x

    return sorted((tuple("" if x is None else repr(one(x)) for x in r) for r in rows))


@pytest.mark.parametrize("name", sorted(entry.catalog.QUERIES))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, TABLES)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got.count() >= 0
        return
    want = duck.execute(sql)
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert plain(tuple(r[c] for c in columns) for r in got.collect()) == plain(want.fetchall())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
