"""Every query with an SQL twin gives the same rows as the twin."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry
from check import TABLES, table

ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    got = table(df.columns, df.collect())
    cur = con.execute(ORACLE[name])
    want = table([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 101


def test_names():
    names = entry.catalog.all_queries()
    assert names
    for name in names:
        assert name != "pipeline" and not name.startswith("op")
    assert set(ORACLE) <= set(entry.queries())
