"""Every core query with SQL gives the same rows in DuckDB; the others run."""

import os

import duckdb
import pytest

from webloom.plans import registry


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, sf, con):
    df = registry.QUERIES[name](spark, sf)
    if name not in registry.ORACLE_SQL:
        assert df.count() > 0
        return
    columns = sorted(df.columns)
    mine = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    theirs = sorted(repr(r) for r in con.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall())
    assert mine == theirs
