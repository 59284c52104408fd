"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from plumbline.plans import analysis

DATA = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if type(v).__name__ == "Decimal":
        v = float(v)
    return round(v, 4) if isinstance(v, float) else v


def compare(df, cursor):
    names = sorted(df.columns)
    assert names == sorted(c[0] for c in cursor.description)
    at = [[c[0] for c in cursor.description].index(n) for n in names]
    ours = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[k]) for k in at) for r in cursor.fetchall()), key=repr)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, float) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-4)), (a, b)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(analysis.ORACLES))
def test_query(spark, duck, name):
    compare(analysis.QUERIES[name](spark, DATA), duck.execute(analysis.ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(analysis.QUERIES) - set(analysis.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert analysis.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
