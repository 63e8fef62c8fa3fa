"""Every registered query against its statement on the smallest tables."""

import datetime as dt

import duckdb
import pytest

import __spark_entry__ as entry
from crosstape.sources.derived import TABLES

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def cells(row):
    return tuple(v.isoformat() if isinstance(v, (dt.date, dt.datetime)) else v for v in row)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    got = sorted((cells(r[c] for c in cols) for r in df.collect()), key=key)
    if name not in SQL:
        assert got
        return
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    want = sorted((cells(dict(zip(names, r))[c] for c in cols) for r in cur.fetchall()), key=key)
    assert sorted(names) == cols and got == want


def test_flagship(spark):
    assert entry.entry(spark).columns == ["band", "n", "mean", "se", "lo", "hi", "t", "significant"]
