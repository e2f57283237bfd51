"""Every label query with SQL is held against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from pantrylens.plans import queries as q

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_same_as_sql(spark, con, name):
    df = q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(q.ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr(plain([r[c] for c in columns])) for r in df.collect()) == sorted(repr(plain([r[i] for i in at])) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLES)))
def test_others_run(spark, name):
    assert q.QUERIES[name](spark, SF).count() > 0
