"""Every query that has SQL against DuckDB on the same small tables."""

import math
import os

import duckdb
import pytest

from tidemark.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return f"{v + 0.0:.9g}"
    return f"{v:.9g}" if isinstance(v, int) and not isinstance(v, bool) else str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(str(plain(r[i])) for i in order) for r in found)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


def test_every_query_runs(spark):
    for name in sorted(set(QUERIES) - set(ORACLE)):
        assert QUERIES[name](spark, SF).columns
