"""Every query that has SQL gives the rows of that SQL on the smallest tables."""

import collections
import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as e

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = e.oracle_sql()


def plain(v):
    if isinstance(v, dict):
        return tuple(map(plain, v.values()))
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return collections.Counter(repr(tuple(plain(v[i]) for i in order)) for v in values)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in ORACLES if not n.startswith("op")])
def test_matches_sql(spark, duck, name):
    df = e.queries()[name](spark, SF)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", [n for n in e.queries() if n not in ORACLES and not n.startswith(("op", "pipeline"))])
def test_runs(spark, name):
    assert e.queries()[name](spark, SF).count() >= 0
