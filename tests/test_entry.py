"""The driver's contract: every query runs, has a stable schema, and most have SQL that gives the same rows."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from cellscope.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return None if v is None else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_entry(spark):
    assert entry.entry(spark).columns == ["k", "score"]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(catalog.queries()) >= 80


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_oracle(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    cols = sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    sql = catalog.oracle_sql().get(name)
    if sql is not None:
        q = duck.sql(sql)
        assert sorted(q.columns) == cols
        at = [q.columns.index(c) for c in cols]
        assert found == sorted((tuple(plain(r[i]) for i in at) for r in q.fetchall()), key=str)
