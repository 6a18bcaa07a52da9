"""Registered series queries against their SQL, on the smallest data."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tidewheel.plans import queries as q

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def norm(v):
    return "nan" if isinstance(v, float) and v != v else str(v + 0.0 if isinstance(v, float) else v)


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, duck, name):
    df = q.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(map(norm, r)) for r in df.select(*cols).collect())
    assert len(set(cols)) == len(cols)
    if name in q.ORACLES:
        rel = duck.sql(q.ORACLES[name])
        assert sorted(rel.columns) == cols
        assert got == sorted(tuple(norm(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["user_id", "ts", "total", "average"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
