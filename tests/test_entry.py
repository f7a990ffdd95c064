"""The driver contract: every query runs, and equals its SQL twin where it has one."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="session")
def sql(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if not n.startswith("p") or n.startswith(("p6", "page", "placeholder"))))
def test_query_equals_sql(spark, sql, sf, name):
    df = entry.queries()[name](spark, sf)
    rows = df.collect()
    if name not in entry.oracle_sql():
        assert rows
        return
    rel = sql.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    want = rel.fetchall()
    assert sorted(df.columns) == sorted(names)
    key = lambda r: repr(r)
    a = sorted((tuple(_norm(r[c]) for c in sorted(df.columns)) for r in rows), key=key)
    b = sorted((tuple(_norm(dict(zip(names, r))[c]) for c in sorted(names)) for r in want), key=key)
    assert a == b
