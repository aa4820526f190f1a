"""The entry points, and the catalog's queries against their SQL on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from glyphmine.plans import catalog

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")


def norm(v):
    return round(v, 6) if isinstance(v, float) else bytes(v).hex() if isinstance(v, (bytes, bytearray)) else v


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_sql_agrees(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    db = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    r = db.execute(catalog.ORACLE_SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert sorted((tuple(norm(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=str) == got
