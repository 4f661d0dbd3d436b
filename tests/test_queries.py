"""Every registered query with SQL gives DuckDB's rows on the smallest tables; the others give rows."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as e

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
REFERENCE = [n for n in e.queries() if not (n.startswith("op") and n[2].isdigit()) and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def shown(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return [shown(x) for x in v]
    return str(v)


def compare(spark, duck, name):
    df = e.queries()[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted(str([shown(r[c]) for c in cols]) for r in df.collect())
    sql = e.oracle_sql().get(name)
    if sql is None:
        assert ours
        return
    theirs = duck.sql(sql)
    assert sorted(theirs.columns) == cols
    at = [theirs.columns.index(c) for c in cols]
    assert ours == sorted(str([shown(r[i]) for i in at]) for r in theirs.fetchall())


@pytest.mark.skipif(not glob.glob(f"{SF}/*.parquet"), reason="no test tables here")
@pytest.mark.parametrize("name", REFERENCE)
def test_query(spark, duck, name):
    compare(spark, duck, name)


def test_entry(spark):
    assert e.entry(spark).columns == ["path", "score"]
