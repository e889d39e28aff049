"""Every query runs; those with SQL agree with DuckDB."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as E
from lodeseam.plans import problems, reference

D = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not Path(D).exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in Path(D).iterdir():
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}{'/*.parquet' if f.is_dir() else ''}'")
    return c


def plain(v):
    return f"{v:.6g}" if isinstance(v, float) else "[" + ",".join(map(plain, v)) + "]" if isinstance(v, list) else str(v)


def check(spark, con, name):
    df = E.queries()[name](spark, D)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name in E.oracle_sql():
        rel = con.sql(E.oracle_sql()[name])
        assert sorted(rel.columns) == cols
        at = [rel.columns.index(c) for c in cols]
        assert got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", [n for m in (reference, problems) for n in m.QUERIES])
def test_query(spark, con, name):
    check(spark, con, name)


def test_entry(spark):
    assert E.entry(spark).columns
