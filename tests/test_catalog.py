"""Every catalogued query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from sievework.plans import catalog, repair  # noqa: F401 - repair adds its queries to the catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if hasattr(v, "asDict"):
        return cell(v.asDict())
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{cell(x)}" for k, x in sorted(v.items())) + "}"
    return "[" + ",".join(map(cell, v)) + "]" if isinstance(v, (list, tuple)) else repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in cols) for r in df.collect())
    if name in catalog.SQL:
        cur = duck.execute(catalog.SQL[name])
        at = [x[0] for x in cur.description]
        assert sorted(at) == cols
        assert got == sorted(tuple(cell(r[at.index(c)]) for c in cols) for r in cur.fetchall())


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
