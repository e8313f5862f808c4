"""The driver's contract: every registered query against its SQL on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry

CORE = sorted({n for m in entry.CORE for n in __import__(m, fromlist=["R"]).R.queries})


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


def compare(spark, sf, name):
    import duckdb

    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(norm(r[names.index(c)]) for c in cols)) for r in cur.fetchall())
    assert got == want


@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, sf, name):
    compare(spark, sf, name)


def test_entry_has_rows(spark, sf):
    assert entry.entry(spark).count() > 0
