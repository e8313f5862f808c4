"""The llm queries against their SQL on the smallest tables."""

import glob
import os

import pytest

from cairn.llm.queries import R


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


@pytest.mark.parametrize("name", sorted(R.queries))
def test_query(spark, sf, name):
    import duckdb

    if name == "p9_found":
        sf = sf.replace("sf0.001", "sf0.01")  # the smallest tables label too few cases to find any
    df = R.queries[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    if name not in R.sql:
        assert got
        return
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    cur = con.execute(R.sql[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    assert got == sorted(repr(tuple(norm(r[names.index(c)]) for c in cols)) for r in cur.fetchall())
