"""References against brute force."""

import itertools
import random
from datetime import datetime, timedelta

import pytest

from cairn.operators import references as R


def brute(refs, targets, match):
    out = []
    for r in refs:
        given = [i for i, v in enumerate(r[:2]) if v is not None]
        if not given or (match == "simple" and len(given) < 2):
            continue
        if match == "full" and len(given) < 2:
            out.append(r)
        elif not any(all(t[i] == r[i] for i in given) for t in targets):
            out.append(r)
    return sorted(out, key=repr)


@pytest.mark.parametrize("match", ["simple", "full", "partial"])
def test_composite_keys_with_partial_nulls(spark, match):
    r = random.Random(3)
    v = [None, "a", "b", "c"]
    refs = [(r.choice(v), r.choice(v), i) for i in range(60)] + [(None, None, 99)]
    targets = [("a", "a"), ("a", "b"), ("c", None), (None, "b"), ("a", "a")]
    df = spark.createDataFrame(refs, "x string, y string, n int")
    t = spark.createDataFrame(targets, "p string, q string")
    got = sorted((tuple(x) for x in R.orphans(df, t, {"x": "p", "y": "q"}, match).collect()), key=repr)
    assert got == brute(refs, targets, match)
    kept = {tuple(x) for x in R.orphans(df, t, {"x": "p", "y": "q"}, match, keep_matched=True).collect()}
    assert kept == set(refs) - set(got)


def test_empty_targets_and_refs(spark):
    df = spark.createDataFrame([("a",), (None,)], "x string")
    none = spark.createDataFrame([], "p string")
    assert [r["x"] for r in R.orphans(df, none, {"x": "p"}).collect()] == ["a"]
    assert R.orphans(df.limit(0), none, {"x": "p"}).count() == 0


def test_faults_match_definition(spark):
    r = random.Random(5)
    day = lambda n: datetime(2025, 1, 1) + timedelta(days=n)
    keys = [f"k{i}" for i in range(12)]
    refs = [("f", f"id{r.randint(0, 9)}", "note", r.choice(keys), day(r.randint(0, 20))) for _ in range(80)]
    targets = [("note", k, day(r.randint(0, 20))) for k in keys[:9] for _ in range(r.randint(1, 2))]
    gone = [("note", r.choice(keys), day(r.randint(0, 25))) for _ in range(6)] + [("claim", "k1", day(30))]
    got = R.classify(spark.createDataFrame(refs, "field string, id string, kind string, ref string, arrived_at timestamp_ntz"), spark.createDataFrame(targets, "kind string, key string, arrived_at timestamp_ntz"), spark.createDataFrame(gone, "kind string, key string, removed_at timestamp_ntz"))
    expected = set()
    for (f, i, kind, ref), rows in itertools.groupby(sorted(refs), key=lambda x: x[:4]):
        at = min(x[4] for x in rows)
        mine = [t[2] for t in targets if t[:2] == (kind, ref)]
        cut = [g[2] for g in gone if g[:2] == (kind, ref)]
        fault = "missing" if not mine else "removed" if cut and max(cut) > max(mine) else "late" if min(mine) > at else None
        if fault:
            expected.add((f, i, ref, fault))
    assert {(x["field"], x["id"], x["ref"], x["fault"]) for x in got.collect()} == expected
