"""Borda places by windows and by distributed counts, against brute force."""

import random

import pytest

from cairn.llm import fusion

SCHEMA = "q long, d long, a double, b double, extra string"
NAN = float("nan")


def brute(rows, ties, missing):
    out = {}
    distinct = set((q, d, None if a != a else a, None if b is None or b != b else b) for q, d, a, b, _ in [(r[0], r[1], NAN if r[2] is None else r[2], r[3], r[4]) for r in rows])
    for q in {r[0] for r in distinct}:
        own = [r for r in distinct if r[0] == q]
        for r in own:
            for i in (2, 3):
                higher = sum(1 for x in own if x[i] is not None and r[i] is not None and x[i] > r[i])
                tied = sum(1 for x in own if x[i] == r[i])
                if r[i] is None:
                    place = len(own) if missing == "last" else (len(own) + 1) / 2
                else:
                    place = higher + 1 if ties == "min" else higher + (tied + 1) / 2
                out.setdefault(r, []).append(place)
    return out


@pytest.mark.parametrize("ties,missing", [("average", "mid"), ("min", "last")])
@pytest.mark.parametrize("hot", [1_000_000, 3])
def test_places(spark, ties, missing, hot):
    r = random.Random(1)
    value = lambda: r.choice([None, NAN, 0.0, -0.0, 1.0, 2.0, 1e9, -3.5])
    rows = [(r.choice([1, 1, 1, 2, None]), r.randint(0, 30), value(), value(), r.choice("xy")) for _ in range(60)]
    rows += rows[:5]
    got = fusion.borda_places(spark.createDataFrame(rows, SCHEMA), "q", "d", ["a", "b"], ties, missing, hot)
    assert {(x["q"], x["d"], x["a"], x["b"]): [x["place_a"], x["place_b"]] for x in got.collect()} == brute(rows, ties, missing)


def test_scale_of_a_score_does_not_count(spark):
    rows = [(1, i, float(i % 7), float((i * 3) % 11), "") for i in range(20)]
    wide = [(q, d, a * 1e12, b, e) for q, d, a, b, e in rows]
    order = lambda data: [x["d"] for x in fusion.borda(spark.createDataFrame(data, SCHEMA), "q", "d", ["a", "b"]).orderBy("q", "points", "d").collect()]
    assert order(rows) == order(wide)


def test_empty_and_tie_break(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert fusion.best(fusion.borda(empty, "q", "d", ["a", "b"]), "q", "d").count() == 0
    same = spark.createDataFrame([(1, 9, 1.0, 1.0, ""), (1, 4, 1.0, 1.0, "")], SCHEMA)
    assert fusion.best(fusion.borda(same, "q", "d", ["a", "b"]), "q", "d").first()["d"] == 4


@pytest.mark.parametrize("hot", [1_000_000, 3])
def test_rank(spark, hot):
    r = random.Random(2)
    rows = [(r.choice([1, 1, 2]), i, r.choice([0.0, 1.0]), r.choice([0.0, 1.0]), "") for i in range(30)]
    points = fusion.borda(spark.createDataFrame(rows, SCHEMA), "q", "d", ["a", "b"])
    got = fusion.ranked(points, "q", "d", hot).collect()
    for q in (1, 2):
        own = sorted((x for x in got if x["q"] == q), key=lambda x: (-x["points"], x["d"]))
        assert [x["rank"] for x in own] == list(range(1, len(own) + 1))
    assert fusion.ranked(points.limit(0), "q", "d", hot).count() == 0
