"""Packing: nothing overflows, nothing is split without need, and the bound holds."""

import random
from collections import Counter

from cairn.llm import packing as P


def check(histogram, capacity):
    plan = P.solve(histogram, capacity)
    packed = Counter()
    for n, content in plan.runs:
        assert n > 0 and sum(k * v for k, v in content.items()) <= capacity
        for k, v in content.items():
            packed[k] += n * v
    assert packed == Counter({k: v for k, v in histogram.items() if v})
    assert plan.bound <= plan.containers
    return plan


def test_random_histograms():
    r = random.Random(0)
    for capacity in (7, 50, 512):
        for _ in range(4):
            check({r.randint(1, capacity): r.randint(1, 300) for _ in range(20)}, capacity)


def test_near_the_bound():
    r = random.Random(1)
    h = Counter(r.choice([34, 35, 36, 51, 52, 66, 67, 30, 20]) for _ in range(4000))
    plan = check(h, 100)
    assert plan.containers <= 1.01 * plan.bound + 2


def test_the_program_beats_the_heuristic_where_that_is_far_from_the_bound():
    r = random.Random(3)
    plan = check(Counter(r.randint(300, 900) for _ in range(5000)), 2048)
    assert plan.containers <= 1.005 * plan.bound + 2 < 1.02 * plan.bound < plan.greedy
    plan = check(Counter(r.randint(500, 1099) for _ in range(20000)), 2048)
    assert plan.containers <= 0.96 * plan.greedy and plan.containers <= 1.04 * plan.bound
    plan = check(Counter(r.randint(690, 1024) for _ in range(3000)), 2048)  # two in each, whatever the sizes
    assert plan.containers == 1500 and plan.bound >= 1450


def test_the_heuristic_packs_only_what_rounding_leaves(monkeypatch):
    seen, whole = [], P.best_fit_decreasing
    monkeypatch.setattr(P, "best_fit_decreasing", lambda h, c: (seen.append(sum(x * n for x, n in h.items())), whole(h, c))[1])
    r = random.Random(5)
    h = Counter(min(2048, 1 + int(r.expovariate(1 / 300))) for _ in range(4000))
    check(h, 2048)
    *rests, all_ = seen
    assert all_ == sum(x * n for x, n in h.items()) and max(rests) <= 0.05 * all_


def test_counts_beyond_32_bits():
    plan = P.solve({700: 5_000_000_000, 648: 5_000_000_000, 1348: 7_000_000_000}, 2048)
    assert sum(n * c.get(700, 0) for n, c in plan.runs) == 5_000_000_000 and plan.containers <= 1.01 * plan.bound


def test_triplets_need_the_program():
    plan = check({45: 300, 35: 300, 20: 300}, 100)
    assert plan.containers <= 301


def test_knapsack_is_exact():
    import itertools

    import numpy as np

    lengths, worth, most = np.array([2, 3, 5, 7]), np.array([0.2, 0.35, 0.5, 0.9]), np.array([2.0, 1, 2, 1])
    best = max(sum(c * w for c, w in zip(n, worth)) for n in itertools.product(*(range(int(m) + 1) for m in most)) if sum(c * x for c, x in zip(n, lengths)) <= 12)
    value, _ = P.knapsack(lengths, worth, most, 12)
    assert abs(value[12] - best) < 1e-9
    top, patterns, worths = P.price(lengths, most, worth * most, 12)
    assert abs(top - best) < 1e-9 and abs(worths.max() - best) < 1e-9
    for i, (p, w) in enumerate(zip(patterns, worths)):
        assert i in dict(p) and sum(lengths[k] * n for k, n in p) <= 12 and all(n <= most[k] for k, n in p)
        assert abs(sum(worth[k] * n for k, n in p) - w) < 1e-9


def test_operator(spark):
    rows = [(1, 0), (2, None), (3, 100), (4, 250), (5, 30), (6, 70), (7, 70), (8, 200)]
    df = spark.createDataFrame([(*x, "e") for x in rows], "k long, n long, container string")
    out, plan = P.pack(df, "k", "n", 100)
    got = out.collect()
    load, total = Counter(), Counter()
    for r in got:
        total[r["k"]] += r["size"]
        if r["container"] is not None:
            load[r["container"]] += r["size"]
    assert max(load.values()) <= 100 and total == Counter({k: n or 0 for k, n in rows})
    assert {r["k"] for r in got if r["container"] is None} == {1, 2}
    assert Counter(r["k"] for r in got)[3] == 1 and Counter(r["k"] for r in got)[4] == 3
    report = P.container_report(out, plan, 100).first()
    assert report["containers"] == len(load) and report["tokens"] == sum(load.values()) and report["program"] == plan.containers
    empty, plan = P.pack(df.limit(0), "k", "n", 100)
    assert P.container_report(empty, plan, 100).first()["containers"] == 0
    assert empty.count() == 0 and plan.containers == 0
