"""Components against union-find."""

import random

import pytest

from cairn.llm import components as C


def union_find(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in parent}


def result(spark, links, **options):
    df = spark.createDataFrame(links, "a string, b string").selectExpr("a", "b", "1 as id", "2 as root")
    return {r["vertex"]: r["group"] for r in C.components(df, **options).collect()}


@pytest.mark.parametrize("rounds", [12, 1])
def test_star_chain_and_random(spark, rounds):
    r = random.Random(rounds)
    links = [("hub", f"s{i}") for i in range(80)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(70)] + [(f"r{r.randint(0, 60)}", f"r{r.randint(0, 60)}") for _ in range(40)]
    links += [("x", "x"), ("hub", "s1"), ("s1", "hub"), (None, "y"), ("z", None)]
    assert result(spark, links, peel_rounds=rounds) == union_find(links)


def test_long_giant_is_contracted_when_the_peel_stops(spark):
    links = [("hub", f"a{i}") for i in range(10)] + [("a0", "b0")] + [(f"b{i}", f"b{i + 1}") for i in range(20)]
    assert result(spark, links, peel_rounds=2) == union_find(links)


def test_empty(spark):
    assert result(spark, []) == {}
    assert result(spark, [("a", "a")]) == {"a": "a"}


def test_slug_links_normalize(spark):
    near = spark.createDataFrame([(" Ab ", "cd"), ("CD", "ab"), ("x", ""), ("x", None), ("q", "Q ")], "base string, superset string")
    entities = spark.createDataFrame([("e", ["F ", None, "e", "f"]), ("g", None), ("h", [])], "slug string, merged_from array<string>")
    assert {(r["a"], r["b"]) for r in C.slug_links(near, entities).collect()} == {("ab", "cd"), ("e", "f")}
