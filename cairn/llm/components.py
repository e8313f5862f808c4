"""Consolidating pairwise matches into groups (problem 6): connected components over billions of links.

1. Vertices get dense integer ids in the order of their names, so links are pairs of longs.
2. The giant component is peeled by frontier breadth-first joins from the vertex of highest degree. A web of links has a
   small radius; a peel that is not over after ``peel_rounds`` hops stops, and what it reached is contracted into one
   vertex of the rest, so no link is lost.
3. The rest, with the peeled part anti-joined away, is labelled by minimum propagation: every vertex points at its
   smallest neighbour, the pointers (a forest, as they only fall) are jumped until they reach the roots, the links are
   contracted to the roots, and so on until none is left. Ids are scrambled first (multiplied modulo a prime within each
   stretch of that length, a bijection), so that a chain in name order does not shrink by one link a round.
4. Each group takes the smallest name among its members.

Every round's table is written to the shared folder. A vertex with a third of all links is one row of the label tables,
and AQE splits its side of the joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.session import discard, global_index, materialize

PRIME, FACTOR = 2_147_483_647, 1_103_515_245


def normalized(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def slug_links(near_duplicates: DataFrame, entities: DataFrame) -> DataFrame:
    """Links a, b of both sources, each once with a < b; null and empty ends and links of a slug with itself are none."""
    merged = entities.select(F.col("slug").alias("a"), F.explode("merged_from").alias("b"))
    links = near_duplicates.select(F.col("base").alias("a"), F.col("superset").alias("b")).unionByName(merged)
    links = links.select(normalized("a").alias("a"), normalized("b").alias("b")).filter("a <> '' and b <> '' and a <> b")
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _scrambled(index: Column) -> Column:
    low = index % PRIME
    return index - low + (low * FACTOR) % PRIME


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _peel(edges: DataFrame, rounds: int) -> tuple[DataFrame, int, bool]:
    """Vertices (id) reached from the vertex of highest degree, that vertex, and whether the walk ended."""
    both = _both(edges)
    seed = both.groupBy("u").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "u").first()["u"]
    seen = frontier = materialize(both.sparkSession.range(1).select(F.lit(seed).cast("long").alias("id")), "peel")
    for _ in range(rounds):
        step = both.join(frontier.select(F.col("id").alias("u")), "u", "left_semi").select(F.col("v").alias("id")).distinct()
        new = materialize(step.join(seen, "id", "left_anti"), "peel")
        if new.isEmpty():
            return seen, seed, True
        seen, frontier = seen.unionByName(new), new
    return seen, seed, False


def _propagate(edges: DataFrame) -> DataFrame:
    """(id, root) of every vertex that the links u, v (longs) touch; the root is some vertex of its component."""
    label: DataFrame | None = None
    edges = materialize(edges, "links")
    while not edges.isEmpty():
        both = _both(edges)
        # the smallest neighbour, or itself; partial aggregation collapses a hub before the shuffle
        parent = both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")).select("id", F.least("id", "m").alias("root"))
        parent = materialize(parent, "parents")
        while True:  # pointer jumping: the depth halves
            up = parent.select(F.col("id").alias("root"), F.col("root").alias("_top"))
            jumped = materialize(parent.join(up, "root", "left").select("id", F.coalesce("_top", "root").alias("root"), (F.coalesce("_top", "root") != F.col("root")).alias("_moved")), "parents")
            done = jumped.filter("_moved").isEmpty()
            discard(parent)
            parent = jumped
            if done:
                break
        parent = parent.select("id", "root")
        if label is None:
            label = parent
        else:
            top = parent.select(F.col("id").alias("root"), F.col("root").alias("_top"))
            label = materialize(label.join(top, "root", "left").select("id", F.coalesce("_top", "root").alias("root")), "labels")
        to_u = parent.select(F.col("id").alias("u"), F.col("root").alias("ru"))
        to_v = parent.select(F.col("id").alias("v"), F.col("root").alias("rv"))
        contracted = edges.join(to_u, "u").join(to_v, "v").filter("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
        contracted = materialize(contracted, "links")
        discard(edges)
        edges = contracted
    if label is None:
        label = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return label


def components(links: DataFrame, peel_rounds: int = 12) -> DataFrame:
    """(vertex, group) of every end of ``links`` (a, b: strings): ``group`` is the smallest name linked with it, however indirectly.

    Repeated links, either orientation and links of a vertex with itself change nothing, null ends are dropped, extra
    columns are ignored, and no links give no rows.
    """
    links = links.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")).filter("a is not null and b is not null")
    names = links.select(F.col("a").alias("name")).unionByName(links.select(F.col("b").alias("name"))).distinct()
    ids = materialize(global_index(names, ["name"], "names").withColumn("id", _scrambled(F.col("row_index"))).select("name", "id"), "ids")
    edges = links.filter("a <> b").join(ids.select(F.col("name").alias("a"), F.col("id").alias("u")), "a").join(ids.select(F.col("name").alias("b"), F.col("id").alias("v")), "b")
    edges = materialize(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    if edges.isEmpty():
        return ids.select(F.col("name").alias("vertex"), F.col("name").alias("group"))
    giant, seed, ended = _peel(edges, peel_rounds)
    giant = materialize(giant.select("id", F.lit(seed).cast("long").alias("root")), "giant")
    inside = giant.select(F.col("id").alias("u"))
    if ended:  # a component: both ends of a link are in it or neither is
        rest, over = edges.join(inside, "u", "left_anti"), None
    else:  # contract what was reached and keep its links outwards
        mark = lambda c: giant.select(F.col("id").alias(c), F.col("root").alias(f"r{c}"))
        rest = edges.join(mark("u"), "u", "left").join(mark("v"), "v", "left").select(F.coalesce("ru", "u").alias("x"), F.coalesce("rv", "v").alias("y")).filter("x <> y")
        rest = rest.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()
    label = _propagate(rest)
    if ended:
        label = label.unionByName(giant)
    else:
        over = label.select(F.col("id").alias("root"), F.col("root").alias("_top"))
        moved = giant.join(over, "root", "left").select("id", F.coalesce("_top", "root").alias("root"))
        label = label.filter(F.col("id") != F.lit(seed)).unionByName(moved)
    named = ids.join(label, "id", "left").select("name", F.coalesce("root", "id").alias("root"))
    named = materialize(named, "named")
    least = named.groupBy("root").agg(F.min("name").alias("group"))
    return named.join(least, "root").select(F.col("name").alias("vertex"), "group")
