"""Hierarchical communities (G9): the Leiden method of Traag, Waltman and van Eck (2019) within connected components.

Components are found by minimum propagation with pointer jumping; each is clustered by one task in numpy. That is the unit
of work modularity needs: a component's partition depends on all of its edges. A component above ``max_edges`` is first
contracted to weighted super-vertices in a distributed way, so no task gets an unbounded group and no vertex or edge is lost.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import materialize

SCHEMA = "id string, level int, parent string, members array<string>"
MAX_SIZE = 1000


def component_labels(edges: DataFrame) -> DataFrame:
    """slug, root: the smallest slug of each connected component of a, b."""
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "components")
    label = materialize(both.groupBy(F.col("a").alias("slug")).agg(F.least(F.col("a"), F.min("b")).alias("root")), "components")
    while True:
        near = both.join(label.withColumnsRenamed({"slug": "b", "root": "r"}), "b").groupBy(F.col("a").alias("slug")).agg(F.min("r").alias("r"))
        low = label.join(near, "slug").select("slug", F.least("root", "r").alias("root"), F.col("root").alias("old"))
        up = label.select(F.col("slug").alias("root"), F.col("root").alias("top"))
        nxt = materialize(low.join(up, "root", "left").select("slug", F.least("root", F.coalesce("top", "root")).alias("root"), "old"), "components")
        moved = not nxt.filter("root <> old").isEmpty()
        label = nxt.select("slug", "root")
        if not moved:
            return label


def contract(edges: DataFrame, max_edges: int) -> tuple[DataFrame, DataFrame]:
    """Edges (root, a, b, weight) between super-vertices, at most ``max_edges`` in each root, and the super-vertex of each vertex (root, slug, top).

    In a round every vertex may join one neighbour, so no two swap: by a hash half of them stand still, and each of the others
    picks the standing one of greatest modularity gain. It joins if it gains even when all that picked the same one join, or
    is the best of these. Where a round no longer takes a twentieth of a root's edges, gain doesn't matter any more in that
    root, so the bound is always reached. Edges are summed and none is dropped; those within a super-vertex become its loop.
    """
    spark = edges.sparkSession
    summed = lambda df: df.groupBy("root", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("weight").alias("weight"))
    edges = materialize(summed(edges), "contract")
    label = edges.select("root", F.explode(F.array("a", "b")).alias("slug")).distinct().withColumn("top", F.col("slug"))
    sizes: dict[str, int] = {}
    pushed: set[str] = set()
    rounds = 0
    while True:
        counts = edges.filter("a <> b").groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") > max_edges)
        now = {r["root"]: r["n"] for r in counts.collect()}  # one row for so many edges
        if not now:
            return edges, label
        pushed |= {r for r, n in now.items() if r in sizes and n > 0.95 * sizes[r]}
        sizes = now
        big = spark.createDataFrame([(r, r in pushed) for r in now], "root string, pushed boolean")
        e = edges.join(F.broadcast(big), "root")
        both = e.select("root", "pushed", "a", "b", "weight").unionByName(e.filter("a <> b").select("root", "pushed", F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
        k = materialize(both.groupBy("root", F.col("a").alias("slug")).agg(F.sum(F.when(F.col("a") == F.col("b"), 2 * F.col("weight")).otherwise(F.col("weight"))).alias("k")), "contract")
        total = k.groupBy("root").agg(F.sum("k").alias("m2"))
        stands = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(rounds)), F.lit(2)) == 0  # noqa: B023, E731
        x = both.filter("a <> b").filter(~stands("a") & stands("b")).join(k.withColumnsRenamed({"slug": "a", "k": "ka"}), ["root", "a"]).join(k.withColumnsRenamed({"slug": "b", "k": "kb"}), ["root", "b"]).join(F.broadcast(total), "root")
        gain = lambda near: F.col("weight") - F.try_divide(F.col("ka") * near, F.col("m2"))
        pick = x.withColumn("gain", F.coalesce(gain(F.col("kb")), F.lit(0.0))).filter("pushed or gain > 0").groupBy("root", "a").agg(F.max_by(F.struct("b", "weight", "ka", "kb", "m2", "pushed", "gain"), F.struct("gain", "b")).alias("p")).select("root", "a", "p.*")
        pick = materialize(pick, "contract")
        crowd = pick.groupBy("root", "b").agg(F.sum("ka").alias("kc"), F.max_by("a", F.struct("gain", "a")).alias("best"))
        joins = pick.join(crowd, ["root", "b"]).filter((gain(F.col("kb") + F.col("kc") - F.col("ka")) > 0) | (F.col("a") == F.col("best")) | F.col("pushed"))
        joins = materialize(joins.select("root", F.col("a").alias("top"), F.col("b").alias("into")), "contract")
        label = materialize(label.join(joins, ["root", "top"], "left").select("root", "slug", F.coalesce("into", "top").alias("top")), "contract")
        to = lambda c: joins.withColumnsRenamed({"top": c, "into": f"{c}_into"})  # noqa: B023, E731
        moved = edges.join(to("a"), ["root", "a"], "left").join(to("b"), ["root", "b"], "left")
        edges = materialize(summed(moved.select("root", F.coalesce("a_into", "a").alias("a"), F.coalesce("b_into", "b").alias("b"), "weight")), "contract")
        rounds += 1


def leiden(n: int, edges: list[tuple[int, int, float]], seed: int = 42, resolution: float = 1.0) -> np.ndarray:
    """A partition of 0..n-1 of high modularity: local moving, refinement, aggregation, until nothing changes."""
    rng = np.random.default_rng(seed)
    adj: list[dict[int, float]] = [defaultdict(float) for _ in range(n)]
    self_w = np.zeros(n)
    for a, b, w in edges:
        if a == b:
            self_w[a] += w
        else:
            adj[a][b] += w
            adj[b][a] += w
    total = sum(sum(d.values()) for d in adj) / 2 + self_w.sum()
    label = np.arange(n)
    if total == 0:
        return label
    part = np.arange(n)  # of the present (aggregated) nodes
    while True:
        size = len(adj)
        k = np.array([sum(d.values()) for d in adj]) + 2 * self_w
        part, moved = _move(adj, k, total, part, rng, resolution, np.zeros(size, int))
        refined, _ = _move(adj, k, total, np.arange(size), rng, resolution, part, once=True)
        _, refined = np.unique(refined, return_inverse=True)
        count = refined.max() + 1
        if count == size:
            _, part = np.unique(part, return_inverse=True)
            return part[label]
        new_adj: list[dict[int, float]] = [defaultdict(float) for _ in range(count)]
        new_self = np.zeros(count)
        for a in range(size):
            new_self[refined[a]] += self_w[a]
            for b, w in adj[a].items():
                if refined[a] == refined[b]:
                    new_self[refined[a]] += w / 2
                else:
                    new_adj[refined[a]][refined[b]] += w
        new_part = np.zeros(count, int)
        new_part[refined] = part
        label, adj, self_w = refined[label], new_adj, new_self
        _, part = np.unique(new_part, return_inverse=True)
        del moved


def _move(adj: list, k: np.ndarray, total: float, part: np.ndarray, rng: np.random.Generator, resolution: float, within: np.ndarray, once: bool = False) -> tuple[np.ndarray, bool]:
    """Move nodes to the neighbouring community of greatest gain, among those of the same ``within``; ``once``: only nodes still alone move (refinement)."""
    part = part.copy()
    weight = np.bincount(part, k, len(adj)).astype(float)
    members = np.bincount(part, minlength=len(adj))
    queue, queued, moved = list(rng.permutation(len(adj))), np.ones(len(adj), bool), False
    while queue:
        v = queue.pop()
        queued[v] = False
        own = part[v]
        if once and members[own] > 1:
            continue
        links: dict[int, float] = defaultdict(float)
        for u, w in adj[v].items():
            if within[u] == within[v]:
                links[part[u]] += w
        weight[own] -= k[v]
        base = links.get(own, 0.0) - resolution * k[v] * weight[own] / (2 * total)
        best, gain = own, base + 1e-12
        for c in sorted(links):
            g = links[c] - resolution * k[v] * weight[c] / (2 * total)
            if g > gain:
                best, gain = c, g
        weight[best] += k[v]
        if best != own:
            members[own] -= 1
            members[best] += 1
            part[v], moved = best, True
            if not once:
                for u in adj[v]:
                    if part[u] != best and not queued[u]:
                        queued[u] = True
                        queue.insert(0, u)
    return part, moved


def _hierarchy(names: list[str], edges: list[tuple[int, int, float]], seed: int, max_size: int, level: int = 0, parent: str | None = None) -> list[tuple[str, int, str | None, list[str]]]:
    part = leiden(len(names), edges, seed)
    if level and part.max() == 0:
        return []  # it cannot be divided
    out = []
    for c in range(part.max() + 1):
        inside = np.flatnonzero(part == c)
        members = sorted(names[i] for i in inside)
        own = "g_" + hashlib.sha256(f"{level}|{'|'.join(members)}".encode()).hexdigest()[:20]
        out.append((own, level, parent, members))
        if len(inside) > max_size:
            at = {int(i): j for j, i in enumerate(inside)}
            sub = [(at[a], at[b], w) for a, b, w in edges if a in at and b in at]
            out += _hierarchy([names[i] for i in inside], sub, seed, max_size, level + 1, own)
    return out


def _frame(edges: pd.DataFrame) -> tuple[list[str], list[tuple[int, int, float]]]:
    names = sorted(set(edges["a"]) | set(edges["b"]))
    at = {s: i for i, s in enumerate(names)}
    edges = edges.sort_values(["a", "b"])
    return names, [(at[a], at[b], float(w)) for a, b, w in zip(edges["a"], edges["b"], edges["weight"], strict=True)]


def _whole(seed: int, max_size: int, level: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = _hierarchy(*_frame(pdf), seed, max_size, level, pdf["root"].iloc[0] if level else None)
        return pd.DataFrame(rows, columns=["id", "level", "parent", "members"])

    return run


def communities(edges: DataFrame, seed: int = 42, max_size: int = MAX_SIZE, max_edges: int = 2_000_000) -> DataFrame:
    """id, level, parent, members of the communities of a weighted graph (a, b, weight). Levels are partitions, children nest in parents, ids follow from the members."""
    edges = materialize(edges.select("a", "b", F.col("weight").cast("double").alias("weight")), "cluster")
    label = component_labels(edges)
    e = edges.join(label.withColumnsRenamed({"slug": "a"}), "a").select("root", "a", "b", "weight")
    found, level = None, 0
    while True:  # one turn for each level of communities above the bound; from level 1 on, root is the parent
        big = materialize(e.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") > max_edges).select("root"), "cluster")
        more = not big.isEmpty()
        small = e.join(big, "root", "left_anti").select("root", "a", "b", "weight") if more else e
        part = small.groupBy("root").applyInPandas(_whole(seed, max_size, level), SCHEMA)
        found = part if found is None else found.unionByName(part)
        if not more:
            return found
        e = materialize(e.join(big, "root", "left_semi"), "cluster")
        own, member = _divide(e, seed, level, max_edges)
        found = found.unionByName(own.select("id", "level", "parent", "members"))
        member = materialize(member.join(own.filter(F.size("members") > max_size).select("id"), "id", "left_semi"), "cluster")
        ends = lambda c: member.withColumnsRenamed({"slug": c, "id": f"{c}_id"})  # noqa: B023, E731
        inner = e.join(ends("a"), ["root", "a"]).join(ends("b"), ["root", "b"]).filter("a_id = b_id").select(F.col("a_id").alias("root"), "a", "b", "weight")
        # a loop without weight keeps a vertex whose edges all leave the community
        e = materialize(inner.unionByName(member.select(F.col("id").alias("root"), F.col("slug").alias("a"), F.col("slug").alias("b"), F.lit(0.0).alias("weight"))), "cluster")
        level += 1


def _divide(e: DataFrame, seed: int, level: int, max_edges: int) -> tuple[DataFrame, DataFrame]:
    """One level of communities of groups that are too large for one task (id, level, parent, members), clustered as super-vertices, and their vertices (root, slug, id)."""
    few, label = contract(e, max_edges)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, links = _frame(pdf)
        return pd.DataFrame({"root": pdf["root"].iloc[0], "top": names, "part": leiden(len(names), links, seed)})

    parts = few.groupBy("root").applyInPandas(run, "root string, top string, part int")
    own = materialize(label.join(parts, ["root", "top"]).select("root", "slug", "part"), "divide")
    if level:  # what cannot be divided has no children
        own = own.join(own.groupBy("root").agg(F.max("part").alias("last")).filter("last > 0").select("root"), "root", "left_semi")
    out = own.groupBy("root", "part").agg(F.array_sort(F.collect_list("slug")).alias("members"))
    name = F.concat(F.lit("g_"), F.substring(F.sha2(F.concat(F.lit(f"{level}|"), F.array_join("members", "|")), 256), 1, 20))
    out = materialize(out.select("root", "part", name.alias("id"), F.lit(level).alias("level"), (F.col("root") if level else F.lit(None).cast("string")).alias("parent"), "members"), "divide")
    return out, own.join(out.select("root", "part", "id"), ["root", "part"]).select("root", "slug", "id")


def community_hashes(found: DataFrame, entity_hashes: DataFrame) -> DataFrame:
    """id, input_hash of communities from the evidence hashes of their members, in order.

    A tree of two levels: members are hashed in order within each of 4,096 buckets of their names, then the buckets, so no task
    holds a whole community.
    """
    m = found.select("id", F.explode("members").alias("slug")).join(entity_hashes, "slug", "left")
    ordered = lambda *c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*c))), lambda x: F.concat_ws("=", x[c[0]], x[c[1]])), "\n")
    low = m.withColumn("h", F.coalesce("input_hash", F.lit("None"))).groupBy("id", F.substring(F.md5("slug"), 1, 3).alias("bucket")).agg(F.sha2(ordered("slug", "h"), 256).alias("b"))
    return low.groupBy("id").agg(F.concat(F.lit("sha256:"), F.sha2(ordered("bucket", "b"), 256)).alias("input_hash"))
