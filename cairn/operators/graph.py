"""Walks and lints over the folded graph. Frontier steps are equi-joins on an undirected view, never an OR-join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.scalars import digit_signature
from cairn.session import materialize

MIN_BASE = 4


def undirected(edges: DataFrame) -> DataFrame:
    """Every edge from both of its ends: slug, other, and the edge's columns (J7, F5, G22); a self-loop once."""
    one = edges.withColumns({"slug": F.col("source"), "other": F.col("target")})
    two = edges.filter("source <> target").withColumns({"slug": F.col("target"), "other": F.col("source")})
    return one.unionByName(two)


def neighbours(edges: DataFrame, seeds: DataFrame, depth: int = 1, types: list[str] | None = None) -> DataFrame:
    """slug, hop, via of everything within ``depth`` traversable hops of the seeds (slug); first seen wins, seeds are left out.

    ``via`` is the smallest edge key that reached the slug in its hop. The visited set is written every hop, so lineage
    does not grow with depth.
    """
    e = undirected(edges.filter("traversable"))
    if types is not None:
        e = e.filter(F.col("type").isin(types))
    e = e.select("slug", "other", "key")
    seen = materialize(seeds.select("slug", F.lit(0).alias("hop"), F.lit(None).cast("string").alias("via")).distinct(), "walk")
    frontier = seen
    for hop in range(1, depth + 1):
        step = e.join(frontier.select("slug"), "slug").groupBy(F.col("other").alias("slug")).agg(F.min("key").alias("via"))
        frontier = materialize(step.join(seen.select("slug"), "slug", "left_anti").select("slug", F.lit(hop).alias("hop"), "via"), "walk")
        seen = seen.unionByName(frontier)
    return seen.filter("hop > 0")


def isolated(entities: DataFrame, assertions: DataFrame, claims: DataFrame) -> DataFrame:
    """Entities that no undismissed assertion or claim mentions (J15): two anti-joins."""
    live = assertions.filter("status <> 'dismissed'")
    ends = live.select(F.explode(F.array("source", "target")).alias("slug")).distinct()
    subjects = claims.filter("status <> 'dismissed'").select(F.col("subject").alias("slug")).distinct()
    return entities.join(ends, "slug", "left_anti").join(subjects, "slug", "left_anti")


def cluster_graph(aggregates: DataFrame, edge_types: DataFrame) -> DataFrame:
    """a < b, weight: traversable edges without direction, parallel ones summed; types of zero weight and self-loops left out."""
    w = aggregates.filter("traversable").join(edge_types.filter("weight > 0").select("type", F.col("weight").alias("_cw")), "type")
    w = w.filter("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), (F.greatest("weight", F.lit(1)) * F.col("_cw")).alias("w"))
    return w.groupBy("a", "b").agg(F.sum("w").alias("weight"))


def near_duplicates(slugs: DataFrame, aggregates: DataFrame, aliased: DataFrame | None = None) -> DataFrame:
    """base, superset: slugs that contain exactly one other of at least four characters with the same digit runs, neither aliased
    nor siblings under one labelled neighbour (J11, J13, J14, G12).

    Containment is an equi-join on the superset's substrings, whose number its own length bounds: no pairs are tried that don't match.
    """
    s = slugs.select("slug").distinct()
    length = F.length("slug")
    starts = F.sequence(F.lit(1), F.greatest(length - MIN_BASE + 1, F.lit(1)))
    parts = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(MIN_BASE), F.greatest(length - i + 1, F.lit(MIN_BASE))), lambda n: F.substring(F.col("slug"), i, n))))
    grams = s.filter(length > MIN_BASE).select(F.col("slug").alias("superset"), F.explode(F.array_distinct(parts)).alias("base")).filter("base <> superset")
    pairs = grams.join(s.filter(length >= MIN_BASE).select(F.col("slug").alias("base")), "base").filter(digit_signature("base") == digit_signature("superset"))
    one = pairs.groupBy("superset").agg(F.count("*").alias("n"), F.min("base").alias("base")).filter("n = 1").select("base", "superset")
    if aliased is not None:  # a, b in either order
        both = aliased.select(F.col("a").alias("base"), F.col("b").alias("superset")).unionByName(aliased.select(F.col("b").alias("base"), F.col("a").alias("superset")))
        one = one.join(both.distinct(), ["base", "superset"], "left_anti")
    near = undirected(aggregates).select("slug", "type", "other").distinct()
    sib = one.join(near.withColumnsRenamed({"slug": "base"}), "base").join(near.withColumnsRenamed({"slug": "superset"}), ["superset", "type", "other"]).select("base", "superset").distinct()
    return one.join(sib, ["base", "superset"], "left_anti")


def similar(vectors: DataFrame, floor: float, block: int = 1024) -> DataFrame:
    """left, right, cosine of pairs at or above ``floor`` (J12, G13), left < right.

    Exact at any size: rows are cut into blocks, and each pair of blocks is one task's matrix product; the blocks' number is
    the square root of the tasks'. A random-hyperplane prefilter isn't used, as it could lose pairs.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("id"), "embedding").filter("embedding is not null")
    n = max(1, -(-v.count() // block))
    v = v.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    # each row goes to the n block pairs it takes part in
    cells = v.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(F.least("b", "other").alias("x"), F.greatest("b", "other").alias("y"), (F.col("b") <= F.col("other")).alias("first"), "b", "id", "embedding")

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].iloc[0], pdf["y"].iloc[0]
        m = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        ids, b = pdf["id"].to_numpy(), pdf["b"].to_numpy()
        left, right = np.flatnonzero(b == x), np.flatnonzero(b == y)
        c = m[left] @ m[right].T
        i, j = np.nonzero(c >= floor)
        p, q, s = ids[left[i]], ids[right[j]], c[i, j]
        keep = p < q if x == y else np.ones(len(p), bool)
        return pd.DataFrame({"left": np.minimum(p, q)[keep], "right": np.maximum(p, q)[keep], "cosine": s[keep]})

    return cells.groupBy("x", "y").applyInPandas(pairs, "left long, right long, cosine double")


def type_findings(instances: DataFrame, entities: DataFrame, entity_types: list[str]) -> DataFrame:
    """kind, slug, notes (how many): unknown types, several configured types, and entities that no note declares."""
    typed = instances.filter("type is not null")
    notes = F.count_distinct("note_id").alias("notes")
    unknown = typed.filter(~F.col("type").isin(entity_types)).groupBy("slug").agg(notes).select(F.lit("unknown_entity_type").alias("kind"), "slug", "notes")
    per = typed.filter(F.col("type").isin(entity_types)).groupBy("slug").agg(F.count_distinct("type").alias("n"), notes)
    conflict = per.filter("n > 1").select(F.lit("conflicting_entity_type").alias("kind"), "slug", "notes")
    only = entities.join(instances.select("slug").distinct(), "slug", "left_anti").select(F.lit("reference_only_entity").alias("kind"), "slug", F.lit(0).cast("long").alias("notes"))
    return unknown.unionByName(conflict).unionByName(only)


def ambiguous_aliases(aliases: DataFrame) -> DataFrame:
    """alias, slugs of aliases (slug, alias) that several entities claim."""
    return aliases.groupBy("alias").agg(F.array_sort(F.collect_set("slug")).alias("slugs")).filter(F.size("slugs") > 1)


def proposals(assertions: DataFrame, adopted: DataFrame) -> DataFrame:
    """kind, proposed, count, example of the wordings not adopted (A10). The example is that of the smallest id."""
    wording = F.regexp_replace(F.regexp_replace(F.lower("proposed_type"), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    p = assertions.filter("type is null and proposed_type is not null").withColumn("proposed", wording).withColumn("kind", F.lit("edge"))
    p = p.join(adopted.select("kind", "proposed"), ["kind", "proposed"], "left_anti")
    example = F.concat_ws(" ", "source", "proposed_type", "target")
    return p.groupBy("kind", "proposed").agg(F.count("*").alias("count"), F.min_by(example, "id").alias("example"))


def signature_findings(assertions: DataFrame, entities: DataFrame, rules: DataFrame) -> DataFrame:
    """id, finding of typed assertions against their type's domain and range (V5, G15). rules: type, domain, range (arrays, null: any).

    ``reverse`` if only the swapped ends fit, ``mismatch`` if neither does; an end of unknown type never violates.
    """
    t = entities.select("slug", F.nullif("type", F.lit("unknown")).alias("t"))
    a = assertions.join(rules, "type").join(t.withColumnsRenamed({"slug": "source", "t": "s_type"}), "source", "left").join(t.withColumnsRenamed({"slug": "target", "t": "t_type"}), "target", "left")
    fits = lambda x, allowed: F.col(x).isNull() | F.col(allowed).isNull() | F.array_contains(allowed, F.coalesce(F.col(x), F.lit("")))
    forward, backward = fits("s_type", "domain") & fits("t_type", "range"), fits("t_type", "domain") & fits("s_type", "range")
    return a.filter(~forward).select("id", F.when(backward, "reverse").otherwise("mismatch").alias("finding"))


def overlaps(fresh: DataFrame, previous: DataFrame) -> DataFrame:
    """level, fresh, previous, score: the Jaccard index of groups (level, id, m: a member a row) of one level that share members.

    An equi-join on (level, member); sizes are counted, so no row holds a group.
    """
    f, p = fresh.select("level", F.col("id").alias("fresh"), "m").distinct(), previous.select("level", F.col("id").alias("previous"), "m").distinct()
    nf, np_ = f.groupBy("level", "fresh").agg(F.count("*").alias("nf")), p.groupBy("level", "previous").agg(F.count("*").alias("np"))
    both = f.join(p, ["level", "m"]).groupBy("level", "fresh", "previous").agg(F.count("*").alias("common"))
    both = both.join(nf, ["level", "fresh"]).join(np_, ["level", "previous"])
    return both.select("level", "fresh", "previous", (F.col("common") / (F.col("nf") + F.col("np") - F.col("common"))).alias("score"))


def lineage_pairs(fresh: DataFrame, previous: DataFrame) -> DataFrame:
    """``overlaps`` of communities (id, level, members)."""
    long_ = lambda df: df.select("level", "id", F.explode("members").alias("m"))
    return overlaps(long_(fresh), long_(previous))


def match_lineages(fresh: DataFrame, previous: DataFrame, floor: float = 0.5) -> DataFrame:
    """fresh, previous matched one to one, greedily by (score descending, fresh, previous), within each level.

    Done in rounds without a driver loop over pairs: a pair that is first for both of its ends is taken, as greedy would.
    """
    left = materialize(lineage_pairs(fresh, previous).filter(F.col("score") >= floor), "lineage")
    taken = []
    while not left.isEmpty():
        order = [F.desc("score"), F.col("fresh"), F.col("previous")]
        r = left.withColumn("a", F.row_number().over(Window.partitionBy("fresh").orderBy(*order))).withColumn("b", F.row_number().over(Window.partitionBy("previous").orderBy(*order)))
        got = materialize(r.filter("a = 1 and b = 1").select("level", "fresh", "previous", "score"), "lineage")
        taken.append(got)
        left = materialize(left.join(got.select("fresh"), "fresh", "left_anti").join(got.select("previous"), "previous", "left_anti"), "lineage")
    out = fresh.limit(0).select("level", F.col("id").alias("fresh"), F.col("id").alias("previous"), F.lit(0.0).alias("score"))
    for g in taken:
        out = out.unionByName(g)
    return out
