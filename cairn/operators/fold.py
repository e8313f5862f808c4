"""The fold: notes, items and overlays become entities, assertions, weighted edges and claims. One pure pass of joins and aggregations.

Order never matters: what depends on the order of notes (created, then id) is an aggregation over that key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.logfolds import status_of
from cairn.session import materialize


@dataclass
class Graph:
    """Long tables throughout: a slug or an edge may hold a third of all rows, so no row holds a list of them.

    entities: slug, type, rank, declared. entity_notes: slug, note_id. entity_units: slug, unit_id. merged_from: slug, name.
    members: key, id of the assertions of each aggregate.
    """

    entities: DataFrame
    assertions: DataFrame
    aggregates: DataFrame
    claims: DataFrame
    revived: DataFrame
    members: DataFrame
    entity_notes: DataFrame
    entity_units: DataFrame
    merged_from: DataFrame


def canonical(df: DataFrame, column: str, merges: DataFrame) -> DataFrame:
    """Replace slugs that were merged away."""
    m = merges.select(F.col("duplicate").alias(column), F.col("canonical").alias("_canon"))
    return df.join(m, column, "left").withColumn(column, F.coalesce("_canon", column)).drop("_canon")


def fold_assertions(assertions: DataFrame, statuses: DataFrame, adoptions: DataFrame, merges: DataFrame) -> DataFrame:
    """Status from the decisions, adopted types for untyped items, canonical ends."""
    st = statuses.select(F.col("assertion").alias("id"), "action")
    ad = adoptions.filter("kind = 'edge'").select(F.col("proposed").alias("_wording"), "adopted")
    wording = F.regexp_replace(F.regexp_replace(F.lower("proposed_type"), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    a = assertions.withColumn("_wording", F.when(F.col("type").isNull(), wording)).join(ad, "_wording", "left")
    a = a.withColumn("type", F.coalesce("type", "adopted")).drop("adopted", "_wording").drop("status")
    a = a.join(st, "id", "left").withColumn("status", status_of(F.coalesce("action", F.lit("reopen")))).drop("action")
    a = a.withColumns({"raw_source": F.col("source"), "raw_target": F.col("target")})  # what a note itself names
    return canonical(canonical(a, "source", merges), "target", merges)


def _shaped(assertions: DataFrame, edge_types: DataFrame) -> DataFrame:
    """Typed assertions with the key and the ends of their aggregate, symmetric ends sorted."""
    t = assertions.filter("type is not null").join(edge_types.select("type", "symmetric"), "type")
    left = F.when(F.col("symmetric"), F.least("source", "target")).otherwise(F.col("source"))
    right = F.when(F.col("symmetric"), F.greatest("source", "target")).otherwise(F.col("target"))
    shaped = t.select("id", "status", "strength", left.alias("source"), "type", right.alias("target"))
    return shaped.withColumn("key", F.concat(F.lit("r:"), "source", F.lit("|"), "type", F.lit("|"), "target"))


def aggregate_edges(assertions: DataFrame, edge_types: DataFrame) -> DataFrame:
    """Typed assertions grouped by (source, type, target) (A1): only sums and counts, which combine before the shuffle. ``edge_types``: type, symmetric, weight."""
    done = F.col("status") == "confirmed"
    g = _shaped(assertions, edge_types).groupBy("key", "source", "type", "target").agg(
        F.count_if(done).alias("weight"), F.coalesce(F.avg(F.when(done, F.col("strength"))), F.lit(0.0)).alias("mean_strength"), F.count("*").alias("n_assertions")
    )
    return g.withColumn("traversable", F.col("weight") > 0)


def edge_members(assertions: DataFrame, edge_types: DataFrame) -> DataFrame:
    """key, id of the assertions of each aggregate."""
    return _shaped(assertions, edge_types).select("key", "id")


def degree(aggregates: DataFrame) -> DataFrame:
    """slug, rank: ends of traversable edges, a self-loop counting twice (A2)."""
    ends = aggregates.filter("traversable").select(F.explode(F.array("source", "target")).alias("slug"))
    return ends.groupBy("slug").agg(F.count("*").alias("rank"))


def fold_claims(claims: DataFrame, statuses: DataFrame, merges: DataFrame) -> DataFrame:
    """Status of the claims; those that a confirmed claim supersedes are superseded, by one look at the state before."""
    st = statuses.select(F.col("assertion").alias("id"), "action")
    c = claims.drop("status").join(st, "id", "left").withColumn("status", status_of(F.coalesce("action", F.lit("reopen")))).drop("action")
    old = c.filter("status = 'confirmed' and supersedes is not null").select(F.col("supersedes").alias("id")).distinct().withColumn("_over", F.lit(True))
    c = c.join(old, "id", "left").withColumn("_before", F.col("status")).withColumn("status", F.when(F.col("_over"), "superseded").otherwise(F.col("status"))).drop("_over")
    return canonical(c.withColumn("raw_subject", F.col("subject")), "subject", merges)


def fold(
    notes: DataFrame, instances: DataFrame, assertions: DataFrame, claims: DataFrame, statuses: DataFrame, adoptions: DataFrame, merges: DataFrame, retired: DataFrame, edge_types: DataFrame, entity_types: list[str], write: bool = False
) -> Graph:
    """The graph of a vault. ``write`` keeps assertions, edges, claims, touches and entities as tables, for plans that read them more than once.

    notes: id, created. instances: note_id, pos, slug, type (null: untyped). assertions, claims: with note_id, text_unit_ids. Items of unknown notes are dropped."""
    order = notes.select(F.col("id").alias("note_id"), "created")
    a = fold_assertions(assertions.join(order.select("note_id"), "note_id", "left_semi"), statuses, adoptions, merges)
    c = fold_claims(claims.join(order.select("note_id"), "note_id", "left_semi"), statuses, merges)
    if write:
        a, c = materialize(a, "gold-assertions"), materialize(c, "gold-claims")
    edges = aggregate_edges(a, edge_types)
    if write:
        edges = materialize(edges, "gold-edges")
    none = F.lit(None).cast("array<string>")
    touch = (
        instances.select("note_id", "slug", "type", F.col("pos").cast("string").alias("pos"), none.alias("units"), F.lit(True).alias("declared"), F.lit(False).alias("live"))
        .unionByName(_touched(a, "raw_source"))
        .unionByName(_touched(a, "raw_target"))
        .unionByName(_touched(c.withColumn("text_unit_ids", none).withColumn("status", F.col("_before")), "raw_subject"))
    )
    touch = touch.withColumn("raw", F.col("slug")).join(order, "note_id")
    touch = canonical(touch, "slug", merges)
    if write:
        touch = materialize(touch, "gold-touches")
    known = F.col("type").isin(*entity_types)
    per = touch.groupBy("slug").agg(
        F.max_by(F.when(known, F.col("type")), F.when(known, F.struct("created", "note_id", "pos"))).alias("type"),
        F.bool_or("declared").alias("declared"),
        F.bool_or("live").alias("live"),
    )
    gone = canonical(retired.select("slug"), "slug", merges).distinct().withColumn("_retired", F.lit(True))
    per = per.join(gone, "slug", "left").withColumn("_retired", F.coalesce("_retired", F.lit(False)))
    kept = per.filter("live or (declared and not _retired)").join(degree(edges), "slug", "left")
    entities = kept.select("slug", F.coalesce("type", F.lit("unknown")).alias("type"), F.coalesce("rank", F.lit(0)).cast("long").alias("rank"), "declared")
    if write:
        entities = materialize(entities, "gold-entities")
    revived = per.filter("live and _retired").select("slug")
    own = entities.select("slug")
    entity_notes = touch.select("slug", "note_id").distinct().join(own, "slug", "left_semi")
    entity_units = touch.select("slug", F.explode("units").alias("unit_id")).distinct().join(own, "slug", "left_semi")
    merged_from = touch.filter("raw <> slug").select("slug", F.col("raw").alias("name")).distinct().join(own, "slug", "left_semi")
    return Graph(entities, a, edges, c.drop("_before"), revived, edge_members(a, edge_types), entity_notes, entity_units, merged_from)


def _touched(items: DataFrame, name: str) -> DataFrame:
    """What items touch under the name that they give; dismissed ones don't keep it alive."""
    none = F.lit(None).cast("string")
    return items.select("note_id", F.col(name).alias("slug"), none.alias("type"), none.alias("pos"), F.col("text_unit_ids").alias("units"), F.lit(False).alias("declared"), (F.col("status") != "dismissed").alias("live"))


def quarantine(notes: DataFrame, items: DataFrame, edge_types: DataFrame) -> DataFrame:
    """Rejected notes with a reason (G2): an unknown edge type, or an item id that an accepted earlier note or the note itself already used.

    Acceptance depends on order only among notes that share an id; those are found by an aggregation, and each connected
    set of them is scanned in order. Other notes are judged by joins. items: note_id, id, type (null: untyped).
    """
    typed = items.filter("type is not null").join(edge_types.select("type"), "type", "left_anti").select("note_id").distinct().withColumn("reason", F.lit("unknown_edge_type"))
    twice = items.groupBy("note_id", "id").count().filter("count > 1").select("note_id").distinct().withColumn("reason", F.lit("duplicate_id"))
    bad = typed.unionByName(twice).groupBy("note_id").agg(F.max("reason").alias("reason"))
    rest = items.join(bad, "note_id", "left_anti")
    shared = rest.groupBy("id").agg(F.count_distinct("note_id").alias("n")).filter("n > 1").select("id")
    conflict = rest.join(shared, "id", "left_semi").join(notes.select(F.col("id").alias("note_id"), "created"), "note_id").select("note_id", "id", "created").distinct()
    # rounds: a note is accepted when it is first for each of its shared ids; the others with an id of it are rejected
    open_, rejected = materialize(conflict, "quarantine"), []
    while not open_.isEmpty():
        first = open_.groupBy("id").agg(F.min(F.struct("created", "note_id")).alias("f"))
        marked = open_.join(first, "id").withColumn("is_first", F.col("note_id") == F.col("f.note_id"))
        accepted = materialize(marked.groupBy("note_id").agg(F.bool_and("is_first").alias("ok")).filter("ok").select("note_id"), "quarantine")
        used = open_.join(accepted, "note_id", "left_semi").select("id").distinct()
        out = materialize(open_.join(accepted, "note_id", "left_anti").join(used, "id", "left_semi").select("note_id").distinct(), "quarantine")
        rejected.append(out)
        open_ = materialize(open_.join(accepted, "note_id", "left_anti").join(out, "note_id", "left_anti"), "quarantine")
    for r in rejected:
        bad = bad.unionByName(r.withColumn("reason", F.lit("duplicate_id")))
    return bad
