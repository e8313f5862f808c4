"""Queries of the commands in bulk, over requests made of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import commands, graph
from cairn.plans.common import Registry, table
from cairn.plans.vault import EDGE_TYPES, GRAPH_SQL, folded

R = Registry()
_SLUG = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')"
_KNOWN = "(" + ", ".join(f"'{t}'" for t, _, _ in EDGE_TYPES) + ")"


@R.add("resolve_assertion", f"WITH {GRAPH_SQL} SELECT seq, assertion AS id, CASE WHEN lower(trim(action)) = 'confirm' THEN 'needs_a_person' WHEN action IS NULL OR lower(trim(action)) NOT IN ('dismiss', 'reopen') THEN 'bad_action' WHEN assertion IS NULL OR assertion NOT IN (SELECT id FROM fa UNION ALL SELECT id FROM fc) THEN 'no_such_item' END AS refusal FROM decisions")
def resolve_assertion(spark: SparkSession, d: str) -> DataFrame:
    """Which rows of the decision log an assistant might have written."""
    g, _ = folded(spark, d, write=True)
    asked = table(spark, d, "decisions").select("seq", F.col("assertion").alias("id"), F.lower(F.trim("action")).alias("action"))
    return commands.resolve(asked, g.assertions.select("id").union(g.claims.select("id"))).select("seq", "id", "refusal")


@R.add("merge_entities", f"""WITH {GRAPH_SQL}, r AS (SELECT {_SLUG.format('base')} AS duplicate, {_SLUG.format('superset')} AS canonical FROM near_duplicates), k AS (SELECT slug FROM en UNION SELECT duplicate FROM m1)
SELECT r.duplicate, r.canonical, CASE WHEN coalesce(r.duplicate, '') = '' OR coalesce(r.canonical, '') = '' THEN 'empty_slug' WHEN r.duplicate = r.canonical THEN 'same_entity' WHEN r.duplicate NOT IN (SELECT slug FROM k) OR r.canonical NOT IN (SELECT slug FROM k) THEN 'no_such_entity' WHEN m1.canonical = r.duplicate THEN 'cycle' END AS refusal FROM r LEFT JOIN m1 ON m1.duplicate = r.canonical""")
def merge_entities(spark: SparkSession, d: str) -> DataFrame:
    """Near-duplicate findings as requests to merge."""
    g, v = folded(spark, d, write=True)
    asked = table(spark, d, "near_duplicates").select(F.col("base").alias("duplicate"), F.col("superset").alias("canonical"))
    return commands.merge(asked, g.entities, v["merges"])


@R.add("retire_entity", f"""WITH {GRAPH_SQL}, l AS (SELECT slug, count(*) AS n FROM (SELECT source AS slug, status FROM fa UNION ALL SELECT target, status FROM fa WHERE target <> source UNION ALL SELECT subject, status FROM fc) WHERE status <> 'dismissed' GROUP BY 1)
SELECT e.slug, coalesce(l.n, 0) AS blockers, CASE WHEN e.slug NOT IN (SELECT slug FROM en) THEN 'no_such_entity' WHEN l.n > 0 THEN 'live_items' END AS refusal FROM entities e LEFT JOIN l ON l.slug = e.slug""")
def retire_entity(spark: SparkSession, d: str) -> DataFrame:
    """Which entities could be retired, and how many live items stand against it."""
    g, _ = folded(spark, d, write=True)
    ends = graph.undirected(g.assertions).select("slug", "status").unionByName(g.claims.select(F.col("subject").alias("slug"), "status"))
    live = ends.filter("status <> 'dismissed'").groupBy("slug").agg(F.count("*").alias("n"))
    return commands.retire(table(spark, d, "entities").select("slug"), g.entities, live).select("slug", "blockers", "refusal")


@R.add("propose_relationship", f"""SELECT id, coalesce({_SLUG.format('source')}, '') AS source, coalesce({_SLUG.format('target')}, '') AS target, CASE WHEN type IN {_KNOWN} THEN type END AS type, CASE WHEN type NOT IN {_KNOWN} THEN type END AS proposed_type,
CASE WHEN coalesce(strength, 5) NOT BETWEEN 1 AND 10 THEN 'bad_strength' WHEN description IS NULL OR regexp_full_match(description, '\\s*') THEN 'no_rationale' WHEN coalesce({_SLUG.format('source')}, '') = '' OR coalesce({_SLUG.format('target')}, '') = '' THEN 'empty_slug' WHEN {_SLUG.format('source')} = {_SLUG.format('target')} THEN 'same_entity' END AS refusal FROM assertions""")
def propose_relationship(spark: SparkSession, d: str) -> DataFrame:
    """Every delivered relationship as a proposal."""
    asked = table(spark, d, "assertions").select("id", "source", "target", "type", "description", "strength")
    return commands.propose(asked, [t for t, _, _ in EDGE_TYPES]).select("id", "source", "target", "type", "proposed_type", "refusal")


@R.add("save_capture", """WITH t AS (SELECT doc_id AS id, text, 'sha256:' || sha256(text) AS hash FROM documents), c AS (SELECT 'sha256:' || sha256(text) AS hash FROM documents WHERE kind = 'capture' AND text IS NOT NULL),
f AS (SELECT hash, min(id) AS first FROM t WHERE hash IS NOT NULL GROUP BY 1)
SELECT t.id, CASE WHEN text IS NULL OR regexp_full_match(text, '[ \\t\\n\\r\\f\\x0B]*') THEN 'empty' WHEN t.hash IN (SELECT hash FROM c) THEN 'captured' WHEN t.id > f.first THEN 'repeated' END AS refusal FROM t LEFT JOIN f ON f.hash = t.hash""".replace("\\\\", "\\"))
def save_capture(spark: SparkSession, d: str) -> DataFrame:
    """Every text as a new capture beside those that are captured."""
    o = table(spark, d, "documents")
    captured = o.filter("kind = 'capture' and text is not null").select(F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("hash"))
    return commands.capture(o.select(F.col("doc_id").alias("id"), "text"), captured).select("id", "refusal")
