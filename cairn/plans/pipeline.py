"""Queries of ingestion, units, validation, clustering, review views and streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import scalars as S
from cairn.operators import changefeed, cluster, fold, graph, logfolds, references, search, units, validate
from cairn.plans.common import Registry, table
from cairn.plans.vault import ENTITY_TYPES, GRAPH_SQL, QUERY, evidence_hashes, folded, vault
from cairn.session import global_index, materialize, new_path
from cairn.sources import parsers
from cairn.streaming import logs as stream_logs

R = Registry()


@R.add("S20_paragraphs", r"WITH p AS (SELECT doc_id, list_filter(string_split_regex(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n[ \t\n\r\f\x0B]*\n'), lambda x: regexp_matches(x, '[^ \t\n\r\f\x0B]')) AS l FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(l) AS n, CAST(list_sum(list_transform(l, lambda x: length(trim(x, chr(10))))) AS BIGINT) AS chars FROM p WHERE len(l) > 0")
def s20(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of plain texts: how many, and their length without line ends around them."""
    text = F.regexp_replace(F.regexp_replace("text", "\r\n", "\n"), "\r", "\n")
    parts = F.filter(F.split(text, r"\n[ \t\n\r\f\x0B]*\n"), lambda x: x.rlike(r"[^ \t\n\r\f\x0B]"))
    p = table(spark, d, "documents").filter("text is not null").select("doc_id", parts.alias("l")).filter(F.size("l") > 0)
    return p.select("doc_id", F.size("l").cast("long").alias("n"), F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + F.length(F.regexp_replace(x, r"^\n+|\n+\z", ""))).alias("chars"))


@R.add("S22_fingerprints", "SELECT doc_id, sha256(text) AS sha256, strlen(text) AS size FROM documents WHERE text IS NOT NULL")
def s22(spark: SparkSession, d: str) -> DataFrame:
    """Content hash and size in bytes of every text."""
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"))


@R.add("S19_markdown_blocks")
def s19(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of every document read as Markdown: doc_id, kind, n."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(i, b["kind"]) for i, t in zip(pdf["doc_id"], pdf["text"], strict=True) for b in parsers.parse_markdown(t.encode())[2]]
            yield pd.DataFrame(rows, columns=["doc_id", "kind"])

    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", "text")
    return docs.mapInPandas(run, "doc_id long, kind string").groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@R.add("F13_rendered", """WITH b AS (SELECT *, last_value(locator IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ordinal, kind, text, level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM blocks WHERE doc_id IS NOT NULL),
p AS (SELECT doc_id, length(coalesce(text, '')) + CASE kind WHEN 'heading' THEN 1 + CASE WHEN coalesce(level, 0) = 0 THEN 1 ELSE level END WHEN 'list_item' THEN 2 WHEN 'code' THEN 8 ELSE 0 END
  + CASE WHEN locator.kind IN ('page', 'slide', 'sheet', 'line') AND locator IS DISTINCT FROM before THEN length('## ' || locator.kind || ' ' || locator.label) + 2 ELSE 0 END AS n FROM b)
SELECT doc_id, CAST(sum(n) + 2 * (count(*) - 1) AS BIGINT) AS n_chars FROM p GROUP BY doc_id""")
def f13(spark: SparkSession, d: str) -> DataFrame:
    """Length of the rendering of each document's blocks, with the headings of their places."""
    b = table(spark, d, "blocks").filter("doc_id is not null")
    docs = b.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "kind", "text", "level", "locator"))).alias("b"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_chars": [len(parsers.to_markdown([parsers.from_row(y) for y in x])) - 1 for x in pdf["b"]]})

    return docs.mapInPandas(run, "doc_id long, n_chars long")


@R.add("C1_block_units")
def c1(spark: SparkSession, d: str) -> DataFrame:
    """Text units of the parsed documents."""
    return units.block_units(table(spark, d, "blocks"))


@R.add("C4_text_units")
def c4(spark: SparkSession, d: str) -> DataFrame:
    """Text units of every plain text."""
    return units.text_units(table(spark, d, "documents"), "doc_id", "text")


@R.add("C5_unit_locators", r"WITH b AS (SELECT doc_id, text, length(text) // 2 AS mid FROM documents WHERE text IS NOT NULL AND contains(text, '## ')) SELECT doc_id, nullif(CASE WHEN regexp_matches(substr(text, mid + 1), '^\s*## (?:Page|Slide|Sheet|Line) [^\n]+') THEN regexp_extract(substr(text, mid + 1), '^\s*## ((?:Page|Slide|Sheet|Line) [^\n]+?)[ \t]*(?:\n|$)', 1) ELSE list_last(regexp_extract_all(substr(text, 1, mid), '(?m)^## ((?:Page|Slide|Sheet|Line) .+?)\s*$', 1)) END, '') AS locator FROM b")
def c5(spark: SparkSession, d: str) -> DataFrame:
    """The locator of a unit that begins in the middle of each document with headings."""
    b = table(spark, d, "documents").filter("text is not null and contains(text, '## ')").withColumn("at", F.expr("length(text) div 2").cast("int"))
    return b.select("doc_id", units.unit_locator(F.col("text"), F.col("at")).alias("locator"))


@R.add("W5_unit_order", "SELECT id, capture_id, row_number() OVER (PARTITION BY capture_id ORDER BY ordinal NULLS FIRST, id) - 1 AS place FROM (SELECT DISTINCT id, capture_id, ordinal FROM text_units)")
def w5(spark: SparkSession, d: str) -> DataFrame:
    """Place of each unit in its capture."""
    u = table(spark, d, "text_units").select("id", "capture_id", "ordinal").distinct()
    return u.select("id", "capture_id", (F.row_number().over(Window.partitionBy("capture_id").orderBy(F.asc_nulls_first("ordinal"), "id")) - 1).cast("long").alias("place"))


_SLUG = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')"


@R.add("V2_relationships", f"""WITH {GRAPH_SQL}, u AS (SELECT capture_id, list(DISTINCT id) AS allowed FROM text_units WHERE capture_id IS NOT NULL GROUP BY 1),
j AS (SELECT a.id, CASE WHEN source IS NULL OR trim(source) = '' OR target IS NULL OR trim(target) = '' THEN 'missing_field' WHEN coalesce(strength, 5) NOT BETWEEN 1 AND 10 THEN 'bad_strength'
  WHEN {_SLUG.format('source')} = '' OR {_SLUG.format('target')} = '' THEN 'empty_slug' WHEN {_SLUG.format('source')} = {_SLUG.format('target')} THEN 'self_loop'
  WHEN len(list_filter(a.units, lambda x: NOT list_contains(coalesce(u.allowed, []), x))) > 0 THEN 'unknown_text_unit' END AS reason FROM a0 a LEFT JOIN n0 ON n0.id = a.note_id LEFT JOIN u ON u.capture_id = n0.derived_from)
SELECT 'relationship' AS kind, reason, count(*) AS n, min(id) AS example FROM j WHERE reason IS NOT NULL GROUP BY reason""")
def v2(spark: SparkSession, d: str) -> DataFrame:
    """Drops of the relationship rules by reason; units must belong to the note's own capture (V4)."""
    v = vault(spark, d)
    own = table(spark, d, "text_units").filter("capture_id is not null").select(F.col("id").alias("unit"), "capture_id").distinct()
    notes = v["notes"].select(F.col("id").alias("note_id"), F.col("derived_from").alias("capture_id"))
    cited = v["assertions"].select("id", "note_id", F.explode("text_unit_ids").alias("unit")).join(notes, "note_id", "left").select("id", "unit", "capture_id")
    foreign = references.orphans(cited, own, {"unit": "unit", "capture_id": "capture_id"}, "full").select("id").distinct().withColumn("foreign", F.lit(True))
    return validate.ledger(validate.relationships(v["assertions"].join(foreign, "id", "left")), "relationship")[1]


_VALID = r"(regexp_full_match({0}, '\d{{4}}') OR (regexp_full_match({0}, '\d{{4}}-\d{{2}}') AND {0}[6:7] BETWEEN '01' AND '12') OR (regexp_full_match({0}, '\d{{4}}-\d{{2}}-\d{{2}}') AND TRY_CAST({0} AS DATE) IS NOT NULL))"


@R.add("V3_claims", f"""WITH {GRAPH_SQL}, j AS (SELECT id, CASE WHEN subject IS NULL OR text IS NULL THEN 'missing_field' WHEN trim(text) = '' THEN 'empty_text' WHEN {_SLUG.format('subject')} = '' THEN 'empty_slug'
  WHEN valid_from IS NOT NULL AND NOT {_VALID.format('valid_from')} THEN 'bad_validity' WHEN valid_to IS NOT NULL AND valid_to <> 'unknown' AND NOT {_VALID.format('valid_to')} THEN 'bad_validity'
  WHEN valid_to <> 'unknown' AND valid_from[:least(length(valid_from), length(valid_to))] > valid_to[:least(length(valid_from), length(valid_to))] THEN 'bad_validity'
  WHEN supersedes IS NOT NULL AND supersedes NOT IN (SELECT id FROM claims) THEN 'unknown_supersedes' END AS reason FROM c0)
SELECT 'claim' AS kind, reason, count(*) AS n, min(id) AS example FROM j WHERE reason IS NOT NULL GROUP BY reason""")
def v3(spark: SparkSession, d: str) -> DataFrame:
    """Drops of the claim rules by reason."""
    v = vault(spark, d)
    return validate.ledger(validate.claims(v["claims"], table(spark, d, "claims")), "claim")[1]


@R.add("V1_entities", f"WITH j AS (SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN title IS NULL OR trim(title) = '' THEN 'missing_field' WHEN len(string_split_regex(trim(title), '\\s+')) > 6 THEN 'not_an_entity_name' WHEN {_SLUG.format('title')} = '' THEN 'empty_slug' END AS reason FROM documents) SELECT 'entity' AS kind, reason, count(*) AS n, min(id) AS example FROM j WHERE reason IS NOT NULL GROUP BY reason")
def v1(spark: SparkSession, d: str) -> DataFrame:
    """Drops of the entity rules, with titles as names."""
    none = F.lit(None).cast("array<string>")
    items = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("title").alias("name"), F.lit(None).cast("string").alias("type"), none.alias("text_unit_ids"), none.alias("allowed"))
    return validate.ledger(validate.entities(items, ENTITY_TYPES), "entity")[1]


@R.add("G2_quarantine")
def g2(spark: SparkSession, d: str) -> DataFrame:
    """Notes that reuse a relationship's or a claim's id of an earlier note, on the raw deliveries; an iterative fold, held against a sequential model in the tests."""
    v = vault(spark, d)
    items = table(spark, d, "assertions").select(F.trim("note_id").alias("note_id"), F.concat(F.lit("relationship "), "id").alias("id"), "type").distinct()
    items = items.unionByName(table(spark, d, "claims").select(F.trim("note_id").alias("note_id"), F.concat(F.lit("claim "), "id").alias("id"), F.lit(None).cast("string").alias("type")).distinct())
    return fold.quarantine(v["notes"], items.join(v["notes"].select(F.col("id").alias("note_id")), "note_id", "left_semi"), v["edge_types"])


def _clustered(spark: SparkSession, d: str, seed: int = 42) -> tuple[DataFrame, fold.Graph, dict[str, DataFrame]]:
    g, v = folded(spark, d, write=True)
    return cluster.communities(graph.cluster_graph(g.aggregates, v["edge_types"]), seed=seed), g, v


@R.add("G9_communities")
def g9(spark: SparkSession, d: str) -> DataFrame:
    """Hierarchical communities of the confirmed graph."""
    return _clustered(spark, d)[0]


@R.add("G10_lineages")
def g10(spark: SparkSession, d: str) -> DataFrame:
    """Communities of one run matched to those of another."""
    fresh = materialize(_clustered(spark, d)[0], "fresh")
    previous = materialize(_clustered(spark, d, seed=7)[0], "previous")
    return graph.match_lineages(fresh, previous)


@R.add("A20_community_hashes")
def a20(spark: SparkSession, d: str) -> DataFrame:
    """Evidence hash of each community."""
    found, g, v = _clustered(spark, d)
    return cluster.community_hashes(found, evidence_hashes(g, v["notes"]))


@R.add("R5_global_search")
def r5(spark: SparkSession, d: str) -> DataFrame:
    """Community reports by relevance; small communities have none, and every third is stale."""
    found = materialize(_clustered(spark, d)[0], "found")
    c = found.select(F.col("id").alias("lineage_id"), "level", "members")
    title = F.array_join(F.slice(F.array_sort("members"), 1, 3), " ")
    reports = c.filter(F.size("members") > 2).select("lineage_id", F.regexp_replace(title, "-", " ").alias("title"), F.array_join("members", " ").alias("summary"), F.size("members").cast("double").alias("rank"), (F.pmod(F.crc32("lineage_id"), F.lit(3)) == 0).alias("stale"))
    return search.global_search(reports, c.select("lineage_id"), QUERY + " reading room")


@R.add("J17_community_overlap", """WITH f AS (SELECT 'f' || coalesce(type, '?') AS id, 0 AS level, slug FROM entities), p AS (SELECT 'p' || (rank % 5) AS id, 0 AS level, slug FROM entities WHERE rank IS NOT NULL),
x AS (SELECT f.id AS fresh, p.id AS previous, count(*) AS c FROM f JOIN p ON f.slug = p.slug GROUP BY 1, 2)
SELECT 0 AS level, fresh, previous, round(c / ((SELECT count(*) FROM f WHERE f.id = fresh) + (SELECT count(*) FROM p WHERE p.id = previous) - c), 9) AS score FROM x""")
def j17(spark: SparkSession, d: str) -> DataFrame:
    """Jaccard index of two groupings of the entities, by type and by rank."""
    e = table(spark, d, "entities")
    group = lambda df, i: df.select(F.lit(0).alias("level"), i.alias("id"), F.col("slug").alias("m"))
    f = group(e, F.concat(F.lit("f"), F.coalesce("type", F.lit("?"))))
    p = group(e.filter("rank is not null"), F.concat(F.lit("p"), F.col("rank") % 5))
    return graph.overlaps(f, p).withColumn("score", F.round("score", 9))


@R.add("J20_dismissed_pairs", f"""WITH {GRAPH_SQL}, log AS (SELECT seq, assertion, lower(trim(action)) AS action, reason FROM decisions),
l AS (SELECT * FROM log WHERE action IN ('confirm', 'dismiss', 'reopen') QUALIFY row_number() OVER (PARTITION BY assertion ORDER BY seq DESC) = 1)
SELECT fa.id, fa.source, fa.target, coalesce(l.reason, '') AS reason FROM l JOIN fa ON fa.id = l.assertion WHERE l.action = 'dismiss'""")
def j20(spark: SparkSession, d: str) -> DataFrame:
    """Dismissed relationships with their reasons, as context for an extractor."""
    g, v = folded(spark, d)
    why = logfolds.dismissal_reasons(v["decisions"]).withColumnRenamed("assertion", "id")
    return g.assertions.select("id", "source", "target").join(why, "id")


@R.add("P13_live_edges", f"WITH {GRAPH_SQL} SELECT ag.key, bool_or(fa.status <> 'dismissed') AS live, bool_or(fa.status = 'proposed') AS pending, max(CASE WHEN fa.status = 'proposed' THEN fa.strength END) AS strongest_pending FROM ag JOIN fa ON list_contains(ag.assertion_ids, fa.id) GROUP BY 1")
def p13(spark: SparkSession, d: str) -> DataFrame:
    """Whether an edge is live and waits for review, and its strongest proposal."""
    g, _ = folded(spark, d)
    m = g.members.join(g.assertions.select("id", "status", "strength"), "id")
    pend = F.col("status") == "proposed"
    return m.groupBy("key").agg(F.bool_or(F.col("status") != "dismissed").alias("live"), F.bool_or(pend).alias("pending"), F.max(F.when(pend, F.col("strength"))).alias("strongest_pending"))


@R.add("G21_entity_edges", f"""WITH {GRAPH_SQL}, top AS (SELECT slug FROM dg ORDER BY rank DESC, slug LIMIT 1) SELECT id, CASE WHEN type IS NULL THEN 'untyped' WHEN status = 'confirmed' THEN 'confirmed' ELSE 'proposed' END AS section, CASE WHEN source = slug THEN target ELSE source END AS other
FROM fa, top WHERE status <> 'dismissed' AND (source = slug OR target = slug)""")
def g21(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the entity of highest rank by section."""
    g, _ = folded(spark, d)
    top = fold.degree(g.aggregates).orderBy(F.desc("rank"), "slug").limit(1).select("slug")
    section = F.when(F.col("type").isNull(), "untyped").when(F.col("status") == "confirmed", "confirmed").otherwise("proposed")
    return graph.undirected(g.assertions.filter("status <> 'dismissed'")).join(F.broadcast(top), "slug").select("id", section.alias("section"), "other")  # one row


@R.add("G22_structure_signature", f"WITH {GRAPH_SQL}, b AS (SELECT substr(md5(key), 1, 4) AS bucket, sha256(string_agg(key, chr(10) ORDER BY key)) AS h FROM ag WHERE traversable GROUP BY 1) SELECT sha256(string_agg(h, chr(10) ORDER BY bucket)) AS signature FROM b")
def g22(spark: SparkSession, d: str) -> DataFrame:
    """One hash of the drawn structure, which tells whether nodes or edges changed: a tree of two levels, as no task sees all keys."""
    g, _ = folded(spark, d)
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*c))), lambda x: x[c[-1]]), "\n")
    low = g.aggregates.filter("traversable").groupBy(F.substring(F.md5("key"), 1, 4).alias("bucket")).agg(F.sha2(ordered(["key"]), 256).alias("h"))
    return low.agg(F.sha2(ordered(["bucket", "h"]), 256).alias("signature"))


@R.add("W7_next_in_queue", f"WITH {GRAPH_SQL}, q AS (SELECT id, row_number() OVER (ORDER BY strength DESC NULLS LAST, id) AS place FROM fa WHERE status = 'proposed') SELECT id, coalesce(lead(id) OVER (ORDER BY place), first_value(id) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next_id FROM q")
def w7(spark: SparkSession, d: str) -> DataFrame:
    """The item after each one of the whole queue, the first again after the last."""
    g, _ = folded(spark, d)
    pending = materialize(g.assertions.filter("status = 'proposed'").select("id", "strength"), "queue")
    q = global_index(pending, [F.desc_nulls_last("strength"), "id"], "queue")
    n = pending.agg(F.count("*").alias("n"))  # one row
    after = q.join(n).select(F.col("id").alias("next_id"), F.pmod(F.col("row_index") - 1, F.col("n")).alias("row_index"))
    return q.join(after, "row_index").select("id", "next_id")


@R.add("R6_entity", f"""WITH {GRAPH_SQL}, q AS (SELECT slug, '1950-06-15' AS day FROM dg ORDER BY rank DESC, slug LIMIT 1)
SELECT en.slug, en.type, en.rank, (SELECT count(*) FROM fc, q WHERE fc.subject = q.slug AND (valid_from IS NULL OR valid_from[:least(length(valid_from), 10)] <= day[:least(length(valid_from), 10)]) AND (valid_to IS NULL OR valid_to = 'unknown' OR day[:least(length(valid_to), 10)] <= valid_to[:least(length(valid_to), 10)])) AS claims,
(SELECT count(DISTINCT CASE WHEN source = q.slug THEN target ELSE source END) FROM ag, q WHERE traversable AND (source = q.slug OR target = q.slug) AND source <> target) AS neighbours FROM en JOIN q ON q.slug = en.slug""")
def r6(spark: SparkSession, d: str) -> DataFrame:
    """One entity with its claims as of a day and its neighbours, counted."""
    g, _ = folded(spark, d, write=True)
    edges = g.aggregates
    top = fold.degree(edges).orderBy(F.desc("rank"), "slug").limit(1).select("slug")
    c = g.claims.filter(S.holds_at(F.col("valid_from"), F.col("valid_to"), "1950-06-15")).select(F.col("subject").alias("slug")).join(F.broadcast(top), "slug").groupBy("slug").agg(F.count("*").alias("claims"))
    n = graph.neighbours(edges, top, 1).agg(F.count("*").alias("neighbours"))  # one row
    return g.entities.join(F.broadcast(top), "slug").join(c, "slug", "left").join(n).select("slug", "type", "rank", F.coalesce("claims", F.lit(0)).alias("claims"), "neighbours")


@R.add("F20_validity_text", f"WITH {GRAPH_SQL} SELECT id, CASE WHEN valid_from IS NULL AND valid_to IS NULL THEN '' WHEN valid_to IS NULL THEN 'since ' || valid_from ELSE (CASE WHEN valid_from IS NULL THEN 'until ' ELSE valid_from || ' to ' END) || CASE WHEN valid_to = 'unknown' THEN 'an unknown date' ELSE valid_to END END AS validity FROM fc")
def f20(spark: SparkSession, d: str) -> DataFrame:
    """Validity of claims in words."""
    return folded(spark, d)[0].claims.select("id", S.validity_text(F.col("valid_from"), F.col("valid_to")).alias("validity"))


@R.add("F19_radius", "SELECT slug, round(least(18.0, 4.0 + 2.0 * sqrt(greatest(0.0, CAST(rank AS DOUBLE)))), 6) AS radius FROM entities WHERE rank IS NOT NULL")
def f19(spark: SparkSession, d: str) -> DataFrame:
    """Radius of each entity's mark."""
    return table(spark, d, "entities").filter("rank is not null").select("slug", F.round(S.radius(F.col("rank")), 6).alias("radius"))


@R.add("T1_stream_fold", """WITH ev AS (SELECT op, min(seq) AS place, arg_min(assertion, seq) AS assertion, arg_min(lower(trim(action)), seq) AS action FROM decisions GROUP BY 1)
SELECT assertion, arg_max(action, place) AS action, arg_max(op, place) AS op FROM ev WHERE action IN ('confirm', 'dismiss', 'reopen') GROUP BY 1 HAVING arg_max(action, place) <> 'reopen'""")
def t1(spark: SparkSession, d: str) -> DataFrame:
    """The decision log as a file stream, folded by place in the log, drained to its end."""
    root = new_path(spark, "stream")
    stream_logs.start(spark, f"{d}/decisions.parquet", root, f"{root}-progress", once=True).awaitTermination()
    state = changefeed.ChangeTable(spark, root).state()
    return state.filter("is_head and not is_deleted").select(F.col("key").alias("assertion"), "action", "op")


@R.add("T_windowed_counts", "SELECT CAST(time_bucket(INTERVAL 5 MINUTE, ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def t_windowed(spark: SparkSession, d: str) -> DataFrame:
    """Events per type and five minutes: the batch form of the streaming aggregation."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return stream_logs.windowed_counts(e).withColumn("total", F.round("total", 6))
