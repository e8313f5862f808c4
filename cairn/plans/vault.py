"""Queries over the vault's tables: log folds, the graph fold, walks, lints, search, and the SQL that says the same."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import scalars as S
from cairn.operators import fold as fold_
from cairn.operators import graph, logfolds, search
from cairn.plans.common import Registry, table
from cairn.session import global_index, materialize

R = Registry()

#: The queries' configuration: edge types with their symmetry and cluster weight, entity types, adopted wordings.
EDGE_TYPES = [("supports", False, 1.0), ("contradicts", True, 1.0), ("cites", False, 1.0), ("mentions", False, 0.5), ("part_of", False, 1.0), ("located_in", False, 1.0), ("uses|tool", False, 1.0), ("relates_to", True, 0.0)]
ENTITY_TYPES = ["paper", "place", "tool", "concept", "person", "organisation"]
ADOPTED = [("edge", "near-to", "relates_to"), ("edge", "kind-of", "part_of")]
QUERY = "the sluice gate and the quiet review queue"

_EDGES = "et(type, sym, cw) AS (VALUES " + ", ".join(f"('{t}', {str(s).lower()}, {w})" for t, s, w in EDGE_TYPES) + ")"
_ADOPTED = "ad(kind, proposed, adopted) AS (VALUES " + ", ".join(f"('{k}', '{p}', '{a}')" for k, p, a in ADOPTED) + ")"
_TYPES = "(" + ", ".join(f"'{t}'" for t in ENTITY_TYPES) + ")"

#: The folded graph in SQL; the views mirror ``vault`` and ``folded`` below.
GRAPH_SQL = f"""
{_EDGES}, {_ADOPTED},
n0 AS (SELECT * FROM notes QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrived_at, created NULLS FIRST, body NULLS FIRST) = 1),
a0 AS (SELECT id, trim(note_id) AS note_id, source, target, type, strength, description, proposed_type,
    coalesce(list_sort(list_distinct(list_filter(list_transform(text_unit_ids, lambda x: trim(x)), lambda x: x <> ''))), []) AS units
  FROM assertions QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrived_at, note_id) = 1),
c0 AS (SELECT id, trim(note_id) AS note_id, subject, text, valid_from, valid_to, nullif(trim(supersedes), '') AS supersedes
  FROM claims QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrived_at, note_id, text NULLS FIRST) = 1),
inst AS (SELECT DISTINCT e.slug, trim(s.note_id) AS note_id, e.type FROM entity_sources s JOIN entities e ON e.slug = s.slug),
st AS (SELECT assertion AS id, arg_max(action, seq) AS action FROM (SELECT assertion, lower(trim(action)) AS action, seq FROM decisions) WHERE action IN ('confirm', 'dismiss', 'reopen') GROUP BY 1),
mg AS (SELECT dup AS duplicate, min(slug) AS canonical FROM (SELECT lower(trim(unnest(merged_from))) AS dup, slug FROM entities) WHERE dup <> '' AND dup <> slug GROUP BY 1),
m1 AS (SELECT duplicate, canonical FROM mg WHERE canonical NOT IN (SELECT duplicate FROM mg)),
fa AS (SELECT a.id, a.note_id, coalesce(ms.canonical, a.source) AS source, coalesce(mt.canonical, a.target) AS target, a.source AS raw_source, a.target AS raw_target,
    coalesce(a.type, ad.adopted) AS type, a.strength, a.description, a.proposed_type, a.units,
    CASE st.action WHEN 'confirm' THEN 'confirmed' WHEN 'dismiss' THEN 'dismissed' ELSE 'proposed' END AS status
  FROM a0 a SEMI JOIN n0 ON n0.id = a.note_id LEFT JOIN st ON st.id = a.id
    LEFT JOIN ad ON a.type IS NULL AND ad.proposed = trim(regexp_replace(lower(a.proposed_type), '[^a-z0-9]+', '-', 'g'), '-')
    LEFT JOIN m1 ms ON ms.duplicate = a.source LEFT JOIN m1 mt ON mt.duplicate = a.target),
ag AS (SELECT 'r:' || source || '|' || type || '|' || target AS key, source, type, target, weight, mean_strength, assertion_ids, weight > 0 AS traversable FROM (
    SELECT CASE WHEN sym THEN least(source, target) ELSE source END AS source, fa.type, CASE WHEN sym THEN greatest(source, target) ELSE target END AS target,
      count(*) FILTER (status = 'confirmed') AS weight, coalesce(avg(strength) FILTER (status = 'confirmed'), 0.0) AS mean_strength, list_sort(list(fa.id)) AS assertion_ids
    FROM fa JOIN et ON et.type = fa.type GROUP BY 1, 2, 3)),
dg AS (SELECT slug, count(*) AS rank FROM (SELECT source AS slug FROM ag WHERE traversable UNION ALL SELECT target FROM ag WHERE traversable) GROUP BY 1),
fc0 AS (SELECT c.*, CASE st.action WHEN 'confirm' THEN 'confirmed' WHEN 'dismiss' THEN 'dismissed' ELSE 'proposed' END AS before FROM c0 c SEMI JOIN n0 ON n0.id = c.note_id LEFT JOIN st ON st.id = c.id),
fc AS (SELECT f.id, f.note_id, coalesce(m.canonical, f.subject) AS subject, f.subject AS raw_subject, f.text, f.valid_from, f.valid_to, f.supersedes, f.before,
    CASE WHEN f.id IN (SELECT supersedes FROM fc0 WHERE before = 'confirmed' AND supersedes IS NOT NULL) THEN 'superseded' ELSE f.before END AS status
  FROM fc0 f LEFT JOIN m1 m ON m.duplicate = f.subject),
tc0 AS (
  SELECT note_id, slug, type, CAST([] AS VARCHAR[]) AS units, true AS declared, false AS live FROM inst
  UNION ALL SELECT note_id, raw_source, NULL, units, false, status <> 'dismissed' FROM fa
  UNION ALL SELECT note_id, raw_target, NULL, units, false, status <> 'dismissed' FROM fa
  UNION ALL SELECT note_id, raw_subject, NULL, [], false, before <> 'dismissed' FROM fc),
tc AS (SELECT t.*, coalesce(m.canonical, t.slug) AS canon, n0.created FROM tc0 t JOIN n0 ON n0.id = t.note_id LEFT JOIN m1 m ON m.duplicate = t.slug),
rt AS (SELECT DISTINCT coalesce(m.canonical, e.slug) AS slug FROM entities e LEFT JOIN m1 m ON m.duplicate = e.slug WHERE e.type IS NULL AND e.rank = 0),
en0 AS (SELECT canon AS slug, arg_max(type, {{'created': created, 'note_id': note_id, 'slug': slug}}) FILTER (type IN {_TYPES}) AS type,
    list_sort(list(DISTINCT note_id)) AS note_ids, list_sort(list(DISTINCT slug) FILTER (slug <> canon)) AS merged_from,
    list_sort(list_distinct(flatten(list(units)))) AS text_unit_ids, bool_or(declared) AS declared, bool_or(live) AS live
  FROM tc GROUP BY 1),
en AS (SELECT e.slug, coalesce(e.type, 'unknown') AS type, coalesce(dg.rank, 0) AS rank, e.note_ids, coalesce(e.merged_from, []) AS merged_from, e.text_unit_ids, e.declared
  FROM en0 e LEFT JOIN dg ON dg.slug = e.slug WHERE e.live OR (e.declared AND e.slug NOT IN (SELECT slug FROM rt)))
"""


def _first(df: DataFrame, *order: str) -> DataFrame:
    """The first delivery of each id."""
    w = Window.partitionBy("id").orderBy(*(F.asc_nulls_first(c) for c in order))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def vault(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Typed source tables: one row for each id, references trimmed, and the logs."""
    t = lambda n: table(spark, d, n)
    units = F.array_sort(F.array_distinct(F.filter(F.transform("text_unit_ids", lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))))
    a = _first(t("assertions"), "arrived_at", "note_id").withColumns({"note_id": F.trim("note_id"), "text_unit_ids": F.coalesce(units, F.array().cast("array<string>"))})
    c = _first(t("claims"), "arrived_at", "note_id", "text").withColumns({"note_id": F.trim("note_id"), "supersedes": F.nullif(F.trim("supersedes"), F.lit(""))})
    entities = t("entities")
    inst = t("entity_sources").select("slug", F.trim("note_id").alias("note_id")).join(entities.select("slug", "type"), "slug").distinct().withColumn("pos", F.lit(0).cast("long"))
    log = t("decisions").select("seq", "assertion", F.lower(F.trim("action")).alias("action"), "reason")
    merged = entities.select("slug", F.explode("merged_from").alias("m")).select(F.lower(F.trim("m")).alias("duplicate"), F.col("slug").alias("canonical")).filter("duplicate <> '' and duplicate <> canonical")
    merged = merged.groupBy("duplicate").agg(F.min("canonical").alias("canonical"))
    ends = merged.select(F.col("duplicate").alias("canonical"))
    return {
        "notes": _first(t("notes"), "arrived_at", "created", "body"),
        "assertions": a,
        "claims": c,
        "entities": entities,
        "instances": inst,
        "decisions": log,
        "merges": merged.join(ends, "canonical", "left_anti").select("duplicate", "canonical"),
        "retired": entities.filter("type is null and rank = 0").select("slug"),
        "edge_types": spark.createDataFrame(EDGE_TYPES, "type string, symmetric boolean, weight double"),
        "adoptions": spark.createDataFrame(ADOPTED, "kind string, proposed string, adopted string"),
    }


def folded(spark: SparkSession, d: str, write: bool = False) -> tuple[fold_.Graph, dict[str, DataFrame]]:
    v = vault(spark, d)
    inst = v["instances"].join(v["notes"].select(F.col("id").alias("note_id")), "note_id", "left_semi")
    # the order key of an instance ends in its slug, so equal notes decide alike everywhere
    g = fold_.fold(v["notes"], inst.withColumn("pos", F.col("slug")), v["assertions"], v["claims"], logfolds.statuses(v["decisions"]), v["adoptions"], v["merges"], v["retired"], v["edge_types"], ENTITY_TYPES, write)
    return g, v


_LOG = "log AS (SELECT seq, assertion, lower(trim(action)) AS action, reason FROM decisions)"


@R.add("A5_statuses", f"WITH {_LOG} SELECT assertion, arg_max(action, seq) AS action FROM log WHERE action IN ('confirm', 'dismiss', 'reopen') GROUP BY 1")
def a5(spark: SparkSession, d: str) -> DataFrame:
    """Last action of each assertion by place in the log."""
    return logfolds.statuses(vault(spark, d)["decisions"])


@R.add("A6_dismissal_reasons", f"WITH {_LOG}, l AS (SELECT * FROM log WHERE action IN ('confirm', 'dismiss', 'reopen') QUALIFY row_number() OVER (PARTITION BY assertion ORDER BY seq DESC) = 1) SELECT assertion, coalesce(reason, '') AS reason FROM l WHERE action = 'dismiss'")
def a6(spark: SparkSession, d: str) -> DataFrame:
    """Reasons of the dismissals that stand."""
    return logfolds.dismissal_reasons(vault(spark, d)["decisions"])


_RETIRE = "SELECT event_id AS seq, 's' || user_id AS slug, CASE event_type WHEN 'error' THEN 'retire' WHEN 'signup' THEN 'restore' END AS action FROM events"


@R.add("A7_retired", f"WITH log AS ({_RETIRE}) SELECT slug FROM log WHERE action IS NOT NULL GROUP BY 1 HAVING arg_max(action, seq) = 'retire'")
def a7(spark: SparkSession, d: str) -> DataFrame:
    """Slugs that stand retired, over a log made of the events."""
    e = table(spark, d, "events")
    log = e.select(F.col("event_id").alias("seq"), F.concat(F.lit("s"), "user_id").alias("slug"), F.when(F.col("event_type") == "error", "retire").when(F.col("event_type") == "signup", "restore").alias("action"))
    return logfolds.retired(log)


_MERGE = """ev AS (SELECT event_id AS seq, 'd' || user_id AS duplicate, 'd' || (user_id // 2 + event_id % 3) AS canonical,
    CASE event_type WHEN 'purchase' THEN 'merge' WHEN 'error' THEN 'unmerge' WHEN 'signup' THEN 'keep' END AS action FROM events),
mlog AS (SELECT *, least(duplicate, canonical) AS a, greatest(duplicate, canonical) AS b FROM ev WHERE action IS NOT NULL AND duplicate <> canonical),
lm AS (SELECT duplicate, arg_max(canonical, seq) AS canonical, max(seq) AS at FROM mlog WHERE action = 'merge' GROUP BY 1),
mp AS (SELECT l.duplicate, l.canonical FROM lm l WHERE NOT EXISTS (SELECT 1 FROM mlog u WHERE u.action = 'unmerge' AND u.duplicate = l.duplicate AND u.seq > l.at)
    AND NOT EXISTS (SELECT 1 FROM mlog k WHERE k.action = 'keep' AND k.a = least(l.duplicate, l.canonical) AND k.b = greatest(l.duplicate, l.canonical) AND k.seq > l.at))"""


def _merge_log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    action = F.when(F.col("event_type") == "purchase", "merge").when(F.col("event_type") == "error", "unmerge").when(F.col("event_type") == "signup", "keep")
    log = e.select(F.col("event_id").alias("seq"), F.concat(F.lit("d"), "user_id").alias("duplicate"), F.concat(F.lit("d"), F.floor(F.col("user_id") / 2) + F.col("event_id") % 3).alias("canonical"), action.alias("action"))
    return log.filter("action is not null and duplicate <> canonical")


@R.add("A8_merges", f"WITH {_MERGE} SELECT * FROM mp")
def a8(spark: SparkSession, d: str) -> DataFrame:
    """The merge map after merges, unmerges and keeps."""
    return logfolds.merges(_merge_log(spark, d))[0]


@R.add("A8_kept", f"WITH {_MERGE} SELECT a, b FROM mlog WHERE action IN ('merge', 'keep') GROUP BY 1, 2 HAVING arg_max(action, seq) = 'keep'")
def a8_kept(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that are kept apart."""
    return logfolds.merges(_merge_log(spark, d))[1]


@R.add("G3_merge_chains", f"WITH RECURSIVE {_MERGE}, walk AS (SELECT duplicate, canonical, 1 AS n FROM mp UNION ALL SELECT w.duplicate, m.canonical, n + 1 FROM walk w JOIN mp m ON m.duplicate = w.canonical WHERE n < 200) SELECT duplicate, canonical FROM walk WHERE canonical NOT IN (SELECT duplicate FROM mp)")
def g3(spark: SparkSession, d: str) -> DataFrame:
    """The end of every merge chain; chains into a cycle have none."""
    return logfolds.flatten_merges(logfolds.merges(_merge_log(spark, d))[0])


@R.add("A9_pending_operations", "SELECT DISTINCT 'op' || (event_id // 3) AS op FROM events WHERE event_type = 'signup' AND event_id // 3 NOT IN (SELECT event_id // 3 FROM events WHERE event_type = 'purchase')")
def a9(spark: SparkSession, d: str) -> DataFrame:
    """Operations begun without a commit, over a log made of the events."""
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "signup", "op.begin").when(F.col("event_type") == "purchase", "op.commit")
    return logfolds.pending(e.select(kind.alias("kind"), F.concat(F.lit("op"), F.floor(F.col("event_id") / 3)).alias("op")))


@R.add("G1_assertions", f"WITH {GRAPH_SQL} SELECT id, note_id, source, target, type, status, strength FROM fa")
def g1_assertions(spark: SparkSession, d: str) -> DataFrame:
    """Folded assertions: status, adopted type, canonical ends."""
    return folded(spark, d)[0].assertions.select("id", "note_id", "source", "target", "type", "status", "strength")


@R.add("A1_aggregates", f"WITH {GRAPH_SQL} SELECT key, source, type, target, weight, round(mean_strength, 9) AS mean_strength, CAST(len(assertion_ids) AS BIGINT) AS n_assertions, traversable FROM ag")
def a1(spark: SparkSession, d: str) -> DataFrame:
    """Aggregate edges with weight and mean strength."""
    return folded(spark, d)[0].aggregates.withColumn("mean_strength", F.round("mean_strength", 9))


@R.add("A2_rank", f"WITH {GRAPH_SQL} SELECT slug, rank FROM dg")
def a2(spark: SparkSession, d: str) -> DataFrame:
    """Degree over traversable edges."""
    return graph_rank(folded(spark, d)[0])


def graph_rank(g: fold_.Graph) -> DataFrame:
    return fold_.degree(g.aggregates)


@R.add("G1_entities", f"WITH {GRAPH_SQL} SELECT slug, type, rank, declared FROM en")
def g1_entities(spark: SparkSession, d: str) -> DataFrame:
    """Folded entities with type and rank."""
    return folded(spark, d)[0].entities


@R.add("A4_entity_notes", f"WITH {GRAPH_SQL} SELECT slug, unnest(note_ids) AS note_id FROM en")
def a4(spark: SparkSession, d: str) -> DataFrame:
    """The notes that touch each entity."""
    return folded(spark, d)[0].entity_notes


@R.add("K9_provenance", f"WITH {GRAPH_SQL} SELECT slug, unnest(text_unit_ids) AS unit_id FROM en")
def k9(spark: SparkSession, d: str) -> DataFrame:
    """The text units behind each entity, each once."""
    return folded(spark, d)[0].entity_units


@R.add("J2_merged_names", f"WITH {GRAPH_SQL} SELECT slug, unnest(merged_from) AS name FROM en")
def j2(spark: SparkSession, d: str) -> DataFrame:
    """Names that were merged into each entity."""
    return folded(spark, d)[0].merged_from


@R.add("J6_aggregate_members", f"WITH {GRAPH_SQL} SELECT key, unnest(assertion_ids) AS id FROM ag")
def j6(spark: SparkSession, d: str) -> DataFrame:
    """The assertions of each aggregate."""
    return folded(spark, d)[0].members


@R.add("G16_claims", f"WITH {GRAPH_SQL} SELECT id, note_id, subject, text, status, valid_from, valid_to, supersedes FROM fc")
def g16(spark: SparkSession, d: str) -> DataFrame:
    """Folded claims with supersession."""
    return folded(spark, d)[0].claims.select("id", "note_id", "subject", "text", "status", "valid_from", "valid_to", "supersedes")


@R.add("G17_revived", f"WITH {GRAPH_SQL} SELECT slug FROM en0 WHERE live AND slug IN (SELECT slug FROM rt)")
def g17(spark: SparkSession, d: str) -> DataFrame:
    """Retired slugs that a live item keeps."""
    return folded(spark, d)[0].revived


@R.add("G7_isolated", f"WITH {GRAPH_SQL} SELECT slug FROM en WHERE NOT EXISTS (SELECT 1 FROM fa WHERE status <> 'dismissed' AND (source = en.slug OR target = en.slug)) AND NOT EXISTS (SELECT 1 FROM fc WHERE status <> 'dismissed' AND subject = en.slug)")
def g7(spark: SparkSession, d: str) -> DataFrame:
    """Entities that nothing live mentions."""
    g, _ = folded(spark, d, write=True)
    return graph.isolated(g.entities, g.assertions, g.claims).select("slug")


_SEED = "(SELECT slug FROM dg ORDER BY rank DESC, slug LIMIT 1)"
_UND = "und AS (SELECT source AS slug, target AS other, key FROM ag WHERE traversable UNION ALL SELECT target, source, key FROM ag WHERE traversable AND source <> target)"


@R.add("G4_neighbours", f"""WITH {GRAPH_SQL}, {_UND}, h1 AS (SELECT other AS slug, 1 AS hop, min(key) AS via FROM und WHERE slug = {_SEED} AND other <> {_SEED} GROUP BY 1),
h2 AS (SELECT other AS slug, 2 AS hop, min(key) AS via FROM und WHERE slug IN (SELECT slug FROM h1) AND other NOT IN (SELECT slug FROM h1) AND other <> {_SEED} GROUP BY 1) SELECT * FROM h1 UNION ALL SELECT * FROM h2""")
def g4(spark: SparkSession, d: str) -> DataFrame:
    """Two hops around the entity of highest rank."""
    g, _ = folded(spark, d, write=True)
    edges = g.aggregates
    top = fold_.degree(edges).orderBy(F.desc("rank"), "slug").limit(1).select("slug")
    return graph.neighbours(edges, top, 2)


@R.add("A16_cluster_graph", f"WITH {GRAPH_SQL} SELECT least(source, target) AS a, greatest(source, target) AS b, CAST(round(sum(greatest(weight, 1) * cw), 6) AS DOUBLE) AS weight FROM ag JOIN et ON et.type = ag.type WHERE traversable AND cw > 0 AND source <> target GROUP BY 1, 2")
def a16(spark: SparkSession, d: str) -> DataFrame:
    """The weighted undirected graph that is clustered."""
    g, v = folded(spark, d)
    return graph.cluster_graph(g.aggregates, v["edge_types"]).withColumn("weight", F.round("weight", 6))


@R.add("G12_near_duplicates", f"""WITH {GRAPH_SQL}, s AS (SELECT DISTINCT slug FROM en), p AS (SELECT b.slug AS base, x.slug AS superset FROM s x JOIN s b ON length(b.slug) >= 4 AND length(b.slug) < length(x.slug) AND contains(x.slug, b.slug)
  AND regexp_extract_all(b.slug, '\\d+') = regexp_extract_all(x.slug, '\\d+')),
one AS (SELECT superset, min(base) AS base FROM p GROUP BY 1 HAVING count(*) = 1),
und AS (SELECT source AS slug, type, target AS other FROM ag UNION SELECT target, type, source FROM ag)
SELECT base, superset FROM one WHERE NOT EXISTS (SELECT 1 FROM und x JOIN und y ON x.type = y.type AND x.other = y.other WHERE x.slug = one.base AND y.slug = one.superset)""")
def g12(spark: SparkSession, d: str) -> DataFrame:
    """Slugs that look like one entity written two ways."""
    g, _ = folded(spark, d, write=True)
    return graph.near_duplicates(g.entities, g.aggregates)


@R.add("G13_similar", "SELECT a.vec_id AS \"left\", b.vec_id AS \"right\", round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4")
def g13(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of vectors at or above a cosine."""
    return graph.similar(table(spark, d, "embeddings"), 0.4).withColumn("cosine", F.round("cosine", 6))


@R.add("G14_type_findings", f"""WITH {GRAPH_SQL}, i AS (SELECT * FROM inst WHERE note_id IN (SELECT id FROM n0))
SELECT 'unknown_entity_type' AS kind, slug, count(DISTINCT note_id) AS notes FROM i WHERE type IS NOT NULL AND type NOT IN {_TYPES} GROUP BY slug
UNION ALL SELECT 'conflicting_entity_type', slug, count(DISTINCT note_id) FROM i WHERE type IN {_TYPES} GROUP BY slug HAVING count(DISTINCT type) > 1
UNION ALL SELECT 'reference_only_entity', slug, 0 FROM en WHERE slug NOT IN (SELECT slug FROM i)""")
def g14(spark: SparkSession, d: str) -> DataFrame:
    """Unknown, conflicting and missing declarations of entity types."""
    g, v = folded(spark, d)
    inst = v["instances"].join(v["notes"].select(F.col("id").alias("note_id")), "note_id", "left_semi")
    return graph.type_findings(inst, g.entities, ENTITY_TYPES)


RULES = [("located_in", None, ["place", "organisation"]), ("cites", ["paper"], ["paper", "concept"]), ("part_of", ["concept", "tool"], ["concept", "tool"])]
_RULES = "rules(type, domain, range) AS (VALUES " + ", ".join(f"('{t}', {'NULL' if a is None else a}, {b})" for t, a, b in RULES) + ")"


@R.add("G15_signatures", f"""WITH {GRAPH_SQL}, {_RULES}, j AS (SELECT fa.id, nullif(s.type, 'unknown') AS st, nullif(t.type, 'unknown') AS tt, domain, range FROM fa JOIN rules r ON r.type = fa.type LEFT JOIN en s ON s.slug = fa.source LEFT JOIN en t ON t.slug = fa.target),
k AS (SELECT id, (st IS NULL OR domain IS NULL OR list_contains(domain, st)) AND (tt IS NULL OR range IS NULL OR list_contains(range, tt)) AS fwd, (tt IS NULL OR domain IS NULL OR list_contains(domain, tt)) AND (st IS NULL OR range IS NULL OR list_contains(range, st)) AS rev FROM j)
SELECT id, CASE WHEN rev THEN 'reverse' ELSE 'mismatch' END AS finding FROM k WHERE NOT fwd""")
def g15(spark: SparkSession, d: str) -> DataFrame:
    """Edges whose ends do not fit their type."""
    g, _ = folded(spark, d, write=True)
    return graph.signature_findings(g.assertions, g.entities, spark.createDataFrame(RULES, "type string, domain array<string>, range array<string>"))


@R.add("A10_proposals", f"WITH {GRAPH_SQL}, p AS (SELECT *, 'edge' AS kind, trim(regexp_replace(lower(proposed_type), '[^a-z0-9]+', '-', 'g'), '-') AS proposed FROM fa WHERE type IS NULL AND proposed_type IS NOT NULL) SELECT kind, proposed, count(*) AS count, arg_min(source || ' ' || proposed_type || ' ' || target, id) AS example FROM p WHERE proposed NOT IN (SELECT proposed FROM ad) GROUP BY 1, 2")
def a10(spark: SparkSession, d: str) -> DataFrame:
    """Wordings of edge types that wait for adoption."""
    g, v = folded(spark, d)
    return graph.proposals(g.assertions, v["adoptions"])


@R.add("A23_ambiguous_aliases", "WITH al AS (SELECT DISTINCT slug, lower(trim(unnest(merged_from))) AS alias FROM entities) SELECT alias, list_sort(list(DISTINCT slug)) AS slugs FROM al WHERE alias IS NOT NULL GROUP BY 1 HAVING count(DISTINCT slug) > 1")
def a23(spark: SparkSession, d: str) -> DataFrame:
    """Names that several entities claim."""
    al = table(spark, d, "entities").select("slug", F.explode("merged_from").alias("m")).select("slug", F.lower(F.trim("m")).alias("alias")).filter("alias is not null")
    return graph.ambiguous_aliases(al)


@R.add("P7_claims_as_of", f"""WITH {GRAPH_SQL}, q AS (SELECT '1950-06-15' AS day) SELECT id, subject, status, valid_from, valid_to FROM fc, q
WHERE (valid_from IS NULL OR valid_from[:least(length(valid_from), 10)] <= day[:least(length(valid_from), 10)]) AND (valid_to IS NULL OR valid_to = 'unknown' OR day[:least(length(valid_to), 10)] <= valid_to[:least(length(valid_to), 10)])""")
def p7_as_of(spark: SparkSession, d: str) -> DataFrame:
    """Claims that hold on a day, whatever their status."""
    c = folded(spark, d)[0].claims
    return c.filter(S.holds_at(F.col("valid_from"), F.col("valid_to"), "1950-06-15")).select("id", "subject", "status", "valid_from", "valid_to")


@R.add("P8_validity", r"SELECT DISTINCT id, valid_from, CASE WHEN regexp_full_match(valid_from, '\d{4}') THEN true WHEN regexp_full_match(valid_from, '\d{4}-\d{2}') THEN valid_from[6:7] BETWEEN '01' AND '12' WHEN regexp_full_match(valid_from, '\d{4}-\d{2}-\d{2}') THEN TRY_CAST(valid_from AS DATE) IS NOT NULL ELSE false END AS valid, CASE length(valid_from) WHEN 4 THEN 'year' WHEN 7 THEN 'month' WHEN 10 THEN 'day' END AS precision FROM claims WHERE valid_from IS NOT NULL")
def p8_validity(spark: SparkSession, d: str) -> DataFrame:
    """Whether partial dates exist, and their precision."""
    c = table(spark, d, "claims").filter("valid_from is not null")
    return c.select("id", "valid_from", S.is_valid_date("valid_from").alias("valid"), S.precision("valid_from").alias("precision")).distinct()


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "kind", "title", "text")


@lru_cache(maxsize=1)
def _bm25_sql() -> str:
    terms = search.terms_of(QUERY)
    distinct = list(dict.fromkeys(terms))
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(distinct))
    df = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(distinct)))
    idf = lambda i: f"CASE WHEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) > 0 THEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) ELSE 1e-6 END"
    parts = " + ".join(f"({idf(distinct.index(w))}) * (f{distinct.index(w)} * 2.2) / (f{distinct.index(w)} + 1.2 * (0.25 + 0.75 * len / avg))" for w in terms)
    hit = " OR ".join(f"f{i} > 0" for i in range(len(distinct)))
    return f"""tok AS (SELECT doc_id, kind, regexp_extract_all(strip_accents(lower(coalesce(title, '') || ' ' || coalesce(text, ''))), '[a-z0-9]+') AS t FROM documents),
tf AS (SELECT doc_id, kind, len(t) AS len, {tf} FROM tok), stat AS (SELECT count(*) AS n, avg(len) AS avg, {df} FROM tf),
lex AS (SELECT doc_id, kind, {parts} AS bm25 FROM tf, stat WHERE {hit} ORDER BY bm25 DESC, doc_id LIMIT 40)"""


@R.add("R1_lexical", f"WITH {_bm25_sql()} SELECT doc_id, kind, round(bm25, 6) AS bm25 FROM lex")
def r1(spark: SparkSession, d: str) -> DataFrame:
    """The forty best documents by BM25."""
    return search.lexical(_docs(spark, d), QUERY).withColumn("bm25", F.round("bm25", 6))


@R.add("R1_indexed", f"WITH {_bm25_sql()} SELECT doc_id, kind, round(bm25, 6) AS bm25 FROM lex")
def r1_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The same from postings: the index is built, then the query reads the folders of its terms."""
    return search.Index(spark).build(_docs(spark, d)).lexical(QUERY).withColumn("bm25", F.round("bm25", 6))


_QV = "qv AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
_VEC = f"{_QV}, vec AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS cosine FROM embeddings, qv ORDER BY cosine DESC, vec_id LIMIT 40)"


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return list(table(spark, d, "embeddings").filter("vec_id = 0").first()["embedding"])  # one row


@R.add("R2_nearest", f"WITH {_VEC} SELECT vec_id, round(cosine, 6) AS cosine FROM vec")
def r2(spark: SparkSession, d: str) -> DataFrame:
    """The forty nearest vectors."""
    return search.nearest(table(spark, d, "embeddings"), _query_vector(spark, d)).withColumn("cosine", F.round("cosine", 6))


_FUSED = f"{_bm25_sql()}, {_VEC}, rk AS (SELECT doc_id, 1.0 / (60 + row_number() OVER (ORDER BY bm25 DESC, doc_id)) AS r FROM lex UNION ALL SELECT vec_id, 1.0 / (60 + row_number() OVER (ORDER BY cosine DESC, vec_id)) FROM vec), fz AS (SELECT doc_id, sum(r) AS score FROM rk GROUP BY 1)"


@R.add("R3_fusion", f"WITH {_FUSED} SELECT doc_id, round(score, 9) AS score FROM fz")
def r3(spark: SparkSession, d: str) -> DataFrame:
    """Reciprocal-rank fusion of both rankings."""
    vec = search.nearest(table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), _query_vector(spark, d), key="doc_id")
    return search.fuse([(search.lexical(_docs(spark, d), QUERY), "bm25"), (vec, "cosine")]).withColumn("score", F.round("score", 9))


@R.add("R4_local_search", f"WITH {_FUSED}, top AS (SELECT * FROM fz ORDER BY round(score, 12) DESC, doc_id LIMIT 8), j AS (SELECT t.doc_id, o.kind, o.title, o.text[:200] AS snippet, round(lex.bm25, 6) AS bm25, round(vec.cosine, 6) AS cosine, round(t.score, 9) AS score FROM top t JOIN documents o ON o.doc_id = t.doc_id LEFT JOIN lex ON lex.doc_id = t.doc_id LEFT JOIN vec ON vec.vec_id = t.doc_id) SELECT *, (SELECT bool_or(coalesce(bm25 >= 2.0 OR cosine >= 0.35, false)) FROM j) AS evident FROM j")
def r4(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid search: the flagship query."""
    vec = table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    ids = _docs(spark, d)
    hits = search.local_search(ids, vec, QUERY, _query_vector(spark, d))
    return hits.withColumns({"bm25": F.round("bm25", 6), "cosine": F.round("cosine", 6), "score": F.round("score", 9)})


_TOP = f"{_FUSED}, top AS (SELECT * FROM fz ORDER BY round(score, 12) DESC, doc_id LIMIT 8), j AS (SELECT t.doc_id, lex.bm25, vec.cosine FROM top t JOIN documents o ON o.doc_id = t.doc_id LEFT JOIN lex ON lex.doc_id = t.doc_id LEFT JOIN vec ON vec.vec_id = t.doc_id), s AS (SELECT count(*) AS hits, max(bm25) AS b, max(cosine) AS c FROM j)"


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return search.local_search(_docs(spark, d), table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), QUERY, _query_vector(spark, d))


@R.add("A14_signals", f"WITH {_TOP} SELECT hits, round(b, 6) AS max_bm25, round(c, 6) AS max_cosine, coalesce(b >= 2.0, false) OR coalesce(c >= 0.35, false) AS evident, CASE WHEN NOT (coalesce(b >= 2.0, false) OR coalesce(c >= 0.35, false)) THEN 'no evidence above the floors' END AS note FROM s")
def a14(spark: SparkSession, d: str) -> DataFrame:
    """The greatest scores of the hits and whether they are evidence."""
    return search.signals(_hits(spark, d)).withColumns({"max_bm25": F.round("max_bm25", 6), "max_cosine": F.round("max_cosine", 6)})


@R.add("P16_shown_hits", f"WITH {_TOP} SELECT doc_id FROM j, s WHERE coalesce(b >= 2.0, false) OR coalesce(c >= 0.35, false)")
def p16(spark: SparkSession, d: str) -> DataFrame:
    """The hits as they are given: none without evidence."""
    return search.shown(_hits(spark, d)).select("doc_id")


@R.add("P4_kind_filter", f"WITH {_bm25_sql().replace('WHERE f0 > 0', 'WHERE kind IN (' + chr(39) + 'note' + chr(39) + ', ' + chr(39) + 'report' + chr(39) + ') AND (f0 > 0').replace('ORDER BY bm25 DESC, doc_id LIMIT 40', ') ORDER BY bm25 DESC, doc_id LIMIT 40')} SELECT doc_id, kind, round(bm25, 6) AS bm25 FROM lex")
def p4_kind(spark: SparkSession, d: str) -> DataFrame:
    """BM25 within two kinds; statistics over all kinds."""
    return search.lexical(_docs(spark, d), QUERY, ["note", "report"]).withColumn("bm25", F.round("bm25", 6))


@R.add("R8_graph_stats", f"""WITH {GRAPH_SQL} SELECT (SELECT count(*) FROM en) AS entities, (SELECT count(*) FROM fa) AS assertions, (SELECT count(*) FROM fa WHERE status = 'proposed') AS proposed, (SELECT count(*) FROM fa WHERE status = 'confirmed') AS confirmed,
(SELECT count(*) FROM ag WHERE traversable) AS traversable, (SELECT count(*) FROM fc) AS claims, (SELECT count(*) FROM fc WHERE status = 'superseded') AS superseded, (SELECT count(*) FROM en WHERE rank = 0) AS orphans""")
def r8(spark: SparkSession, d: str) -> DataFrame:
    """One row of counts."""
    g, _ = folded(spark, d, write=True)
    one = lambda df, **c: df.agg(*(x.alias(n) for n, x in c.items()))
    a = one(g.assertions, assertions=F.count("*"), proposed=F.count_if(F.col("status") == "proposed"), confirmed=F.count_if(F.col("status") == "confirmed"))
    e = one(g.entities, entities=F.count("*"), orphans=F.count_if(F.col("rank") == 0))
    c = one(g.claims, claims=F.count("*"), superseded=F.count_if(F.col("status") == "superseded"))
    t = one(g.aggregates, traversable=F.count_if("traversable"))
    return a.join(e).join(c).join(t)  # one row each


@R.add("R7_review_queue", f"""WITH {GRAPH_SQL} SELECT 'relationship' AS section, * FROM (SELECT id, strength, source || ' ' || coalesce(type, proposed_type, '?') || ' ' || target AS label FROM fa WHERE status = 'proposed' ORDER BY strength DESC NULLS LAST, id LIMIT 25)
UNION ALL SELECT 'claim', * FROM (SELECT id, NULL, subject FROM fc WHERE status = 'proposed' ORDER BY id LIMIT 25)""")
def r7(spark: SparkSession, d: str) -> DataFrame:
    """The review queue: each section has its own limit."""
    g, _ = folded(spark, d)
    label = F.concat_ws(" ", "source", F.coalesce("type", "proposed_type", F.lit("?")), "target")
    a = g.assertions.filter("status = 'proposed'").orderBy(F.desc_nulls_last("strength"), "id").limit(25).select(F.lit("relationship").alias("section"), "id", "strength", label.alias("label"))
    c = g.claims.filter("status = 'proposed'").orderBy("id").limit(25).select(F.lit("claim").alias("section"), "id", F.lit(None).cast("int").alias("strength"), F.col("subject").alias("label"))
    return a.unionByName(c)


@R.add("A12_live_items", f"WITH {GRAPH_SQL} SELECT slug, kind, status, count(*) AS n FROM (SELECT source AS slug, 'relationship' AS kind, status FROM fa UNION ALL SELECT target, 'relationship', status FROM fa WHERE target <> source UNION ALL SELECT subject, 'claim', status FROM fc) WHERE status <> 'dismissed' GROUP BY ALL")
def a12(spark: SparkSession, d: str) -> DataFrame:
    """Live items of each entity by kind and status, which stand against a retirement."""
    g, _ = folded(spark, d, write=True)
    ends = graph.undirected(g.assertions).select("slug", F.lit("relationship").alias("kind"), "status")
    both = ends.unionByName(g.claims.select(F.col("subject").alias("slug"), F.lit("claim").alias("kind"), "status"))
    return both.filter("status <> 'dismissed'").groupBy("slug", "kind", "status").agg(F.count("*").alias("n"))


@R.add("V9_unresolved_citations", f"WITH {GRAPH_SQL}, ci AS (SELECT DISTINCT a.id, unnest(a.units) AS cited FROM fa a) SELECT id, cited FROM ci WHERE cited NOT IN (SELECT id FROM text_units)")
def v9(spark: SparkSession, d: str) -> DataFrame:
    """Cited units that do not exist: an anti-join on the exploded citations."""
    g, _ = folded(spark, d)
    c = g.assertions.select("id", F.explode("text_unit_ids").alias("cited")).distinct()
    return c.join(table(spark, d, "text_units").select(F.col("id").alias("cited")), "cited", "left_anti").select("id", "cited")


@R.add("J19_repeated_documents", "SELECT doc_id, hash FROM (SELECT doc_id, 'sha256:' || sha256(text) AS hash, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents WHERE text IS NOT NULL) WHERE rn > 1")
def j19(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose content an earlier one has: by hash, the first of each found by an aggregation, so a large group of copies isn't sorted."""
    h = table(spark, d, "documents").filter("text is not null").select("doc_id", S.content_hash("text").alias("hash"))
    first = h.groupBy("hash").agg(F.min("doc_id").alias("first"))
    return h.join(first, "hash").filter("doc_id > first").select("doc_id", "hash")


@R.add("F1_slugs", "SELECT doc_id, trim(regexp_replace(regexp_replace(lower(strip_accents(title)), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents WHERE title IS NOT NULL")
def f1(spark: SparkSession, d: str) -> DataFrame:
    """Slugs of titles."""
    return table(spark, d, "documents").filter("title is not null").select("doc_id", S.slugify("title").alias("slug"))


_SPACES = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_FIRST_LINE = r"coalesce(list_filter(list_transform(string_split_regex({0}, '\r\n|[\n\x0B\f\r\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_replace(x, '^{2}+|{2}+$', '', 'g')), lambda x: x <> '')[1][:{1}], '')"


@R.add("P1_first_lines", f"SELECT doc_id, {_FIRST_LINE.format('text', 80, _SPACES)} AS line FROM documents WHERE text IS NOT NULL")
def p1_lines(spark: SparkSession, d: str) -> DataFrame:
    """The first line of every text, with Unicode's white space and line ends."""
    return table(spark, d, "documents").filter("text is not null").select("doc_id", S.first_line("text", 80).alias("line"))


@R.add("F2_ids", r"SELECT DISTINCT id, CASE WHEN starts_with(id, 'x_') THEN 'relationship_assertion' WHEN starts_with(id, 'k_') THEN 'claim_assertion' WHEN starts_with(id, 'u_') THEN 'text_unit' END AS kind, CASE WHEN regexp_matches(id, '^u_(.+)_\d{4,}$') THEN 'c_' || regexp_extract(id, '^u_(.+)_\d{4,}$', 1) END AS capture FROM (SELECT id FROM assertions UNION ALL SELECT id FROM claims UNION ALL SELECT id FROM text_units)")
def f2(spark: SparkSession, d: str) -> DataFrame:
    """The kind that an id names, and the capture of a unit."""
    ids = table(spark, d, "assertions").select("id").union(table(spark, d, "claims").select("id")).union(table(spark, d, "text_units").select("id")).distinct()
    return ids.select("id", S.id_kind(F.col("id")).alias("kind"), S.unit_parent(F.col("id")).alias("capture"))


@R.add("U3_document_kinds", "SELECT kind, count(*) AS n, count(text) AS with_text, sum(n_chars) AS chars FROM documents GROUP BY kind")
def u3(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each kind."""
    return table(spark, d, "documents").groupBy("kind").agg(F.count("*").alias("n"), F.count("text").alias("with_text"), F.sum("n_chars").alias("chars"))


_HASHED = """h AS (SELECT slug, 'type=' || type AS line, 0 AS part, '' AS k FROM en
  UNION ALL SELECT e.slug, 'note=' || n0.id || ':sha256:' || sha256(n0.body), 1, n0.id FROM (SELECT slug, unnest(note_ids) AS note_id FROM en) e JOIN n0 ON n0.id = e.note_id
  UNION ALL SELECT s.slug, 'assertion=' || id || ':' || status || ':' || coalesce(CAST(strength AS VARCHAR), 'None') || ':' || coalesce(type, 'None') || ':' || coalesce(proposed_type, 'None') || ':sha256:' || sha256(coalesce(description, '')) || CASE WHEN len(units) > 0 THEN ':' || array_to_string(units, ',') ELSE '' END, 2, id
    FROM (SELECT source AS slug, * FROM fa UNION ALL SELECT target, * FROM fa WHERE target <> source) s SEMI JOIN en ON en.slug = s.slug
  UNION ALL SELECT s.slug, 'edge=' || key || ':' || weight || ':' || CAST(CAST(round(mean_strength, 6) AS DECIMAL(18, 6)) AS VARCHAR), 3, key FROM (SELECT source AS slug, * FROM ag UNION ALL SELECT target, * FROM ag WHERE target <> source) s SEMI JOIN en ON en.slug = s.slug WHERE traversable
  UNION ALL SELECT subject, 'claim=' || id || ':' || status || ':' || coalesce(valid_from, 'None') || ':' || coalesce(valid_to, 'None') || ':sha256:' || sha256(coalesce(text, '')), 4, id FROM fc SEMI JOIN en ON en.slug = fc.subject)"""


_MERKLE = ", hb AS (SELECT slug, part, substr(md5(k), 1, 3) AS bucket, sha256(string_agg(line, chr(10) ORDER BY k)) AS b FROM h WHERE line IS NOT NULL GROUP BY 1, 2, 3)"


@R.add("A19_evidence_hashes", f"WITH {GRAPH_SQL}, {_HASHED} {_MERKLE} SELECT slug, 'sha256:' || sha256(string_agg(b, chr(10) ORDER BY part, bucket)) AS input_hash FROM hb GROUP BY 1")
def a19(spark: SparkSession, d: str) -> DataFrame:
    """A hash of all evidence about each entity, so a page that it no longer matches is stale."""
    g, v = folded(spark, d, write=True)
    return evidence_hashes(g, v["notes"])


def evidence_hashes(g: fold_.Graph, notes: DataFrame) -> DataFrame:
    """slug, input_hash over the lines of type, notes, assertions, traversable edges and claims.

    The hash is a tree of two levels: lines are hashed in order within each of 4,096 buckets of their key, and the buckets'
    hashes in order, so an entity with a third of all evidence is spread over tasks.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    hashed = lambda c: S.content_hash(F.coalesce(c, F.lit("")))
    own = g.entities.select("slug")
    a = graph.undirected(g.assertions).join(own, "slug", "left_semi")
    units = F.when(F.size("text_unit_ids") > 0, F.concat(F.lit(":"), F.array_join("text_unit_ids", ","))).otherwise("")
    e = graph.undirected(g.aggregates.filter("traversable")).join(own, "slug", "left_semi")
    c = g.claims.withColumn("slug", F.col("subject")).join(own, "slug", "left_semi")
    n = g.entity_notes.select("slug", F.col("note_id").alias("id")).join(notes.select("id", "body"), "id")
    lines = [
        g.entities.select("slug", F.lit(0).alias("part"), F.lit("").alias("k"), F.concat(F.lit("type="), "type").alias("line")),
        n.filter("body is not null").select("slug", F.lit(1).alias("part"), F.col("id").alias("k"), F.concat(F.lit("note="), "id", F.lit(":"), S.content_hash("body")).alias("line")),
        a.select("slug", F.lit(2).alias("part"), F.col("id").alias("k"), F.concat(F.lit("assertion="), F.concat_ws(":", "id", "status", text("strength"), text("type"), text("proposed_type"), hashed("description")), units).alias("line")),
        e.select("slug", F.lit(3).alias("part"), F.col("key").alias("k"), F.concat(F.lit("edge="), F.concat_ws(":", "key", "weight", F.round("mean_strength", 6).cast("decimal(18,6)").cast("string"))).alias("line")),
        c.select("slug", F.lit(4).alias("part"), F.col("id").alias("k"), F.concat(F.lit("claim="), F.concat_ws(":", "id", "status", text("valid_from"), text("valid_to"), hashed("text"))).alias("line")),
    ]
    all_ = lines[0]
    for x in lines[1:]:
        all_ = all_.unionByName(x)
    ordered = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    joined = lambda c: F.array_join(F.transform("l", lambda x: x[c]), "\n")
    low = all_.groupBy("slug", "part", F.substring(F.md5("k"), 1, 3).alias("bucket")).agg(ordered("k", "line").alias("l"))
    low = low.select("slug", "part", "bucket", F.sha2(joined("line"), 256).alias("b"))
    return low.groupBy("slug").agg(ordered("part", "bucket", "b").alias("l")).select("slug", S.content_hash(joined("b")).alias("input_hash"))


_DAY = "2025-06-01"


@R.add("J18_drift", f"""WITH v AS (SELECT id, arrived_at, md5(coalesce(body, '')) AS h FROM notes),
s AS (SELECT id, arg_max(h, {{'a': arrived_at, 'h': h}}) AS h FROM v WHERE arrived_at <= TIMESTAMP '{_DAY}' GROUP BY 1),
c AS (SELECT id, arg_max(h, {{'a': arrived_at, 'h': h}}) AS h FROM v WHERE id NOT IN (SELECT id FROM removals WHERE kind = 'note' AND id IS NOT NULL) GROUP BY 1)
SELECT coalesce(s.id, c.id) AS id, CASE WHEN s.id IS NULL THEN 'added' WHEN c.id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM s FULL JOIN c ON s.id = c.id WHERE s.id IS NULL OR c.id IS NULL OR s.h IS DISTINCT FROM c.h""")
def j18(spark: SparkSession, d: str) -> DataFrame:
    """Drift of the notes between their state as of a day and the present one, without removed notes."""
    v = table(spark, d, "notes").select("id", "arrived_at", F.md5(F.coalesce("body", F.lit(""))).alias("h"))
    last = lambda df: df.groupBy("id").agg(F.max_by("h", F.struct("arrived_at", "h")).alias("h"))
    gone = table(spark, d, "removals").filter("kind = 'note'").select("id")
    stored = last(v.filter(F.col("arrived_at") <= F.lit(_DAY).cast("timestamp_ntz")))
    return drift(stored, last(v.join(gone, "id", "left_anti")), "id")


def drift(stored: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """key, change (added, removed, changed) of a full outer join by key on h."""
    s, c = stored.select(F.col(key).alias("_s"), F.col("h").alias("_hs")), current.select(F.col(key).alias("_c"), F.col("h").alias("_hc"))
    j = s.join(c, F.col("_s") == F.col("_c"), "full_outer")
    change = F.when(F.col("_s").isNull(), "added").when(F.col("_c").isNull(), "removed").when(~F.col("_hs").eqNullSafe(F.col("_hc")), "changed")
    return j.select(F.coalesce("_s", "_c").alias(key), change.alias("change")).filter("change is not null")


@R.add("K11_catalog", f"""WITH {GRAPH_SQL}, c AS (SELECT (SELECT count(DISTINCT capture_id) FROM text_units) AS c, (SELECT count(*) FROM n0) AS n, (SELECT count(*) FROM en) AS e)
SELECT 0 AS part, unnest(range(6)) AS place, unnest(['# Index', '', c.c || ' captures · ' || c.n || ' notes · ' || c.e || ' entities', '', '## Notes', '']) AS line FROM c
UNION ALL SELECT 1, row_number() OVER (ORDER BY created NULLS FIRST, id NULLS FIRST) - 1, '- `' || coalesce(id, '') || '` ' || coalesce(created, '')[:10] || ' — ' || {_FIRST_LINE.format("coalesce(body, '')", 120, _SPACES)} FROM n0
UNION ALL SELECT 2, unnest(range(3)), unnest(['', '## Entities', ''])
UNION ALL SELECT 3, row_number() OVER (ORDER BY rank DESC, slug) - 1, '- [[' || slug || ']] — ' || type || ', rank ' || rank FROM en""")
def k11(spark: SparkSession, d: str) -> DataFrame:
    """The catalog of all notes and entities with their counts (O8, O9): part (head, notes, heading, entities as 0 to 3), place in the part, line. Captures are those that the text units name."""
    g, v = folded(spark, d)
    e = materialize(g.entities.select("slug", "type", "rank"), "catalog")
    n = materialize(v["notes"].select("id", "created", S.first_line("body", 120).alias("first")), "catalog")
    c = table(spark, d, "text_units").agg(F.count_distinct("capture_id").alias("c"))
    counts = c.join(n.agg(F.count("*").alias("n"))).join(e.agg(F.count("*").alias("e")))  # one row each
    head = F.array(F.lit("# Index"), F.lit(""), F.format_string("%d captures · %d notes · %d entities", "c", "n", "e"), F.lit(""), F.lit("## Notes"), F.lit(""))
    fixed = lambda part, lines: counts.select(F.lit(part).alias("part"), F.posexplode(lines).alias("place", "line")).withColumn("place", F.col("place").cast("long"))
    text = lambda x: F.coalesce(F.col(x), F.lit(""))
    notes = global_index(n, ["created", "id"], "catalog").select(F.lit(1).alias("part"), F.col("row_index").alias("place"), F.concat(F.lit("- `"), text("id"), F.lit("` "), F.substring(text("created").cast("string"), 1, 10), F.lit(" — "), text("first")).alias("line"))
    entities = global_index(e, [F.desc("rank"), "slug"], "catalog").select(F.lit(3).alias("part"), F.col("row_index").alias("place"), F.concat(F.lit("- [["), "slug", F.lit("]] — "), "type", F.lit(", rank "), "rank").alias("line"))
    heading = F.array(F.lit(""), F.lit("## Entities"), F.lit(""))
    return fixed(0, head).unionByName(notes).unionByName(fixed(2, heading)).unionByName(entities)


@R.add("K10_edge_export", f"WITH {GRAPH_SQL} SELECT ag.key, ag.source, ag.target, ag.type, ag.weight, ag.traversable, len(assertion_ids) AS n_assertions, list_sort(list_distinct(list(fa.status))) AS statuses FROM ag JOIN fa ON list_contains(ag.assertion_ids, fa.id) GROUP BY ALL")
def k10(spark: SparkSession, d: str) -> DataFrame:
    """Edges with their members, as the export lists them."""
    g, _ = folded(spark, d, write=True)
    members = g.members.join(g.assertions.select("id", "status"), "id").groupBy("key").agg(F.array_sort(F.collect_set("status")).alias("statuses"))  # three statuses
    return g.aggregates.join(members, "key").select("key", "source", "target", "type", "weight", "traversable", "n_assertions", "statuses")


@R.add("G20_alias_lookup", "WITH al AS (SELECT DISTINCT lower(trim(unnest(merged_from))) AS alias, slug FROM entities) SELECT n.base AS name, min(coalesce(e.slug, al.slug)) AS slug, count(DISTINCT coalesce(e.slug, al.slug)) AS candidates FROM (SELECT DISTINCT lower(trim(base)) AS base FROM near_duplicates WHERE trim(base) <> '') n LEFT JOIN entities e ON e.slug = n.base LEFT JOIN al ON al.alias = n.base AND e.slug IS NULL GROUP BY 1")
def g20(spark: SparkSession, d: str) -> DataFrame:
    """Names resolved to entities: the slug itself, else an alias; more than one candidate is ambiguous."""
    e = table(spark, d, "entities")
    al = e.select("slug", F.explode("merged_from").alias("m")).select(F.lower(F.trim("m")).alias("name"), F.col("slug").alias("by_alias")).distinct()
    names = table(spark, d, "near_duplicates").select(F.lower(F.trim("base")).alias("name")).filter("name <> ''").distinct()
    own = e.select(F.col("slug").alias("name"), F.col("slug").alias("by_slug"))
    j = names.join(own, "name", "left").join(al, "name", "left").select("name", F.coalesce("by_slug", "by_alias").alias("slug"))
    return j.groupBy("name").agg(F.min("slug").alias("slug"), F.count_distinct("slug").alias("candidates"))
