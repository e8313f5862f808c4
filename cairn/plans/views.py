"""Queries of the views: searched documents, filters of the drawn graph, overlays, lookups, labels, and the write boundary's repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import scalars as S
from cairn.operators import fold as fold_
from cairn.operators import graph, logfolds, references, search, views
from cairn.plans.common import Registry, table
from cairn.plans.vault import _FIRST_LINE, _HASHED, _MERKLE, _RULES, _SEED, _SPACES, _UND, GRAPH_SQL, RULES, _first, evidence_hashes, folded, vault
from cairn.session import global_index, materialize

R = Registry()
PAGES = 25  # rows of a section that is a page of its own
_SLUG = "trim(regexp_replace(regexp_replace(lower(strip_accents({0})), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-')"


def _line(c: str, n: int) -> str:
    return _FIRST_LINE.format(c, n, _SPACES)


_NOTES = """nt AS (SELECT n0.id, n0.body, concat_ws(chr(10), nullif(n0.body, ''), nullif(a.t, ''), nullif(c.t, '')) AS text FROM n0
  LEFT JOIN (SELECT note_id, string_agg(coalesce(description, ''), ' ' ORDER BY id, coalesce(description, '')) AS t FROM a0 GROUP BY 1) a ON a.note_id = n0.id
  LEFT JOIN (SELECT note_id, string_agg(coalesce(text, ''), ' ' ORDER BY id, coalesce(text, '')) AS t FROM c0 GROUP BY 1) c ON c.note_id = n0.id)"""


def _note_texts(spark: SparkSession, d: str) -> DataFrame:
    v = vault(spark, d)
    return views.note_texts(v["notes"], v["assertions"], v["claims"])


@R.add("P2_note_texts", f"WITH {GRAPH_SQL}, {_NOTES} SELECT id, text FROM nt")
def p2(spark: SparkSession, d: str) -> DataFrame:
    """What is searched of each note."""
    return _note_texts(spark, d).select("id", "text")


def _units(spark: SparkSession, d: str) -> DataFrame:
    return _first(table(spark, d, "text_units").filter("capture_id is not null"), "arrived_at", "capture_id", "ordinal", "text")


_UNITS = "tu AS (SELECT id, capture_id, locator, text FROM text_units WHERE capture_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrived_at NULLS FIRST, capture_id, ordinal NULLS FIRST, text NULLS FIRST) = 1)"


def _others(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "documents").filter("kind in ('entity', 'report', 'unparsed')")
    return o.select(F.concat(F.lit("d_"), "doc_id").alias("doc_id"), "kind", "title", "text")


_DOCS = f"""{_NOTES}, {_UNITS}, un AS (SELECT tu.*, count(*) OVER (PARTITION BY capture_id) AS n FROM tu),
docs AS (SELECT CASE WHEN n = 1 THEN capture_id ELSE id END AS doc_id, CASE WHEN n = 1 THEN 'capture' ELSE 'unit' END AS kind, CASE WHEN n = 1 THEN {_line('text', 120)} ELSE coalesce(locator, {_line('text', 120)}) END AS title, text FROM un
UNION ALL SELECT id, 'note', {_line('body', 120)}, text FROM nt UNION ALL SELECT 'd_' || doc_id, kind, title, text FROM documents WHERE kind IN ('entity', 'report', 'unparsed'))"""


@R.add("P3_documents", f"WITH {GRAPH_SQL}, {_DOCS} SELECT doc_id, kind, title, length(text) AS n FROM docs")
def p3(spark: SparkSession, d: str) -> DataFrame:
    """Everything that is searched, of six kinds, with its title and the length of its text."""
    return views.documents(_units(spark, d), _note_texts(spark, d), _others(spark, d)).select("doc_id", "kind", "title", F.length("text").cast("long").alias("n"))


@R.add("P10_read", f"""WITH {GRAPH_SQL}, {_NOTES}, {_UNITS}, r AS (SELECT id, 'note' AS kind, text FROM nt UNION ALL SELECT id, 'text_unit', text FROM tu UNION ALL SELECT id, 'claim_assertion', text FROM fc UNION ALL SELECT id, 'relationship_assertion', description FROM fa UNION ALL SELECT 'e_' || slug, 'entity', type FROM en),
q AS (SELECT unnest([(SELECT min(id) FROM n0), (SELECT max(id) FROM tu), (SELECT min(id) FROM fc), (SELECT max(id) FROM fa), (SELECT 'e_' || min(slug) FROM en), 'n_nowhere']) AS id) SELECT r.* FROM r SEMI JOIN q ON q.id = r.id""")
def p10(spark: SparkSession, d: str) -> DataFrame:
    """Records by id, whatever their kind."""
    g, _ = folded(spark, d, write=True)
    notes, units = _note_texts(spark, d), _units(spark, d)
    e = g.entities.select(F.concat(F.lit("e_"), "slug").alias("id"), F.col("type").alias("text"))
    ask = [notes.agg(F.min("id").alias("id")), units.agg(F.max("id")), g.claims.agg(F.min("id")), g.assertions.agg(F.max("id")), e.agg(F.min("id")), spark.createDataFrame([("n_nowhere",)], "id string")]
    ids = ask[0]
    for a in ask[1:]:
        ids = ids.union(a)
    return views.read(ids, {"note": (notes, "id", "text"), "text_unit": (units, "id", "text"), "claim_assertion": (g.claims, "id", "text"), "relationship_assertion": (g.assertions, "id", "description"), "entity": (e, "id", "text")})


@R.add("P6_typed_neighbours", f"""WITH {GRAPH_SQL}, {_UND.replace("WHERE traversable", "WHERE type IN ('supports', 'cites') AND traversable")}, h1 AS (SELECT other AS slug, 1 AS hop, min(key) AS via FROM und WHERE slug = {_SEED} AND other <> {_SEED} GROUP BY 1),
h2 AS (SELECT other AS slug, 2 AS hop, min(key) AS via FROM und WHERE slug IN (SELECT slug FROM h1) AND other NOT IN (SELECT slug FROM h1) AND other <> {_SEED} GROUP BY 1) SELECT * FROM h1 UNION ALL SELECT * FROM h2""")
def p6(spark: SparkSession, d: str) -> DataFrame:
    """Two hops over two types of edges around the entity of highest rank."""
    g, _ = folded(spark, d, write=True)
    top = fold_.degree(g.aggregates).orderBy(F.desc("rank"), "slug").limit(1).select("slug")
    return graph.neighbours(g.aggregates, top, 2, ["supports", "cites"])


@R.add("G5_expansion", f"WITH {GRAPH_SQL}, {_UND.replace('key FROM ag', 'key, type, weight FROM ag')}, top AS (SELECT slug FROM dg ORDER BY rank DESC, slug LIMIT 8) SELECT slug, other AS neighbour, type, weight FROM und SEMI JOIN top USING (slug)")
def g5(spark: SparkSession, d: str) -> DataFrame:
    """One hop over traversable edges from eight entities, as hits expand."""
    g, _ = folded(spark, d, write=True)
    return search.expand(fold_.degree(g.aggregates).orderBy(F.desc("rank"), "slug").limit(8), g.aggregates)


_LINKS = """mem AS (SELECT ag.key, bool_or(fa.status <> 'dismissed') AS live, count(*) FILTER (fa.status = 'proposed') AS pending, max(fa.strength) FILTER (fa.status = 'proposed') AS strongest FROM (SELECT key, unnest(assertion_ids) AS id FROM ag) ag JOIN fa ON fa.id = ag.id GROUP BY 1),
ln AS (SELECT ag.key, source, target, type, CASE WHEN traversable THEN 'confirmed' ELSE 'proposed' END AS kind, pending, strongest FROM ag JOIN mem ON mem.key = ag.key WHERE live
  UNION ALL SELECT id, source, target, type, 'untyped', CAST(status = 'proposed' AS BIGINT), CASE WHEN status = 'proposed' THEN 0 END FROM fa WHERE type IS NULL AND status <> 'dismissed')"""


def _links(spark: SparkSession, d: str) -> tuple[DataFrame, fold_.Graph]:
    g, _ = folded(spark, d, write=True)
    return views.links(g.assertions, g.aggregates, g.members), g


@R.add("P14_links_by_mode", f"WITH {GRAPH_SQL}, {_LINKS} SELECT 'confirmed' AS mode, key, kind FROM ln WHERE kind = 'confirmed' UNION ALL SELECT 'proposed', key, kind FROM ln WHERE pending > 0 UNION ALL SELECT 'all', key, kind FROM ln")
def p14(spark: SparkSession, d: str) -> DataFrame:
    """What each mode of the drawn graph shows."""
    drawn = materialize(_links(spark, d)[0], "links")
    one = lambda m: views.shown(drawn, m).select(F.lit(m).alias("mode"), "key", "kind")
    return one("confirmed").unionByName(one("proposed")).unionByName(one("all"))


@R.add("P15_visible_entities", f"WITH {GRAPH_SQL}, {_LINKS}, s AS (SELECT slug FROM en WHERE type NOT IN ('person', 'place')), b AS (SELECT source, target FROM ln WHERE pending > 0 AND source IN (SELECT slug FROM s) AND target IN (SELECT slug FROM s)) SELECT slug FROM s WHERE slug IN (SELECT source FROM b UNION SELECT target FROM b)")
def p15(spark: SparkSession, d: str) -> DataFrame:
    """Entities seen when two types are hidden and only what waits for review is shown."""
    drawn, g = _links(spark, d)
    return views.visible(g.entities, materialize(drawn, "links"), "proposed", ["person", "place"]).select("slug")


@R.add("R12_window_queue", f"WITH {GRAPH_SQL}, {_LINKS} SELECT key, kind = 'untyped' AS untyped, pending, strongest AS strength, row_number() OVER (ORDER BY strongest DESC NULLS LAST, kind = 'untyped', key) - 1 AS place FROM ln WHERE pending > 0")
def r12(spark: SparkSession, d: str) -> DataFrame:
    """What waits for review, edges and untyped items, strongest first."""
    drawn, _ = _links(spark, d)
    q = drawn.filter("pending > 0").select("key", (F.col("kind") == "untyped").alias("untyped"), "pending", F.col("strongest").alias("strength"))
    return global_index(q, [F.desc_nulls_last("strength"), "untyped", "key"], "window-queue").withColumnRenamed("row_index", "place")


_HALF = "(SELECT CAST(max(seq) / 2 AS BIGINT) FROM decisions)"


@R.add("G18_overlay", f"""WITH {GRAPH_SQL}, d1 AS (SELECT assertion, lower(trim(action)) AS action, seq FROM decisions WHERE lower(trim(action)) IN ('confirm', 'dismiss', 'reopen')),
o AS (SELECT assertion AS id, arg_max(action, seq) AS action FROM d1 WHERE seq > {_HALF} GROUP BY 1), b AS (SELECT assertion AS id, arg_max(action, seq) AS action FROM d1 WHERE seq <= {_HALF} GROUP BY 1),
x0 AS (SELECT f.id, f.supersedes, CASE b.action WHEN 'confirm' THEN 'confirmed' WHEN 'dismiss' THEN 'dismissed' ELSE 'proposed' END AS s FROM fc f LEFT JOIN b ON b.id = f.id),
x1 AS (SELECT id, supersedes, CASE WHEN id IN (SELECT supersedes FROM x0 WHERE s = 'confirmed' AND supersedes IS NOT NULL) THEN 'superseded' ELSE s END AS s FROM x0),
x2 AS (SELECT x1.id, supersedes, CASE WHEN s = 'superseded' OR o.action IS NULL THEN s WHEN o.action = 'confirm' THEN 'confirmed' WHEN o.action = 'dismiss' THEN 'dismissed' ELSE 'proposed' END AS s FROM x1 LEFT JOIN o ON o.id = x1.id)
SELECT 'claim' AS kind, id, CASE WHEN id IN (SELECT supersedes FROM x2 WHERE s = 'confirmed' AND supersedes IS NOT NULL) THEN 'superseded' ELSE s END AS status, NULL::BIGINT AS weight FROM x2 UNION ALL SELECT 'edge', key, CASE WHEN traversable THEN 'confirmed' ELSE 'proposed' END, weight FROM ag""")
def g18(spark: SparkSession, d: str) -> DataFrame:
    """The graph as exported after half of the log, with the later decisions laid over it: claims' status and edges' weight."""
    v = vault(spark, d)
    half = v["decisions"].agg((F.max("seq") / 2).cast("long").alias("half"))  # one row
    log = v["decisions"].join(F.broadcast(half))
    early, late = logfolds.statuses(log.filter("seq <= half")), logfolds.statuses(log.filter("seq > half"))
    order = v["notes"].select(F.col("id").alias("note_id"))
    a = fold_.fold_assertions(v["assertions"].join(order, "note_id", "left_semi"), early, v["adoptions"], v["merges"])
    c = fold_.fold_claims(v["claims"].join(order, "note_id", "left_semi"), early, v["merges"])
    edges = fold_.aggregate_edges(views.restatus(a, late), v["edge_types"])
    claims = views.supersede(views.restatus(c, late))
    none = F.lit(None).cast("long")
    return claims.select(F.lit("claim").alias("kind"), "id", "status", none.alias("weight")).unionByName(edges.select(F.lit("edge").alias("kind"), F.col("key").alias("id"), F.when(F.col("traversable"), "confirmed").otherwise("proposed").alias("status"), "weight"))


@R.add("G19_pruned", f"WITH {GRAPH_SQL}, lv AS (SELECT source AS slug FROM fa WHERE status <> 'dismissed' UNION SELECT target FROM fa WHERE status <> 'dismissed' UNION SELECT subject FROM fc WHERE status <> 'dismissed') SELECT slug FROM en WHERE slug IN (SELECT slug FROM lv WHERE slug IS NOT NULL) OR (declared AND slug NOT IN (SELECT slug FROM entities WHERE rank = 1))")
def g19(spark: SparkSession, d: str) -> DataFrame:
    """Entities that stay drawn when more of them are retired."""
    g, _ = folded(spark, d, write=True)
    return views.prune(g.entities, g.assertions, g.claims, table(spark, d, "entities").filter("rank = 1")).select("slug")


@R.add("A13_merge_preview", f"""WITH {GRAPH_SQL}, r AS (SELECT slug, count(*) AS n FROM (SELECT source AS slug FROM a0 UNION ALL SELECT target FROM a0 WHERE source <> target) GROUP BY 1), c AS (SELECT subject AS slug, count(*) AS n FROM c0 GROUP BY 1)
SELECT m1.duplicate, m1.canonical, coalesce(r.n, 0) AS relationships, coalesce(c.n, 0) AS claims FROM m1 LEFT JOIN r ON r.slug = m1.duplicate LEFT JOIN c ON c.slug = m1.duplicate""")
def a13(spark: SparkSession, d: str) -> DataFrame:
    """What names each merged duplicate."""
    v = vault(spark, d)
    return views.merge_preview(v["merges"], v["assertions"], v["claims"])


@R.add("F17_related_lines", f"WITH {GRAPH_SQL} SELECT DISTINCT slug, type || ' [[' || other || ']]' AS line FROM (SELECT source AS slug, type, target AS other FROM ag WHERE traversable UNION ALL SELECT target, type, source FROM ag WHERE traversable AND source <> target)")
def f17(spark: SparkSession, d: str) -> DataFrame:
    """The related lines of every entity's page."""
    return views.related_lines(folded(spark, d)[0].aggregates)


@R.add("F15_note_slugs", f"WITH t AS (SELECT doc_id, {_SLUG.format('title')} AS t FROM documents WHERE title IS NOT NULL), s AS (SELECT doc_id, t || '-' || t || '-' || t AS slug FROM t), c AS (SELECT *, slug[:80] AS cut, regexp_extract(slug[:80], '^(.*)-[^-]*$', 1) AS head FROM s) SELECT doc_id, CASE WHEN length(slug) <= 80 THEN slug ELSE rtrim(CASE WHEN head <> '' THEN head ELSE cut END, '-') END AS slug FROM c")
def f15(spark: SparkSession, d: str) -> DataFrame:
    """File slugs of titles said three times, cut at a word boundary."""
    t = S.slugify("title")
    return table(spark, d, "documents").filter("title is not null").select("doc_id", views.truncated_slug(F.concat_ws("-", t, t, t)).alias("slug"))


@R.add("P19_pair_labels", f"WITH {GRAPH_SQL}, n AS (SELECT source || '|' || coalesce(type, '(untyped: ' || coalesce(proposed_type, 'None') || ')') || '|' || target AS label FROM fa) SELECT label, CASE WHEN count(*) = 1 THEN '1 relationship' ELSE count(*) || ' relationships' END AS counted FROM n WHERE label IS NOT NULL GROUP BY 1")
def p19(spark: SparkSession, d: str) -> DataFrame:
    """How many relationships stand behind each pair and type, in words."""
    a = folded(spark, d)[0].assertions
    label = views.pair_label(F.col("source"), F.col("type"), F.col("proposed_type"), F.col("target"))
    return a.select(label.alias("label")).filter("label is not null").groupBy("label").agg(F.count("*").alias("n")).select("label", views.plural(F.col("n"), "relationship").alias("counted"))


_PAGES = f"pg AS (SELECT {_SLUG.format('title')} AS slug, arg_min(text, doc_id) AS text FROM documents WHERE kind = 'entity' AND title IS NOT NULL AND text IS NOT NULL GROUP BY 1)"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "documents").filter("kind = 'entity' and title is not null and text is not null")
    return o.select(S.slugify("title").alias("slug"), "doc_id", "text").groupBy("slug").agg(F.min_by("text", "doc_id").alias("text"))


@R.add("F21_endpoint_snippets", f"WITH {GRAPH_SQL}, {_PAGES} SELECT en.slug, coalesce(nullif({_line('pg.text', 200)}, ''), '(no description written yet)') AS snippet FROM en LEFT JOIN pg ON pg.slug = en.slug")
def f21(spark: SparkSession, d: str) -> DataFrame:
    """A line about each entity, from its page where it has one."""
    return views.endpoint_snippets(folded(spark, d)[0].entities, _pages(spark, d))


@R.add("J22_page_issues", f"WITH {GRAPH_SQL}, p AS (SELECT DISTINCT lower(trim(base)) AS slug FROM near_duplicates WHERE trim(base) <> '' UNION SELECT slug FROM entities), m AS (SELECT slug FROM p WHERE slug IN (SELECT duplicate FROM m1)) SELECT slug, 'merged' AS issue FROM m UNION ALL SELECT slug, 'retired' FROM p WHERE slug IN (SELECT slug FROM rt) AND slug NOT IN (SELECT slug FROM en) AND slug NOT IN (SELECT slug FROM m)")
def j22(spark: SparkSession, d: str) -> DataFrame:
    """Names whose pages stand for merged or retired entities."""
    g, v = folded(spark, d)
    names = table(spark, d, "near_duplicates").select(F.lower(F.trim("base")).alias("slug")).filter("slug <> ''").union(table(spark, d, "entities").select("slug"))
    gone = fold_.canonical(v["retired"].select("slug"), "slug", v["merges"]).distinct()
    return views.page_issues(names, v["merges"], gone, g.entities)


@R.add("J16_known_names", f"WITH {GRAPH_SQL} SELECT DISTINCT lower(trim(base)) AS slug FROM near_duplicates WHERE lower(trim(base)) IN (SELECT slug FROM en UNION SELECT source FROM fa UNION SELECT target FROM fa)")
def j16(spark: SparkSession, d: str) -> DataFrame:
    """Names that an entity or an assertion's end bears: a semi-join on a union."""
    g, _ = folded(spark, d, write=True)
    known = g.entities.select("slug").union(g.assertions.select(F.explode(F.array("source", "target")))).distinct()
    return table(spark, d, "near_duplicates").select(F.lower(F.trim("base")).alias("slug")).distinct().join(known, "slug", "left_semi")


@R.add("J24_unit_labels", f"WITH {_UNITS}, f AS (SELECT capture_id, {_line('arg_min(text, id)', 80)} AS title FROM tu WHERE text IS NOT NULL GROUP BY 1) SELECT tu.id, coalesce(f.title, tu.capture_id) || coalesce(' · ' || tu.locator, '') AS label FROM tu LEFT JOIN f ON f.capture_id = tu.capture_id")
def j24(spark: SparkSession, d: str) -> DataFrame:
    """What a unit is called: its capture's first line and its place."""
    u = _units(spark, d)
    first = u.filter("text is not null").groupBy("capture_id").agg(F.min_by("text", "id").alias("t")).select("capture_id", S.first_line("t", 80).alias("title"))
    return u.join(first, "capture_id", "left").select("id", F.concat(F.coalesce("title", "capture_id"), F.coalesce(F.concat(F.lit(" · "), "locator"), F.lit(""))).alias("label"))


@R.add("J14_unaliased_duplicates", f"""WITH {GRAPH_SQL}, s AS (SELECT DISTINCT slug FROM en), p AS (SELECT b.slug AS base, x.slug AS superset FROM s x JOIN s b ON length(b.slug) >= 4 AND length(b.slug) < length(x.slug) AND contains(x.slug, b.slug) AND regexp_extract_all(b.slug, '\\d+') = regexp_extract_all(x.slug, '\\d+')),
one AS (SELECT superset, min(base) AS base FROM p GROUP BY 1 HAVING count(*) = 1), al AS (SELECT lower(trim(base)) AS a, lower(trim(superset)) AS b FROM near_duplicates WHERE hash(1) IS NOT NULL AND length(trim(base)) % 2 = 0),
und AS (SELECT source AS slug, type, target AS other FROM ag UNION SELECT target, type, source FROM ag)
SELECT base, superset FROM one WHERE NOT EXISTS (SELECT 1 FROM al WHERE (al.a = one.base AND al.b = one.superset) OR (al.b = one.base AND al.a = one.superset)) AND NOT EXISTS (SELECT 1 FROM und x JOIN und y ON x.type = y.type AND x.other = y.other WHERE x.slug = one.base AND y.slug = one.superset)""".replace("hash(1) IS NOT NULL AND ", ""))
def j14(spark: SparkSession, d: str) -> DataFrame:
    """Near-duplicate slugs without pairs that were already kept apart (here: findings whose first name has an even length)."""
    g, _ = folded(spark, d, write=True)
    kept = table(spark, d, "near_duplicates").filter(F.length(F.trim("base")) % 2 == 0).select(F.lower(F.trim("base")).alias("a"), F.lower(F.trim("superset")).alias("b"))
    return graph.near_duplicates(g.entities, g.aggregates, kept)


@R.add("O6_vocabulary", f"WITH {GRAPH_SQL}, p AS (SELECT 'edge' AS kind, trim(regexp_replace(lower(proposed_type), '[^a-z0-9]+', '-', 'g'), '-') AS proposed FROM fa WHERE type IS NULL AND proposed_type IS NOT NULL) SELECT kind, proposed, count(*) AS count FROM p WHERE proposed NOT IN (SELECT proposed FROM ad) GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT {PAGES}")
def o6(spark: SparkSession, d: str) -> DataFrame:
    """The wordings asked for most, a page of the review queue."""
    g, v = folded(spark, d)
    return graph.proposals(g.assertions, v["adoptions"]).orderBy(F.desc("count"), "kind", "proposed").limit(PAGES).select("kind", "proposed", "count")


@R.add("O8_known_entities", f"WITH {GRAPH_SQL} SELECT slug, type, rank FROM en ORDER BY rank DESC, slug LIMIT 40")
def o8(spark: SparkSession, d: str) -> DataFrame:
    """The forty entities of highest rank, as an extractor is told of them."""
    return folded(spark, d)[0].entities.orderBy(F.desc("rank"), "slug").limit(40).select("slug", "type", "rank")


@R.add("O12_issues", f"""WITH {GRAPH_SQL}, i AS (SELECT * FROM inst WHERE note_id IN (SELECT id FROM n0)), f AS (SELECT 'conflicting_entity_type' AS kind, slug FROM i WHERE type IS NOT NULL GROUP BY slug HAVING count(DISTINCT type) > 1 UNION ALL SELECT 'reference_only_entity', slug FROM en WHERE slug NOT IN (SELECT slug FROM i)) SELECT kind, slug FROM f ORDER BY kind, slug LIMIT {PAGES}""")
def o12(spark: SparkSession, d: str) -> DataFrame:
    """The first page of findings in a fixed order."""
    g, v = folded(spark, d)
    inst = v["instances"].join(v["notes"].select(F.col("id").alias("note_id")), "note_id", "left_semi")
    types = [r[0] for r in table(spark, d, "entities").select("type").distinct().limit(1000).collect() if r[0]]  # the vocabulary
    return graph.type_findings(inst, g.entities, types).select("kind", "slug").orderBy("kind", "slug").limit(PAGES)


@R.add("P17_clustering_due", f"WITH {GRAPH_SQL} SELECT count(*) AS entities, count(*) >= 150 AS due FROM en")
def p17(spark: SparkSession, d: str) -> DataFrame:
    """Whether there are entities enough to cluster."""
    return folded(spark, d)[0].entities.agg(F.count("*").alias("entities"), (F.count("*") >= 150).alias("due"))


@R.add("V5_repaired", f"""WITH {GRAPH_SQL}, {_RULES}, j AS (SELECT fa.id, source, target, fa.type, nullif(s.type, 'unknown') AS st, nullif(t.type, 'unknown') AS tt, domain, range FROM fa LEFT JOIN rules r ON r.type = fa.type LEFT JOIN en s ON s.slug = fa.source LEFT JOIN en t ON t.slug = fa.target),
k AS (SELECT *, (st IS NULL OR domain IS NULL OR list_contains(domain, st)) AND (tt IS NULL OR range IS NULL OR list_contains(range, tt)) AS fwd, (tt IS NULL OR domain IS NULL OR list_contains(domain, tt)) AND (st IS NULL OR range IS NULL OR list_contains(range, st)) AS rev FROM j)
SELECT id, CASE WHEN NOT fwd AND rev THEN target ELSE source END AS source, CASE WHEN NOT fwd AND rev THEN source ELSE target END AS target, CASE WHEN fwd OR rev THEN type END AS type, NOT fwd AND rev AS direction_corrected, CASE WHEN NOT fwd AND NOT rev THEN 'domain_mismatch' END AS "drop" FROM k""")
def v5(spark: SparkSession, d: str) -> DataFrame:
    """Relationships with their direction or type put right."""
    g, _ = folded(spark, d, write=True)
    rules = spark.createDataFrame(RULES, "type string, domain array<string>, range array<string>")
    return views.repair_signatures(g.assertions.select("id", "source", "target", "type"), g.entities, rules).select("id", "source", "target", "type", "direction_corrected", "drop")


@R.add("V8_citations", f"WITH {GRAPH_SQL}, t AS (SELECT id, unnest(list_distinct(['e_' || source, 'e_' || target, id])) AS cited FROM fa WHERE source IS NOT NULL AND target IS NOT NULL AND regexp_full_match(source || target, '[A-Za-z0-9_-]*[A-Za-z0-9_]') AND regexp_full_match(source, '[A-Za-z0-9_-]*[A-Za-z0-9_]')) SELECT id, cited, cited IN (SELECT 'e_' || slug FROM en UNION ALL SELECT id FROM fa) AS known FROM t")
def v8(spark: SparkSession, d: str) -> DataFrame:
    """Ids cited in prose about each relationship, and whether they exist (V9)."""
    g, _ = folded(spark, d, write=True)
    well = F.col("source").rlike("^[A-Za-z0-9_-]*[A-Za-z0-9_]$") & F.col("target").rlike("^[A-Za-z0-9_-]*[A-Za-z0-9_]$")
    prose = F.concat(F.lit("They meet [Data: Entities (e_"), "source", F.lit(", e_"), "target", F.lit("); Assertions ("), "id", F.lit(", +more)]."))
    cited = g.assertions.filter(well).select("id", F.explode(S.cited_ids(prose)).alias("cited"))
    known = g.entities.select(F.concat(F.lit("e_"), "slug").alias("cited")).union(g.assertions.select("id")).distinct().withColumn("known", F.lit(True))
    return cited.join(known, "cited", "left").select("id", "cited", F.coalesce("known", F.lit(False)).alias("known"))


@R.add("R10_stale_pages", f"WITH {GRAPH_SQL}, {_HASHED} {_MERKLE}, cur AS (SELECT slug, 'sha256:' || sha256(string_agg(b, chr(10) ORDER BY part, bucket)) AS h FROM hb GROUP BY 1) SELECT slug FROM cur WHERE length(slug) % 3 = 0")
def r10(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose stored evidence hash is no longer the present one; here those of every third length were written before a change."""
    g, v = folded(spark, d, write=True)
    current = materialize(evidence_hashes(g, v["notes"]), "hashes")
    stored = current.select(F.col("slug").alias("_s"), F.when(F.length("slug") % 3 == 0, "sha256:before").otherwise(F.col("input_hash")).alias("_h"))
    return current.join(stored, (F.col("slug") == F.col("_s")) & ~F.col("input_hash").eqNullSafe(F.col("_h"))).select("slug")


_MATCH = """t AS (SELECT DISTINCT slug, nullif(trim(note_id), '') AS note_id FROM entity_sources),
r AS (SELECT DISTINCT id, nullif(trim(source), '') AS slug, nullif(trim(note_id), '') AS note_id FROM assertions),
hit AS (SELECT *, EXISTS (SELECT 1 FROM t WHERE t.slug = r.slug AND t.note_id = r.note_id) AS both_, r.slug IN (SELECT slug FROM t WHERE slug IS NOT NULL) AS by_slug, r.note_id IN (SELECT note_id FROM t WHERE note_id IS NOT NULL) AS by_note FROM r)"""


@R.add("p2_composite", f"""WITH {_MATCH} SELECT 'simple' AS match, id, slug, note_id FROM hit WHERE slug IS NOT NULL AND note_id IS NOT NULL AND NOT both_
UNION ALL SELECT 'full', id, slug, note_id FROM hit WHERE (slug IS NOT NULL OR note_id IS NOT NULL) AND NOT (slug IS NOT NULL AND note_id IS NOT NULL AND both_)
UNION ALL SELECT 'partial', id, slug, note_id FROM hit WHERE CASE WHEN slug IS NOT NULL AND note_id IS NOT NULL THEN NOT both_ WHEN slug IS NOT NULL THEN NOT by_slug WHEN note_id IS NOT NULL THEN NOT by_note ELSE false END""")
def p2_composite(spark: SparkSession, d: str) -> DataFrame:
    """Relationships whose pair of source and note is no pair of an entity and its note, under each match semantics; either half may be null."""
    given = lambda c: F.nullif(F.trim(c), F.lit(""))
    refs = table(spark, d, "assertions").select("id", given(F.col("source")).alias("slug"), given(F.col("note_id")).alias("note_id")).distinct()
    targets = table(spark, d, "entity_sources").select(F.col("slug").alias("t_slug"), given(F.col("note_id")).alias("t_note")).distinct()
    refs, targets = materialize(refs, "pairs"), materialize(targets, "target-pairs")
    parts = [references.orphans(refs, targets, {"slug": "t_slug", "note_id": "t_note"}, m).select(F.lit(m).alias("match"), "id", "slug", "note_id") for m in ("simple", "full", "partial")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
