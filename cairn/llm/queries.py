"""Queries of the llm operators and the SQL that says the same, where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm import chunking, components, fusion, markup, packing, tokenizing, toxicity
from cairn.plans.common import Registry, table

R = Registry()
SCORES = ["bm25", "cosine", "score"]

_HITS = """
WITH h AS (
  SELECT DISTINCT query_id, doc_id, CASE WHEN isnan(bm25) THEN NULL ELSE bm25 END AS bm25, CASE WHEN isnan(cosine) THEN NULL ELSE cosine END AS cosine,
    CASE WHEN isnan(score) THEN NULL ELSE score END AS score FROM hits),
c AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM h),
"""


@R.add(
    "p5_found",
    _HITS
    + """
p AS (SELECT query_id, doc_id,
    CASE WHEN bm25 IS NULL THEN n ELSE rank() OVER (PARTITION BY query_id ORDER BY bm25 DESC NULLS LAST) END
  + CASE WHEN cosine IS NULL THEN n ELSE rank() OVER (PARTITION BY query_id ORDER BY cosine DESC NULLS LAST) END
  + CASE WHEN score IS NULL THEN n ELSE rank() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST) END AS places FROM c)
SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY places, doc_id) AS rn FROM p) WHERE rn = 1""",
)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The hit of each query that stands best when the three scores have equal say."""
    return fusion.best(fusion.borda(table(spark, d, "hits"), "query_id", "doc_id", SCORES, ties="min", missing="last"), "query_id", "doc_id")


_AVG = "CASE WHEN {0} IS NULL THEN (n + 1) / 2.0 ELSE rank() OVER (PARTITION BY query_id ORDER BY {0} DESC NULLS LAST) + (count(*) OVER (PARTITION BY query_id, {0}) - 1) / 2.0 END"


@R.add("p5_ranking", _HITS + f"p AS (SELECT query_id, doc_id, n, {', '.join(_AVG.format(s) + f' AS p{i}' for i, s in enumerate(SCORES))} FROM c) SELECT query_id, doc_id, CAST(3 * n - p0 - p1 - p2 AS DOUBLE) AS points, row_number() OVER (PARTITION BY query_id ORDER BY 3 * n - p0 - p1 - p2 DESC, doc_id) AS rank FROM p")
def p5_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Borda points of every hit, averaged ties, missing scores in the middle; and its rank in its query, of equal points by doc_id."""
    points = fusion.borda(table(spark, d, "hits"), "query_id", "doc_id", SCORES)
    return fusion.ranked(points, "query_id", "doc_id").select("query_id", "doc_id", "points", "rank")


_GROUPS = """
WITH RECURSIVE raw AS (
  SELECT lower(trim(base)) AS a, lower(trim(superset)) AS b FROM near_duplicates
  UNION ALL SELECT lower(trim(slug)), lower(trim(m)) FROM (SELECT slug, unnest(merged_from) AS m FROM entities)),
link AS (SELECT DISTINCT a, b FROM raw WHERE a <> '' AND b <> '' AND a <> b),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(slug, r) AS (SELECT a, a FROM edge UNION SELECT e.b, reach.r FROM reach JOIN edge e ON e.a = reach.slug WHERE e.b > reach.r),
low AS (SELECT slug, min(r) AS m FROM reach GROUP BY slug),
walk(slug, r) AS (SELECT slug, m FROM low UNION SELECT e.b, walk.r FROM walk JOIN edge e ON e.a = walk.slug)
SELECT min(r) AS group_slug, slug FROM walk GROUP BY slug HAVING min(r) < slug
"""


@R.add("p6_found", _GROUPS)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Every slug of a group with the group's smallest slug, the smallest itself left out."""
    links = components.slug_links(table(spark, d, "near_duplicates"), table(spark, d, "entities"))
    return components.components(links).filter(F.col("group") < F.col("vertex")).select(F.col("group").alias("group_slug"), F.col("vertex").alias("slug"))


@R.add("p7_ids")
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every document by byte_bpe_50k, without special tokens."""
    return tokenizing.encode(table(spark, d, "documents"), "doc_id", "text")


@R.add("p4_found", r"""
SELECT id, CAST(max(CASE WHEN list_max(list_transform(regexp_extract_all(text, '[^\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B\x1C-\x1F。！？]+'), lambda x: length(x))) > 1200 THEN 1 ELSE 0 END) AS BIGINT) AS forced
FROM text_units WHERE length(text) > 1200 GROUP BY id""")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Units that had to be cut, and whether some cut could not fall on a natural boundary."""
    pieces = chunking.oversized_pieces(table(spark, d, "text_units"))
    return pieces.filter("piece = 1").select("id", F.col("forced").cast("long").alias("forced"))


@R.add("p4_pieces")
def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every oversized unit, with their positions and the unit's locator."""
    return chunking.oversized_pieces(table(spark, d, "text_units"))


@R.add("p4_audit", r"""
SELECT id, max(length(text)) AS chars, true AS covered, true AS within, true AS shares,
  max(CASE WHEN list_max(list_transform(regexp_extract_all(text, '[^\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B\x1C-\x1F。！？]+'), lambda x: length(x))) > 1200 THEN 1 ELSE 0 END) = 1 AS hard
FROM text_units WHERE length(text) > 1200 GROUP BY id""")
def p4_audit(spark: SparkSession, d: str) -> DataFrame:
    """What holds of each oversized unit's pieces: they cover its text without a gap and end in order, none is over the limit, neighbours
    share at most the overlap and table rows nothing, and a cut is hard only where the text has too long a run."""
    pieces = chunking.shared_ends(chunking.oversized_pieces(table(spark, d, "text_units")))
    w = Window.partitionBy("id").orderBy("piece")  # the pieces of one unit
    pieces = pieces.withColumn("_before", F.lag("end").over(w))
    fits = F.col("_before").isNull() & (F.col("start") == 0) | (F.col("start") <= F.col("_before")) & (F.col("end") > F.col("_before"))
    exact = (F.length("text") == F.col("end") - F.col("start")) & (F.length("text") <= chunking.LIMIT)
    return pieces.groupBy("id").agg(F.max("end").alias("chars"), F.bool_and(fits).alias("covered"), F.bool_and(exact).alias("within"), F.bool_and(F.col("shared").between(0, chunking.OVERLAP)).alias("shares"), F.bool_or(F.col("cut") == "hard").alias("hard"))


def _packed(spark: SparkSession, d: str) -> tuple[DataFrame, packing.Plan]:
    sizes = tokenizing.count_tokens(table(spark, d, "documents"), "doc_id", "text")
    return packing.pack(sizes, "doc_id", "n_tokens")


@R.add("p8_pack")
def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    """Every document's pieces, their tokens and the container of 2,048 tokens that each goes into."""
    return _packed(spark, d)[0]


@R.add("p8_report")
def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers used, tokens in them, how full they are, and the program beside its bound and a heuristic."""
    return packing.container_report(*_packed(spark, d))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return toxicity.score(documents, toxicity.fit_on(documents, table(spark, d, "labels")))


@R.add("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with abusive, hateful or sexual content, by the classifier and the threshold of their language."""
    return _scored(spark, d).filter("flagged").select("doc_id")


@R.add("p9_scores")
def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of every document."""
    return _scored(spark, d)


@R.add("p9_rates")
def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """Documents, flagged ones and their rate per source."""
    return toxicity.rates(_scored(spark, d))


@R.add("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Blocks whose text holds residue of markup."""
    return markup.clean(table(spark, d, "blocks")).filter("residue and part = 0").select("block_id")


@R.add("p3_clean")
def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    """The parts of every block without markup, with their kind and level."""
    return markup.clean(table(spark, d, "blocks"))
