"""Retrieval: BM25, brute-force cosine, reciprocal-rank fusion, the evidence gate, and expansion over the graph."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.scalars import fold_accents, snippet
from cairn.operators.graph import undirected
from cairn.session import discard, materialize, new_path, partitions

K1, B, DEPTH, RRF, RESULTS = 1.2, 0.75, 40, 60, 8
BM25_FLOOR, COSINE_FLOOR = 2.0, 0.35


def terms_of(query: str) -> list[str]:
    """The ASCII words of a query, duplicates kept (F8)."""
    return re.findall(r"[a-z0-9]+", query.lower())


def tokens(*columns: str) -> F.Column:
    """Index tokens of text columns: case and accents folded, ASCII words."""
    joined = F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in columns))
    return F.regexp_extract_all(fold_accents(F.lower(joined)), F.lit(r"([a-z0-9]+)"), F.lit(1))


def _equals(word: str):
    return lambda x: x == word


def bm25(docs: DataFrame, query: str, text: list[str], keep: list[str]) -> DataFrame:
    """``keep`` and bm25 of the documents that hold a term; statistics over all documents, whatever their kind (A15, App. A.1).

    One scan of the corpus counts the query's terms and the length of every document into a narrow table; one row of
    statistics (a document frequency for each term) and the scores come from that. No postings are shuffled. Ask kinds
    after this, as the statistics don't depend on them.
    """
    asked = terms_of(query)
    distinct = list(dict.fromkeys(asked))
    base = docs.select(*keep, tokens(*text).alias("_t"))
    tf = [F.size(F.filter("_t", _equals(w))).alias(f"_f{i}") for i, w in enumerate(distinct)]
    base = materialize(base.select(*keep, F.size("_t").alias("_len"), *tf), "term-counts")
    stats = base.agg(F.count("*").alias("n"), F.avg("_len").alias("avg"), *(F.count_if(F.col(f"_f{i}") > 0).alias(f"d{i}") for i in range(len(distinct)))).first()
    score = F.lit(0.0)
    for w in asked:
        i = distinct.index(w)
        df = stats[f"d{i}"]
        idf = float(np.log((stats["n"] - df + 0.5) / (df + 0.5)))
        idf = idf if idf > 0 else 1e-6
        f = F.col(f"_f{i}").cast("double")
        score = score + F.lit(idf) * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("_len") / F.lit(stats["avg"] or 1.0)))
    hit = F.lit(False)
    for i in range(len(distinct)):
        hit = hit | (F.col(f"_f{i}") > 0)
    return base.filter(hit).select(*keep, F.greatest(score, F.lit(0.0)).alias("bm25"))


def lexical(docs: DataFrame, query: str, kinds: list[str] | None = None, limit: int = DEPTH) -> DataFrame:
    """The best ``limit`` documents (doc_id, kind, bm25) by BM25 over title and text, ties by id (R1, O1). No ASCII term: no candidates."""
    found = bm25(docs, query, ["title", "text"], ["doc_id", "kind"])
    if kinds is not None:
        found = found.filter(F.col("kind").isin(kinds))
    return found.orderBy(F.desc("bm25"), "doc_id").limit(limit)


class Index:
    """Postings on disk (R1, A15): (term, doc_id, kind, tf, len) in ``buckets`` folders by the term's hash, and one row of corpus statistics.

    Built in one pass; a query reads only the folders of its terms, so its cost follows their postings and not the corpus. A common term is
    split over files like any large folder. Documents of null title and text count in the statistics with no terms.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root or new_path(spark, "index"), buckets

    def build(self, docs: DataFrame) -> Index:
        base = materialize(docs.select("doc_id", "kind", tokens("title", "text").alias("_t")).withColumn("len", F.size("_t")), "index-tokens")
        posted = base.select("doc_id", "kind", "len", F.explode("_t").alias("term")).groupBy("term", "doc_id", "kind", "len").agg(F.count("*").alias("tf"))
        posted = posted.withColumn("bucket", F.pmod(F.crc32("term"), F.lit(self.buckets)).cast("int"))
        posted.repartition(partitions(self.spark), "bucket", F.pmod(F.xxhash64("doc_id"), F.lit(4))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{self.root}/postings")
        base.agg(F.count("*").alias("n"), F.avg("len").alias("avg")).write.parquet(f"{self.root}/statistics")
        discard(base)
        return self

    def postings(self, terms: list[str]) -> DataFrame:
        """The postings of some terms: the folders are pruned by hash."""
        buckets = sorted({zlib.crc32(t.encode()) % self.buckets for t in terms})
        return self.spark.read.schema("term string, doc_id long, kind string, tf long, len int, bucket int").parquet(f"{self.root}/postings").filter(F.col("bucket").isin(buckets) & F.col("term").isin(terms))

    def lexical(self, query: str, kinds: list[str] | None = None, limit: int = DEPTH) -> DataFrame:
        """As ``lexical``, from the postings."""
        asked = Counter(terms_of(query))
        if not asked:
            return self.spark.createDataFrame([], "doc_id long, kind string, bm25 double")
        p = self.postings(sorted(asked))
        stats = self.spark.read.parquet(f"{self.root}/statistics")  # one row
        idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        df = p.groupBy("term").agg(F.count("*").alias("df"))  # a row for each term asked
        times = F.create_map(*(F.lit(x) for pair in asked.items() for x in pair))[F.col("term")]
        weight = df.join(F.broadcast(stats)).select("term", "avg", (F.when(idf > 0, idf).otherwise(1e-6) * times).alias("w"))
        tf = F.col("tf").cast("double")
        part = F.col("w") * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("len") / F.greatest("avg", F.lit(1e-9))))
        found = p.join(F.broadcast(weight), "term").groupBy("doc_id", "kind").agg(F.greatest(F.sum(part), F.lit(0.0)).alias("bm25"))
        found = found if kinds is None else found.filter(F.col("kind").isin(kinds))
        return found.orderBy(F.desc("bm25"), "doc_id").limit(limit)


def cosine(vectors: DataFrame, query: list[float], key: str = "vec_id") -> DataFrame:
    """``key`` and the cosine of every vector with the query (F7): one matrix product for each Arrow batch. Null vectors are left out, zero vectors have 0."""
    q = np.asarray(query, np.float64)
    q = q / max(np.linalg.norm(q), 1e-300)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            m = b.column(1).flatten().to_numpy().astype(np.float64).reshape(b.num_rows, len(q)) if b.num_rows else np.zeros((0, len(q)))
            norm = np.linalg.norm(m, axis=1)
            c = np.divide(m @ q, norm, out=np.zeros(len(m)), where=norm > 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c)], names=[key, "cosine"])

    v = vectors.filter(F.size("embedding") == len(q)).select(key, "embedding")
    return v.mapInArrow(run, f"{key} {v.schema[key].dataType.simpleString()}, cosine double")


def nearest(vectors: DataFrame, query: list[float], limit: int = DEPTH, key: str = "vec_id") -> DataFrame:
    """The nearest ``limit`` vectors, ties by id (R2, O2)."""
    return cosine(vectors, query, key).orderBy(F.desc("cosine"), key).limit(limit)


def fuse(rankings: list[tuple[DataFrame, str]], key: str = "doc_id") -> DataFrame:
    """Reciprocal-rank fusion (R3, J8): each ranking is (frame, score column), of at most DEPTH rows; the sum of 1 / (60 + rank)."""
    parts = None
    for df, score in rankings:
        r = df.select(key, (F.lit(1.0) / (RRF + F.row_number().over(Window.orderBy(F.desc(score), key)))).alias("_r"))  # a ranking has DEPTH rows
        parts = r if parts is None else parts.unionByName(r)
    return parts.groupBy(key).agg(F.sum("_r").alias("score"))


def local_search(docs: DataFrame, vectors: DataFrame, query: str, vector: list[float], k: int = RESULTS, kinds: list[str] | None = None) -> DataFrame:
    """doc_id, kind, title, snippet, bm25, cosine, score, evident of the k best (R4). ``evident`` is the gate's verdict over the k hits."""
    lex = lexical(docs, query, kinds)
    vec = nearest(vectors, vector, key="doc_id")
    best = fuse([(lex, "bm25"), (vec, "cosine")]).orderBy(F.desc("score"), "doc_id").limit(k)
    meta = docs.select("doc_id", "kind", "title", snippet("text").alias("snippet"))
    hits = meta.join(F.broadcast(best), "doc_id").join(F.broadcast(lex.select("doc_id", "bm25")), "doc_id", "left").join(F.broadcast(vec), "doc_id", "left")  # k and DEPTH rows
    return gate(hits)


def gate(hits: DataFrame, bm25_floor: float = BM25_FLOOR, cosine_floor: float = COSINE_FLOOR) -> DataFrame:
    """``evident``: whether any of the k hits passes a floor."""
    passes = (F.col("bm25") >= bm25_floor) | (F.col("cosine") >= cosine_floor)
    return hits.withColumn("evident", F.max(F.coalesce(passes, F.lit(False))).over(Window.partitionBy(F.lit(1))))  # k rows


def shown(hits: DataFrame) -> DataFrame:
    """The hits of ``local_search`` that are given: all of them if any passes a floor, else none."""
    return hits.filter("evident")


def signals(hits: DataFrame, bm25_floor: float = BM25_FLOOR, cosine_floor: float = COSINE_FLOOR) -> DataFrame:
    """One row about the hits (A14): how many, their greatest scores, and the note that goes with an abstention."""
    best = hits.agg(F.count("*").alias("hits"), F.max("bm25").alias("max_bm25"), F.max("cosine").alias("max_cosine"))
    evident = F.coalesce(F.col("max_bm25") >= bm25_floor, F.lit(False)) | F.coalesce(F.col("max_cosine") >= cosine_floor, F.lit(False))
    return best.withColumn("evident", evident).withColumn("note", F.when(~evident, "no evidence above the floors"))


def expand(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """One hop over traversable edges from entity hits (slug): slug, neighbour, type, weight."""
    return undirected(edges.filter("traversable")).join(hits.select("slug").distinct(), "slug").select("slug", F.col("other").alias("neighbour"), "type", "weight")


def global_search(reports: DataFrame, communities: DataFrame, query: str) -> DataFrame:
    """Community reports by relevance, then impact, then id; communities without a report come with state missing."""
    rel = fuse([(lexical(reports.select(F.col("lineage_id").alias("doc_id"), F.lit("report").alias("kind"), "title", F.col("summary").alias("text")), query), "bm25")])
    r = communities.join(reports, "lineage_id", "left").join(F.broadcast(rel.withColumnRenamed("doc_id", "lineage_id")), "lineage_id", "left")
    state = F.when(F.col("title").isNull(), "missing").when(F.col("stale"), "stale").otherwise("present")
    return r.select("lineage_id", "title", state.alias("state"), (F.coalesce("score", F.lit(0.0)) + F.lit(1e-6) * F.coalesce("rank", F.lit(0.0))).alias("relevance")).orderBy(F.desc("relevance"), "lineage_id")
