"""Views over the folded graph and the vault's records: documents to search, filters of a drawn graph, overlays, lookups and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import scalars as S
from cairn.operators.graph import undirected
from cairn.operators.logfolds import status_of

NOTE_SLUG = 80
NO_DESCRIPTION = "(no description written yet)"


def note_texts(notes: DataFrame, assertions: DataFrame, claims: DataFrame) -> DataFrame:
    """id, body, text of each note: its body, its assertions' descriptions and its claims' texts, in the order of their ids, empty ones left out."""
    told = lambda df, c, name: df.groupBy(F.col("note_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("id").alias("i"), F.coalesce(c, F.lit("")).alias("t")))), lambda x: x["t"]), " ").alias(name))
    n = notes.select("id", "body").join(told(assertions, F.col("description"), "_a"), "id", "left").join(told(claims, F.col("text"), "_c"), "id", "left")
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    return n.select("id", "body", F.concat_ws("\n", filled("body"), filled("_a"), filled("_c")).alias("text"))


def documents(units: DataFrame, notes: DataFrame, others: DataFrame) -> DataFrame:
    """doc_id, kind, title, text of everything that is searched (P3, U3): a capture of one unit as itself, a longer one by its units, notes with
    what they claim, and ``others`` (doc_id, kind, title, text: entity pages, reports, files that no parser reads)."""
    n = units.groupBy("capture_id").agg(F.count("*").alias("_n"))
    u = units.join(n, "capture_id")
    one = F.col("_n") == 1
    title = F.when(one, S.first_line("text", 120)).otherwise(F.coalesce("locator", S.first_line("text", 120)))
    captures = u.select(F.when(one, F.col("capture_id")).otherwise(F.col("id")).alias("doc_id"), F.when(one, "capture").otherwise("unit").alias("kind"), title.alias("title"), "text")
    told = notes.select(F.col("id").alias("doc_id"), F.lit("note").alias("kind"), S.first_line("body", 120).alias("title"), "text")
    return captures.unionByName(told).unionByName(others.select("doc_id", "kind", "title", "text"))


def read(ids: DataFrame, tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """id, kind, text of the records with the ids asked (id; a few): each table by its key and its text column (P10). An unknown id has no row."""
    parts = [df.select(F.col(key).alias("id"), F.lit(kind).alias("kind"), F.col(text).alias("text")).join(F.broadcast(ids.select("id").distinct()), "id", "left_semi") for kind, (df, key, text) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def links(assertions: DataFrame, aggregates: DataFrame, members: DataFrame) -> DataFrame:
    """key, source, target, type, kind (confirmed, proposed, untyped), pending, strongest of what is drawn: aggregates with a live assertion, and live untyped assertions."""
    proposed = F.col("status") == "proposed"
    m = members.join(assertions.select("id", "status", "strength"), "id").groupBy("key").agg(F.bool_or(F.col("status") != "dismissed").alias("live"), F.count_if(proposed).alias("pending"), F.max(F.when(proposed, F.col("strength"))).alias("strongest"))
    typed = aggregates.join(m.filter("live"), "key").select("key", "source", "target", "type", F.when(F.col("traversable"), "confirmed").otherwise("proposed").alias("kind"), "pending", "strongest")
    bare = assertions.filter("type is null and status <> 'dismissed'")
    untyped = bare.select(F.col("id").alias("key"), "source", "target", "type", F.lit("untyped").alias("kind"), proposed.cast("long").alias("pending"), F.when(proposed, F.lit(0)).alias("strongest"))
    return typed.unionByName(untyped)


def shown(drawn: DataFrame, mode: str) -> DataFrame:
    """The links of a mode: all, confirmed or proposed."""
    return {"all": drawn, "confirmed": drawn.filter("kind = 'confirmed'"), "proposed": drawn.filter("pending > 0")}[mode]


def visible(entities: DataFrame, drawn: DataFrame, mode: str, hidden: list[str]) -> DataFrame:
    """The entities that are seen: of types not hidden, and in the mode ``proposed`` only ends of shown links between two such."""
    seen = entities.filter(~F.col("type").isin(hidden))
    if mode != "proposed":
        return seen
    own = seen.select("slug")
    both = shown(drawn, mode).join(own.withColumnRenamed("slug", "source"), "source", "left_semi").join(own.withColumnRenamed("slug", "target"), "target", "left_semi")
    return seen.join(both.select(F.explode(F.array("source", "target")).alias("slug")).distinct(), "slug", "left_semi")


def restatus(items: DataFrame, overlay: DataFrame) -> DataFrame:
    """Items with the status of a later decision (assertion, action) where there is one; what is superseded stays so."""
    o = overlay.select(F.col("assertion").alias("id"), "action")
    new = F.when((F.col("status") == "superseded") | F.col("action").isNull(), F.col("status")).otherwise(status_of(F.col("action")))
    return items.join(o, "id", "left").withColumn("status", new).drop("action")


def supersede(claims: DataFrame) -> DataFrame:
    """Claims that a confirmed one supersedes become superseded."""
    over = claims.filter("status = 'confirmed' and supersedes is not null").select(F.col("supersedes").alias("id")).distinct().withColumn("_over", F.lit(True))
    return claims.join(over, "id", "left").withColumn("status", F.when(F.col("_over"), "superseded").otherwise(F.col("status"))).drop("_over")


def prune(entities: DataFrame, assertions: DataFrame, claims: DataFrame, retired: DataFrame) -> DataFrame:
    """Entities that a live item mentions, and declared ones that are not retired."""
    live = assertions.filter("status <> 'dismissed'").select(F.explode(F.array("source", "target")).alias("slug")).unionByName(claims.filter("status <> 'dismissed'").select(F.col("subject").alias("slug"))).distinct()
    e = entities.join(live.withColumn("_live", F.lit(True)), "slug", "left").join(retired.select("slug").distinct().withColumn("_gone", F.lit(True)), "slug", "left")
    return e.filter(F.col("_live").isNotNull() | (F.col("declared") & F.col("_gone").isNull())).drop("_live", "_gone")


def merge_preview(merges: DataFrame, assertions: DataFrame, claims: DataFrame) -> DataFrame:
    """duplicate, canonical, relationships, claims that name the duplicate and would follow it."""
    ends = undirected(assertions.select("source", "target")).groupBy(F.col("slug").alias("duplicate")).agg(F.count("*").alias("relationships"))
    told = claims.groupBy(F.col("subject").alias("duplicate")).agg(F.count("*").alias("claims"))
    m = merges.join(ends, "duplicate", "left").join(told, "duplicate", "left")
    return m.select("duplicate", "canonical", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("relationships", "claims")))


def related_lines(aggregates: DataFrame) -> DataFrame:
    """slug, line: the type and the other end of each traversable edge, each line once."""
    e = undirected(aggregates.filter("traversable"))
    return e.select("slug", F.concat("type", F.lit(" [["), "other", F.lit("]]")).alias("line")).distinct()


def truncated_slug(c: Column | str, limit: int = NOTE_SLUG) -> Column:
    """A slug cut at a word boundary where there is one."""
    c = F.col(c) if isinstance(c, str) else c
    cut = F.substring(c, 1, limit)
    head = F.regexp_extract(cut, r"^(.*)-[^-]*$", 1)
    return F.when(F.length(c) <= limit, c).otherwise(F.regexp_replace(F.when(head != "", head).otherwise(cut), "-+$", ""))


def pair_label(source: Column, kind: Column, proposed: Column, target: Column) -> Column:
    """``source|type|target``, with the wording of an untyped one."""
    return F.concat(source, F.lit("|"), F.coalesce(kind, F.concat(F.lit("(untyped: "), F.coalesce(proposed, F.lit("None")), F.lit(")"))), F.lit("|"), target)


def plural(n: Column, noun: str) -> Column:
    """A count with its noun."""
    many = "entities" if noun == "entity" else noun + "s"
    return F.when(n == 1, f"1 {noun}").otherwise(F.concat(n.cast("string"), F.lit(f" {many}")))


def endpoint_snippets(entities: DataFrame, pages: DataFrame) -> DataFrame:
    """slug, snippet: the first line of the entity's page (slug, text; one for each slug), else a placeholder."""
    told = pages.select("slug", F.nullif(S.first_line("text", 200), F.lit("")).alias("_line"))
    return entities.select("slug").join(told, "slug", "left").select("slug", F.coalesce("_line", F.lit(NO_DESCRIPTION)).alias("snippet"))


def page_issues(pages: DataFrame, merges: DataFrame, retired: DataFrame, live: DataFrame) -> DataFrame:
    """slug, issue of pages (slug) whose entity was merged away, or is retired and nothing live keeps it."""
    p = pages.select("slug").distinct()
    gone = p.join(merges.select(F.col("duplicate").alias("slug")), "slug", "left_semi").withColumn("issue", F.lit("merged"))
    left = p.join(retired.select("slug"), "slug", "left_semi").join(live.select("slug"), "slug", "left_anti").join(gone.select("slug"), "slug", "left_anti")
    return gone.unionByName(left.withColumn("issue", F.lit("retired")))


def repair_signatures(assertions: DataFrame, entities: DataFrame, rules: DataFrame) -> DataFrame:
    """Assertions as the write boundary keeps them (V5): ends that fit only the other way round are swapped (``direction_corrected``); where neither
    way fits the type goes and ``drop`` says domain_mismatch; an end of unknown type never violates. rules: type, domain, range (null: any)."""
    t = entities.select("slug", F.nullif("type", F.lit("unknown")).alias("_t"))
    a = assertions.join(F.broadcast(rules), "type", "left")  # a rule for each edge type
    a = a.join(t.withColumnsRenamed({"slug": "source", "_t": "_s"}), "source", "left").join(t.withColumnsRenamed({"slug": "target", "_t": "_e"}), "target", "left")
    fits = lambda x, allowed: F.col(x).isNull() | F.col(allowed).isNull() | F.coalesce(F.array_contains(allowed, F.col(x)), F.lit(False))
    forward, backward = fits("_s", "domain") & fits("_e", "range"), fits("_e", "domain") & fits("_s", "range")
    swap, lost = ~forward & backward, ~forward & ~backward
    ends = {"source": F.when(swap, F.col("target")).otherwise(F.col("source")), "target": F.when(swap, F.col("source")).otherwise(F.col("target"))}
    out = a.withColumns({"_swap": swap, "_lost": lost}).withColumns({**ends, "type": F.when(~F.col("_lost"), F.col("type"))})
    return out.withColumns({"direction_corrected": F.col("_swap"), "drop": F.when(F.col("_lost"), "domain_mismatch")}).drop("_s", "_e", "_swap", "_lost", "domain", "range")
