"""Commands in bulk: what asks to change the logs is a table of requests, each of which is accepted or refused with the first reason against it.

The reference state is read by joins, so a request costs a row and not a look-up. Accepted requests become rows of the log that the fold
reads; refusals stay as rows with their reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.scalars import strip
from cairn.operators.validate import STRENGTH, _first, _slug


def _known(df: DataFrame, key: str, names: DataFrame, flag: str) -> DataFrame:
    """``flag`` tells whether ``key`` is among ``names`` (one column)."""
    n = names.select(F.col(names.columns[0]).alias("_n")).distinct().withColumn(flag, F.lit(True))
    return df.join(n, F.col(key) == F.col("_n"), "left").drop("_n").withColumn(flag, F.coalesce(flag, F.lit(False)))


def resolve(requests: DataFrame, ids: DataFrame) -> DataFrame:
    """requests (id, action) -> refusal: only dismiss and reopen are open to an assistant, confirming needs a person, and the item must exist."""
    reason = _first((F.col("action") == "confirm", "needs_a_person"), (F.col("action").isNull() | ~F.col("action").isin("dismiss", "reopen"), "bad_action"), (~F.col("_there"), "no_such_item"))
    return _known(requests, "id", ids, "_there").withColumn("refusal", reason).drop("_there")


def merge(requests: DataFrame, entities: DataFrame, merges: DataFrame) -> DataFrame:
    """requests (duplicate, canonical) as slugs -> refusal. Names must be entities or merged already; a merge into one's own duplicate is a cycle.

    ``merges`` is flat (its canonical ends are no duplicates), so a cycle shows as the canonical's end being the duplicate's own.
    """
    names = entities.select("slug").union(merges.select("duplicate"))
    r = requests.withColumns({"duplicate": _slug("duplicate"), "canonical": _slug("canonical")})
    r = _known(_known(r, "duplicate", names, "_d"), "canonical", names, "_c")
    end = merges.select(F.col("duplicate").alias("_from"), F.col("canonical").alias("_end"))
    r = r.join(end, F.col("canonical") == F.col("_from"), "left")
    empty = lambda c: F.col(c).isNull() | (F.col(c) == "")
    reason = _first((empty("duplicate") | empty("canonical"), "empty_slug"), (F.col("duplicate") == F.col("canonical"), "same_entity"), (~F.col("_d") | ~F.col("_c"), "no_such_entity"), (F.coalesce(F.col("_end") == F.col("duplicate"), F.lit(False)), "cycle"))
    return r.withColumn("refusal", reason).drop("_d", "_c", "_from", "_end")


def retire(requests: DataFrame, entities: DataFrame, live: DataFrame) -> DataFrame:
    """requests (slug) -> refusal, blockers: an entity with live items (slug, kind, status, n) is kept until they are decided."""
    r = _known(requests, "slug", entities.select("slug"), "_there")
    b = live.groupBy(F.col("slug").alias("_s")).agg(F.sum("n").alias("blockers"))
    r = r.join(b, F.col("slug") == F.col("_s"), "left").withColumn("blockers", F.coalesce("blockers", F.lit(0)).cast("long"))
    return r.withColumn("refusal", _first((~F.col("_there"), "no_such_entity"), (F.col("blockers") > 0, "live_items"))).drop("_there", "_s")


def propose(requests: DataFrame, types: list[str]) -> DataFrame:
    """requests (source, target, type, description, strength) -> refusal, and type / proposed_type: an unknown type is kept as a wording."""
    known = F.col("type").isin(types)
    strength: Column = F.coalesce("strength", F.lit(5))
    r = requests.withColumns({"source": F.coalesce(_slug("source"), F.lit("")), "target": F.coalesce(_slug("target"), F.lit(""))})
    reason = _first((~strength.between(*STRENGTH), "bad_strength"), (F.col("description").isNull() | (strip("description") == ""), "no_rationale"), ((F.col("source") == "") | (F.col("target") == ""), "empty_slug"), (F.col("source") == F.col("target"), "same_entity"))
    return r.withColumns({"refusal": reason, "proposed_type": F.when(~known, F.col("type")), "type": F.when(known, F.col("type"))})


def capture(texts: DataFrame, captured: DataFrame) -> DataFrame:
    """texts (id, text) -> refusal and hash: a blank one, one whose content is captured already (hash), or a repeat of a smaller id among the texts."""
    t = texts.withColumn("hash", F.concat(F.lit("sha256:"), F.sha2("text", 256)))
    first = t.filter("hash is not null").groupBy(F.col("hash").alias("_h")).agg(F.min("id").alias("_first"))
    t = _known(t, "hash", captured.select("hash"), "_there").join(first, F.col("hash") == F.col("_h"), "left")
    blank = F.col("text").isNull() | (strip("text") == "")
    return t.withColumn("refusal", _first((blank, "empty"), (F.col("_there"), "captured"), (F.coalesce(F.col("id") > F.col("_first"), F.lit(False)), "repeated"))).drop("_there", "_h", "_first")
