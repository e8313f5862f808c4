"""Row-level rules at write time (V1-V8): one CASE gives the first reason against an item, in a fixed order; the rest is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.scalars import is_valid_date, strip

MAX_WORDS, STRENGTH = 6, (1, 10)


def _first(*rules: tuple[Column, str]) -> Column:
    out = F.lit(None).cast("string")
    for bad, reason in reversed(rules):
        out = F.when(bad, reason).otherwise(out)
    return out


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (strip(c) == "")


def _slug(c: str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def _foreign(units: str, allowed: str) -> Column:
    """Some cited unit isn't among the note's own (V4); null lists cite nothing."""
    return F.size(F.array_except(F.coalesce(units, F.array().cast("array<string>")), F.coalesce(allowed, F.array().cast("array<string>")))) > 0


def entities(items: DataFrame, types: list[str]) -> DataFrame:
    """name, type, text_unit_ids, allowed -> reason, and type / proposed_type where the type isn't configured (V1)."""
    words = F.size(F.split(strip("name"), r"\s+"))
    reason = _first((_blank("name"), "missing_field"), (words > MAX_WORDS, "not_an_entity_name"), (_slug("name") == "", "empty_slug"), (_foreign("text_unit_ids", "allowed"), "unknown_text_unit"))
    known = F.col("type").isin(types)
    return items.withColumn("reason", reason).withColumns({"proposed_type": F.when(~known, F.col("type")), "type": F.when(known, F.col("type"))})


def relationships(items: DataFrame) -> DataFrame:
    """source, target, strength, and foreign (whether some cited unit isn't the note's own, V4) or text_unit_ids and allowed -> reason (V2). A missing strength counts as 5."""
    strength = F.coalesce("strength", F.lit(5))
    reason = _first(
        (_blank("source") | _blank("target"), "missing_field"), (~strength.between(*STRENGTH), "bad_strength"), ((_slug("source") == "") | (_slug("target") == ""), "empty_slug"), (_slug("source") == _slug("target"), "self_loop"), (F.coalesce("foreign", F.lit(False)) if "foreign" in items.columns else _foreign("text_unit_ids", "allowed"), "unknown_text_unit")
    )
    return items.withColumn("strength", strength).withColumn("reason", reason)


def claims(items: DataFrame, known: DataFrame) -> DataFrame:
    """subject, text, valid_from, valid_to, supersedes -> reason (V3); the last rule is a left join to the ids that exist."""
    ids = known.select(F.col("id").alias("supersedes")).distinct().withColumn("_known", F.lit(True))
    c = items.join(ids, "supersedes", "left")
    n = F.least(F.length("valid_from"), F.length("valid_to"))
    upside = (F.col("valid_to") != "unknown") & (F.substring("valid_from", F.lit(1), n) > F.substring("valid_to", F.lit(1), n))
    bad = lambda x: F.coalesce(~is_valid_date(x), F.lit(False))
    reason = _first(
        (F.col("subject").isNull() | F.col("text").isNull(), "missing_field"),
        (strip("text") == "", "empty_text"),
        (_slug("subject") == "", "empty_slug"),
        (bad("valid_from"), "bad_validity"),
        (bad("valid_to") & (F.col("valid_to") != "unknown"), "bad_validity"),
        (F.coalesce(upside, F.lit(False)), "bad_validity"),
        (F.col("supersedes").isNotNull() & F.col("_known").isNull(), "unknown_supersedes"),
    )
    return c.withColumn("reason", reason).drop("_known")


def ledger(checked: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """The items kept, and the drops by reason with an example."""
    drops = checked.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"), F.min("id").alias("example")).select(F.lit(kind).alias("kind"), "reason", "n", "example")
    return checked.filter("reason is null").drop("reason"), drops
