"""Folds of append-only logs: the last line wins, by place in the log. Every fold is one aggregation with a partial phase."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What an action makes of the item's status.
STATUS = {"confirm": "confirmed", "dismiss": "dismissed", "reopen": "proposed"}


def last_by(log: DataFrame, keys: list[str], fields: list[str], seq: str = "seq") -> DataFrame:
    """The fields of the last line of each key."""
    return log.groupBy(*keys).agg(F.max_by(F.struct(*fields), seq).alias("_last")).select(*keys, *(F.col(f"_last.{f}").alias(f) for f in fields))


def statuses(log: DataFrame) -> DataFrame:
    """assertion, action after the last decision; unknown actions are left out, as they decide nothing."""
    return last_by(log.filter(F.col("action").isin(*STATUS)), ["assertion"], ["action"])


def status_of(action: F.Column) -> F.Column:
    out = F.lit("proposed")
    for a, s in STATUS.items():
        out = F.when(action == a, s).otherwise(out)
    return out


def dismissal_reasons(log: DataFrame) -> DataFrame:
    """assertion, reason where the last decision is a dismissal; a missing reason is empty."""
    last = last_by(log.filter(F.col("action").isin(*STATUS)), ["assertion"], ["action", "reason"])
    return last.filter("action = 'dismiss'").select("assertion", F.coalesce("reason", F.lit("")).alias("reason"))


def retired(log: DataFrame) -> DataFrame:
    """Slugs whose last action is retire."""
    return last_by(log.filter("action in ('retire', 'restore')"), ["slug"], ["action"]).filter("action = 'retire'").select("slug")


def adoptions(log: DataFrame) -> DataFrame:
    """kind, proposed, adopted of wordings whose last action is adopt."""
    return last_by(log.filter("action in ('adopt', 'revoke')"), ["kind", "proposed"], ["action", "adopted"]).filter("action = 'adopt'").select("kind", "proposed", "adopted")


def merges(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The merge map (duplicate, canonical) and the kept pairs (a, b).

    A duplicate maps to the canonical of its last merge unless it was unmerged later or the pair was kept later. A pair
    is kept if the last of its merge and keep events is keep; unmerge does not touch it.
    """
    pair = log.withColumn("a", F.least("duplicate", "canonical")).withColumn("b", F.greatest("duplicate", "canonical"))
    kept_at = pair.filter("action = 'keep'").groupBy("a", "b").agg(F.max("seq").alias("kept"))
    last_merge = last_by(log.filter("action = 'merge'").withColumn("at", F.col("seq")), ["duplicate"], ["canonical", "at"])
    undone = log.filter("action = 'unmerge'").groupBy("duplicate").agg(F.max("seq").alias("undone"))
    m = last_merge.join(undone, "duplicate", "left").filter("undone is null or undone < at")
    m = m.withColumn("a", F.least("duplicate", "canonical")).withColumn("b", F.greatest("duplicate", "canonical")).join(kept_at, ["a", "b"], "left")
    mapping = m.filter("kept is null or kept < at").select("duplicate", "canonical")
    kept = last_by(pair.filter("action in ('merge', 'keep')"), ["a", "b"], ["action"]).filter("action = 'keep'").select("a", "b")
    return mapping, kept


def pending(log: DataFrame) -> DataFrame:
    """Operations begun and not committed."""
    begun = log.filter("kind = 'op.begin'").select("op").distinct()
    return begun.join(log.filter("kind = 'op.commit'").select("op").distinct(), "op", "left_anti")


def flatten_merges(mapping: DataFrame) -> DataFrame:
    """duplicate, canonical at the end of each chain (G3); duplicates whose walk closes in a cycle are left out.

    Pointers are doubled, so a chain of length n takes log n joins and no task sees a whole chain. Every round ends the walk of
    some duplicate until only those on or into cycles are left, so the rounds stop when the number of open walks does.
    """
    from cairn.session import materialize

    first = materialize(mapping.filter("duplicate <> canonical").groupBy("duplicate").agg(F.min("canonical").alias("canonical")), "merges")
    inner = first.select(F.col("duplicate").alias("canonical"))
    cur, before = first, -1
    while True:
        n = cur.join(inner, "canonical", "left_semi").count()
        if n in (0, before):
            return cur.join(inner, "canonical", "left_anti").select("duplicate", "canonical")
        before = n
        nxt = cur.select(F.col("duplicate").alias("canonical"), F.col("canonical").alias("_next"))
        cur = materialize(cur.join(nxt, "canonical", "left").select("duplicate", F.coalesce("_next", "canonical").alias("canonical")), "merges")


def log_positions(lines: DataFrame, by: str = "path") -> DataFrame:
    """Place of each line in its file, from 0."""
    return lines.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy("seq")) - 1)
