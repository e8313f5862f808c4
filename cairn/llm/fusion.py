"""One ranking from several differently-scaled scores (problem 5): a Borda count.

Every score ranks the items of a group by competition; an item's points for a score are the number of items it beats, and
the weighted points are summed, so the numbers' size never counts. Two ways give the same places:

* groups of ordinary size: one shuffle by group, then window functions;
* groups above ``hot_rows``: no task sees the group. Rows are counted per (group, score, value), these counts are
  range-partitioned and summed per partition, and the partitions' totals give what lies before each. The places are
  joined back by value.

Both are exact, so the bound only chooses the plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import global_index, materialize, partitions


def _value(c: str) -> Column:
    """The score, or null where it is null or NaN; -0.0 is 0.0."""
    v = F.col(c).cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v), v + F.lit(0.0))


def _place(higher: Column, tied: Column, scored: Column, n: Column, ties: str, missing: str) -> Column:
    """Place from the number of higher and of equal scores; null scores by ``missing``."""
    own = higher + 1 if ties == "min" else higher + (tied + 1) / 2
    absent = n.cast("double") if missing == "last" else (n + 1) / 2
    return F.when(scored, own.cast("double")).otherwise(absent)


def borda_places(hits: DataFrame, group: str, item: str, scores: list[str], ties: str = "average", missing: str = "mid", hot_rows: int = 1_000_000) -> DataFrame:
    """Distinct (group, item, scores) with ``n``, the hits of the group, and ``place_<score>``.

    Exact repeats count once. ``ties``: average (mean of the tied places) or min (one more than the number of higher
    scores). ``missing``: mid (the middle of the group) or last (the number of hits). Nulls and NaN are missing; a null
    group or item is a group or item of its own. Columns beyond the named ones are left out. No rows give no rows.
    """
    if ties not in ("average", "min") or missing not in ("mid", "last"):
        raise ValueError("ties: average or min; missing: mid or last")
    own = [F.col(group).alias("_group"), F.col(item).alias("_item"), *(_value(s).alias(f"_s{i}") for i, s in enumerate(scores))]
    crowded = hits.groupBy(group).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows).select(F.col(group).alias("_of"))
    rows = hits.select(*own).distinct()
    if crowded.isEmpty():  # repeats counted, so no group can be hot
        cold, hot = rows, None
    else:
        sizes = rows.groupBy(F.col("_group").alias("_of")).agg(F.count("*").alias("_n"))
        hot = sizes.filter(F.col("_n") > hot_rows)
        cold = rows.join(hot, F.col("_group").eqNullSafe(F.col("_of")), "left_anti")
    by = Window.partitionBy("_group")
    cold = cold.withColumn("_n", F.count("*").over(by))
    for i in range(len(scores)):
        s = F.col(f"_s{i}")
        at = Window.partitionBy("_group").orderBy(s.desc_nulls_last())
        tied = F.count("*").over(Window.partitionBy("_group", s))
        cold = cold.withColumn(f"_p{i}", _place(F.rank().over(at) - 1, tied, s.isNotNull(), F.col("_n"), ties, missing))
    out = cold if hot is None else cold.unionByName(_hot_places(rows, hot, len(scores), ties, missing))
    return out.select(F.col("_group").alias(group), F.col("_item").alias(item), *(F.col(f"_s{i}").alias(s) for i, s in enumerate(scores)), F.col("_n").alias("n"), *(F.col(f"_p{i}").alias(f"place_{s}") for i, s in enumerate(scores)))


def _hot_places(rows: DataFrame, hot: DataFrame, k: int, ties: str, missing: str) -> DataFrame:
    rows = rows.join(hot, F.col("_group").eqNullSafe(F.col("_of")), "inner").drop("_of")
    rows = materialize(rows, "hot-groups")
    long = reduce(DataFrame.unionByName, (rows.select("_group", F.lit(i).alias("_i"), F.col(f"_s{i}").alias("_v")).filter("_v is not null") for i in range(k)))
    counts = long.groupBy("_group", "_i", "_v").agg(F.count("*").alias("_tied"))
    counts = counts.repartitionByRange(partitions(rows.sparkSession), F.col("_group"), F.col("_i"), F.col("_v").desc()).withColumn("_pid", F.spark_partition_id())
    counts = materialize(counts, "score-counts")
    within = Window.partitionBy("_pid", "_group", "_i").orderBy(F.col("_v").desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy("_pid", "_group", "_i").agg(F.sum("_tied").alias("_sum"))  # at most one row per partition and ranking that touches it
    earlier = Window.partitionBy("_group", "_i").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("_pid").alias("_tp"), F.col("_group").alias("_tg"), F.col("_i").alias("_ti"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    placed = counts.withColumn("_in", F.coalesce(F.sum("_tied").over(within), F.lit(0))).join(totals, (F.col("_pid") == F.col("_tp")) & F.col("_group").eqNullSafe(F.col("_tg")) & (F.col("_i") == F.col("_ti")))
    placed = materialize(placed.select(F.col("_group").alias("_pg"), F.col("_i").alias("_pi"), F.col("_v").alias("_pv"), (F.col("_before") + F.col("_in")).alias("_higher"), "_tied"), "score-places")
    for i in range(k):
        p = placed.filter(F.col("_pi") == i).drop("_pi")
        rows = rows.join(p, F.col("_group").eqNullSafe(F.col("_pg")) & (F.col(f"_s{i}") == F.col("_pv")), "left")
        rows = rows.withColumn(f"_p{i}", _place(F.col("_higher"), F.col("_tied"), F.col(f"_s{i}").isNotNull(), F.col("_n"), ties, missing)).drop("_pg", "_pv", "_higher", "_tied")
    return rows


def borda(hits: DataFrame, group: str, item: str, scores: list[str], weights: list[float] | None = None, **options) -> DataFrame:
    """``borda_places`` with ``points``: the weighted sum of n minus place. More points rank higher; equal points are ordered by the item's id."""
    weights = weights or [1.0] * len(scores)
    places = borda_places(hits, group, item, scores, **options)
    return places.withColumn("points", reduce(lambda a, b: a + b, ((F.col("n") - F.col(f"place_{s}")) * F.lit(float(w)) for s, w in zip(scores, weights, strict=True))))


def ranked(points: DataFrame, group: str, item: str, hot_rows: int = 1_000_000) -> DataFrame:
    """``points`` (of ``borda``) with ``rank``, 1-based in each group: most points first, of equal points the smaller item, repeats of an
    item (under other scores) in a fixed order. Groups above ``hot_rows`` are numbered by range partitions instead of one window."""
    order = [F.desc("points"), F.asc_nulls_first(item), *(F.desc_nulls_last(c) for c in points.columns if c not in (group, item, "points", "n"))]
    if points.filter(F.col("n") > hot_rows).isEmpty():
        return points.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long"))
    points = materialize(points, "points")
    cold = points.filter(F.col("n") <= hot_rows).withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long"))
    hot = global_index(points.filter(F.col("n") > hot_rows), order, "ranks", [group])
    return cold.unionByName(hot.withColumn("rank", (F.col("row_index") + 1).cast("long")).drop("row_index"))


def best(ranked: DataFrame, group: str, item: str) -> DataFrame:
    """The first item of each group: most points, then the smallest id; an aggregation, so hot groups are combined before the shuffle."""
    return ranked.groupBy(group).agg(F.min_by(F.col(item), F.struct(-F.col("points"), F.col(item))).alias(item))
