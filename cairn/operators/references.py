"""References to records that do not exist (problem 2).

``orphans`` holds composite keys whose columns may be partly null against a target: references are grouped by their
null mask, and each mask is anti-joined on its non-null columns under the declared match semantics of SQL:

* ``simple``: a reference with any null is satisfied;
* ``full``: all null is satisfied, some null is an orphan, none null must match;
* ``partial``: the non-null columns must match some target row.

Only masks that the semantics leave open are joined, so single keys and simple match cost one anti-join.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trimmed(c: Column | str) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def orphans(refs: DataFrame, targets: DataFrame, columns: dict[str, str], match: str = "simple", keep_matched: bool = False) -> DataFrame:
    """Rows of ``refs`` whose key (``columns``: its column -> the target's) has no target.

    With ``keep_matched`` the rows that have one are returned instead. Repeated rows stay repeated; a null never equals
    a null; an empty target makes every open reference an orphan.
    """
    if match not in ("simple", "full", "partial"):
        raise ValueError(f"unknown match semantics: {match}")
    how, parts = "left_semi" if keep_matched else "left_anti", []
    names = list(columns)
    for mask in product((False, True), repeat=len(names)):
        here = reduce(lambda a, b: a & b, (F.col(c).isNull() if null else F.col(c).isNotNull() for c, null in zip(names, mask, strict=True)))
        group, given = refs.filter(here), [c for c, null in zip(names, mask, strict=True) if not null]
        if all(mask) or (any(mask) and match == "simple"):
            satisfied = True
        elif any(mask) and match == "full":
            satisfied = False
        else:
            right = targets.select(*(F.col(columns[c]).alias(f"_t{i}") for i, c in enumerate(given)))
            if any(mask):
                right = right.distinct()
            on = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"_t{i}") for i, c in enumerate(given)))
            parts.append(group.join(right, on, how))
            continue
        if satisfied == keep_matched:
            parts.append(group)
    return reduce(DataFrame.unionByName, parts) if parts else refs.limit(0)


def classify(refs: DataFrame, targets: DataFrame, removals: DataFrame) -> DataFrame:
    """Adds ``fault`` to references (field, id, kind, ref, arrived_at): missing, removed or late; drops sound ones.

    targets: kind, key, arrived_at, one row per delivery. removals: kind, key, removed_at. A null time is no time: a
    removed key whose deliveries have no time is removed, and without the time of either side nothing is late.
    """
    life = targets.filter("key is not null").groupBy(F.col("kind").alias("t_kind"), F.col("key").alias("t_key")).agg(F.min("arrived_at").alias("t_first"), F.max("arrived_at").alias("t_last"))
    gone = removals.groupBy(F.col("kind").alias("r_kind"), F.col("key").alias("r_key")).agg(F.max("removed_at").alias("removed_at"))
    life = life.join(gone, (F.col("t_kind") == F.col("r_kind")) & (F.col("t_key") == F.col("r_key")), "left")
    # distinct references first (partial aggregation before the shuffle); AQE splits a reference that many rows share
    refs = refs.groupBy("field", "id", "kind", "ref").agg(F.min("arrived_at").alias("arrived_at"))
    missing = orphans(refs, life, {"kind": "t_kind", "ref": "t_key"}, "simple").withColumn("fault", F.lit("missing"))
    met = refs.join(life, (F.col("kind") == F.col("t_kind")) & (F.col("ref") == F.col("t_key")), "inner")
    removed = F.col("removed_at").isNotNull() & (F.col("t_last").isNull() | (F.col("removed_at") > F.col("t_last")))
    fault = F.when(removed, "removed").when(F.col("t_first") > F.col("arrived_at"), "late")
    return missing.unionByName(met.withColumn("fault", fault).filter("fault is not null").select(*missing.columns))


def vault_references(claims: DataFrame, assertions: DataFrame, entity_sources: DataFrame) -> DataFrame:
    """Every reference of the four fields: field, id, kind (of the target), ref, arrived_at. Null and empty ones are none."""
    one = lambda df, field, i, kind, ref: df.select(F.lit(field).alias("field"), F.col(i).alias("id"), F.lit(kind).alias("kind"), trimmed(ref).alias("ref"), "arrived_at")
    units = assertions.select("id", "arrived_at", F.explode("text_unit_ids").alias("unit"))
    parts = [
        one(claims, "claims.supersedes", "id", "claim", "supersedes"),
        one(assertions, "assertions.note_id", "id", "note", "note_id"),
        one(entity_sources, "entity_sources.note_id", "slug", "note", "note_id"),
        one(units, "assertions.text_unit_ids", "id", "text_unit", "unit"),
    ]
    return reduce(DataFrame.unionByName, parts).filter("ref <> ''")


def vault_faults(t: dict[str, DataFrame]) -> DataFrame:
    """The faulty references of the vault's tables, with the earliest arrival of each."""
    targets = reduce(DataFrame.unionByName, (t[table].select(F.lit(kind).alias("kind"), F.col("id").alias("key"), "arrived_at") for table, kind in (("notes", "note"), ("claims", "claim"), ("text_units", "text_unit"))))
    removals = t["removals"].select("kind", F.col("id").alias("key"), "removed_at")
    return classify(vault_references(t["claims"], t["assertions"], t["entity_sources"]), targets, removals)


def fault_report(faults: DataFrame) -> DataFrame:
    """Faults per table and month of arrival."""
    return faults.groupBy(F.substring_index("field", ".", 1).alias("table_name"), "field", F.date_format("arrived_at", "yyyy-MM").alias("month"), "fault").agg(F.count("*").alias("n"))
