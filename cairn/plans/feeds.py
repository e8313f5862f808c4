"""Queries of the general training-data operators: the change feed (p1) and references (p2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.operators import changefeed, references
from cairn.plans.common import Registry, table

R = Registry()

_STANDING = r"""
WITH part AS (
  SELECT op, assertion, seq, lower(trim(action)) AS action, trim(ts) AS t,
    regexp_extract(trim(ts), '^(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}:\d{2})(\.\d+)?([Zz]|[+-]\d{2}:\d{2})?$', ['d', 'c', 'f', 'z']) AS m
  FROM decisions),
inst AS (
  SELECT op, assertion, seq, action, CASE
    WHEN regexp_full_match(t, '-?\d{1,15}') THEN CAST(t AS BIGINT) * 1000
    WHEN m.d <> '' THEN epoch_us(TRY_CAST(m.d || ' ' || m.c || m.f AS TIMESTAMP))
      - CASE WHEN length(m.z) = 6 THEN (CASE WHEN m.z[1] = '-' THEN -1 ELSE 1 END) * (CAST(m.z[2:3] AS BIGINT) * 60 + CAST(m.z[5:6] AS BIGINT)) * 60000000 ELSE 0 END
    END AS instant FROM part),
ev AS (SELECT op, min(seq) AS place, arg_min(assertion, seq) AS assertion, arg_min(action, seq) AS action, arg_min(instant, seq) AS instant FROM inst GROUP BY op),
last AS (
  SELECT *, row_number() OVER (PARTITION BY assertion ORDER BY instant DESC, place DESC) AS rn
  FROM ev WHERE action IN ('confirm', 'dismiss', 'reopen') AND instant IS NOT NULL)
SELECT assertion, action, op FROM last WHERE rn = 1 AND action <> 'reopen'
"""

_FAULTS = r"""
WITH refs AS (
  SELECT field, id, kind, trim(ref) AS ref, min(arrived_at) AS arrived_at FROM (
    SELECT 'claims.supersedes' AS field, id, 'claim' AS kind, supersedes AS ref, arrived_at FROM claims
    UNION ALL SELECT 'assertions.note_id', id, 'note', note_id, arrived_at FROM assertions
    UNION ALL SELECT 'entity_sources.note_id', slug, 'note', note_id, arrived_at FROM entity_sources
    UNION ALL SELECT 'assertions.text_unit_ids', id, 'text_unit', unnest(text_unit_ids), arrived_at FROM assertions)
  WHERE trim(ref) <> '' GROUP BY ALL),
life AS (
  SELECT kind, key, min(arrived_at) AS first_at, max(arrived_at) AS last_at FROM (
    SELECT 'note' AS kind, id AS key, arrived_at FROM notes
    UNION ALL SELECT 'claim', id, arrived_at FROM claims
    UNION ALL SELECT 'text_unit', id, arrived_at FROM text_units) GROUP BY ALL),
gone AS (SELECT kind, id AS key, max(removed_at) AS removed_at FROM removals GROUP BY ALL),
judged AS (
  SELECT r.field, r.id, r.ref, r.arrived_at, CASE
    WHEN l.key IS NULL THEN 'missing' WHEN g.removed_at > l.last_at THEN 'removed' WHEN l.first_at > r.arrived_at THEN 'late' END AS fault
  FROM refs r LEFT JOIN life l ON l.kind = r.kind AND l.key = r.ref LEFT JOIN gone g ON g.kind = r.kind AND g.key = r.ref)
"""


@R.add("p1_found", _STANDING)
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The decision that stands for each assertion and claim."""
    return changefeed.standing_decisions(table(spark, d, "decisions"))


def _vault(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {n: table(spark, d, n) for n in ("notes", "claims", "assertions", "entity_sources", "text_units", "removals")}


@R.add("p2_found", _FAULTS + "SELECT field, id, ref, fault FROM judged WHERE fault IS NOT NULL")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Each reference that points at nothing, at a removed record or at one that came afterwards."""
    return references.vault_faults(_vault(spark, d)).select("field", "id", "ref", "fault")


@R.add("p2_report", _FAULTS + "SELECT split_part(field, '.', 1) AS table_name, field, strftime(arrived_at, '%Y-%m') AS month, fault, count(*) AS n FROM judged WHERE fault IS NOT NULL GROUP BY ALL")
def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Faulty references per table, field, month of arrival and fault."""
    return references.fault_report(references.vault_faults(_vault(spark, d)))
