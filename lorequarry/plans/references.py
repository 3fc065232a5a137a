"""Queries on references to missing records, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorequarry.operators.references import orphan_references, orphan_report
from lorequarry.sources.tables import table


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_references(table(spark, folder, "test_set"), table(spark, folder, "chunk"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select("item_id", "field_name", "chunk_id", "reason").distinct()


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_report(_orphans(spark, folder))


QUERIES = {"p4_found": p4_found, "p4_report": p4_report}

_ORPHANS = r"""
WITH refs AS (
  SELECT DISTINCT item_id, field_name, lower(trim(raw, chr(32) || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288))) AS chunk_id,
         created_at AS at_time
  FROM (SELECT item_id, created_at, 'evidence_chunk_ids' AS field_name, unnest(evidence_chunk_ids) AS raw FROM test_set
        UNION ALL
        SELECT item_id, created_at, 'gold_chunk_ids', unnest(gold_chunk_ids) FROM test_set)
), named AS (SELECT * FROM refs WHERE chunk_id <> ''),
parents AS (SELECT lower(trim(chunk_id)) AS chunk_id, indexed_at, deleted_at FROM chunk),
judged AS (
  SELECT n.item_id, n.field_name, n.chunk_id, n.at_time,
         count(p.chunk_id) AS n_rows,
         count(*) FILTER (WHERE p.indexed_at <= n.at_time) AS n_indexed,
         count(*) FILTER (WHERE p.indexed_at <= n.at_time AND (p.deleted_at IS NULL OR p.deleted_at > n.at_time)) AS n_live
  FROM named n LEFT JOIN parents p ON p.chunk_id = n.chunk_id
  GROUP BY 1, 2, 3, 4
), orphans AS (
  SELECT DISTINCT item_id, field_name, chunk_id, at_time,
         CASE WHEN n_rows = 0 THEN 'missing' WHEN n_indexed = 0 THEN 'late' ELSE 'deleted' END AS reason
  FROM judged WHERE n_live = 0
)
"""

ORACLE_SQL = {
    "p4_found": _ORPHANS + "SELECT DISTINCT item_id, field_name, chunk_id, reason FROM orphans",
    "p4_report": _ORPHANS
    + """SELECT field_name, strftime(at_time, '%Y-%m') AS month, reason, count(*) AS "references"
         FROM (SELECT DISTINCT item_id, field_name, chunk_id, reason, at_time FROM orphans) GROUP BY 1, 2, 3""",
}
