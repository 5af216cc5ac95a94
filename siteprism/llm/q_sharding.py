"""op1: every document's shard among 64."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteprism.llm.common import table
from siteprism.llm.registry import query
from siteprism.llm.sharding import DIGITS, assign, table_size

SHARDS = [f"shard-{i:03d}" for i in range(64)]
SIZE = table_size(len(SHARDS))

SQL = f"""
WITH RECURSIVE names AS (SELECT i, 'shard-' || lpad(i::VARCHAR, 3, '0') AS name FROM range({len(SHARDS)}) r(i)),
orders AS (
  SELECT list(('0x' || substr(md5(name || ':offset'), 1, {DIGITS}))::BIGINT % {SIZE} ORDER BY i) AS place,
         list(('0x' || substr(md5(name || ':skip'), 1, {DIGITS}))::BIGINT % {SIZE - 1} + 1 ORDER BY i) AS step
  FROM names),
claims(k, taken, slot) AS (
  SELECT 0::BIGINT, repeat('0', {SIZE})::BIT, -1::BIGINT
  UNION ALL
  SELECT k + 1, set_bit(taken, slot::INT, 1), slot FROM (
    SELECT k, taken, list_filter(
      list_transform(range({SIZE}), lambda j: (place[k % {len(SHARDS)} + 1] + j * step[k % {len(SHARDS)} + 1]) % {SIZE}),
      lambda s: get_bit(taken, s::INT) = 0)[1] AS slot
    FROM claims, orders WHERE k < {SIZE}))
SELECT d.doc_id, c.slot, 'shard-' || lpad(((c.k - 1) % {len(SHARDS)})::VARCHAR, 3, '0') AS shard
FROM documents d
JOIN claims c ON c.slot = ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, {DIGITS}))::BIGINT % {SIZE}
"""


@query("op1_sharding", SQL)
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS, SIZE)
