"""op9: documents that hold passages of the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteprism.llm.common import table
from siteprism.llm.decontaminate import WINDOW, counts, hits
from siteprism.llm.registry import query

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id::VARCHAR AS item, least(len(w), {WINDOW}) AS n, array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' ') AS win
  FROM b, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) u(i) WHERE len(w) > 0),
dw AS (
  SELECT r, i, s.n, array_to_string(w[i : i + s.n - 1], ' ') AS win
  FROM d, (SELECT DISTINCT n FROM bw) s, unnest(range(1, len(w) - s.n + 2)) u(i)),
m AS (SELECT r, i, dw.n, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM m, unnest(range(i, i + n)) u(p) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""


@query("op9_decontaminate", SQL)
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
