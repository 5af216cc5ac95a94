"""op10: repeated passages of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteprism.llm.common import table
from siteprism.llm.registry import query
from siteprism.llm.suffixes import LENGTH, kept

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
h AS (SELECT r, doc_id, hex(b) AS x, octet_length(b) AS n FROM d),
w AS (SELECT r, i, md5(substr(x, 2 * i + 1, {2 * LENGTH})) AS k FROM h, unnest(range(0, n - {LENGTH - 1})) u(i)),
k AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
m AS (SELECT r, i FROM w SEMI JOIN k USING (k)),
e AS (SELECT r, i, i > 1 + {LENGTH - 1} + coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -{2 * LENGTH}) AS new FROM m),
g AS (SELECT r, i, sum(new::INT) OVER (PARTITION BY r ORDER BY i) AS run FROM e),
s AS (SELECT r, min(i) AS a, max(i) + {LENGTH} AS z FROM g GROUP BY r, run),
p AS (SELECT r, a, z, lag(z, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before FROM s),
t AS (SELECT r, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed, max(z) AS tail FROM s GROUP BY r),
q AS (SELECT p.r, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS x FROM p JOIN h USING (r) GROUP BY p.r)
SELECT h.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN t.r IS NULL THEN h.x ELSE q.x || substr(h.x, 2 * tail + 1) END)) AS kept_sha256
FROM h LEFT JOIN t USING (r) LEFT JOIN q USING (r)
"""


@query("op10_suffix_dedup", SQL)
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kept(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
