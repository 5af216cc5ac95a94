"""op11: vectors linked by cosine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteprism.llm.common import table
from siteprism.llm.embeddings import near_duplicates
from siteprism.llm.registry import query

THRESHOLD = 0.98

SQL = f"""
WITH RECURSIVE r AS (SELECT row_number() OVER () AS k, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
f AS MATERIALIZED (SELECT k, vec_id, label, v, len(v) AS n FROM r WHERE label IS NOT NULL AND len(list_filter(v, lambda c: c IS NOT NULL AND isfinite(c))) = len(v) AND len(list_filter(v, lambda c: c <> 0)) > 0),
p AS MATERIALIZED (SELECT a.k AS a, b.k AS b, a.v AS x, b.v AS y FROM f a JOIN f b ON a.label = b.label AND a.n = b.n AND a.k <> b.k),
e AS MATERIALIZED (SELECT a, b FROM p WHERE list_cosine_similarity(x, y) >= {THRESHOLD}),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
m AS (SELECT reach.a AS k, min(r.vec_id) AS least FROM reach JOIN r ON r.k = reach.b GROUP BY reach.a),
n AS (SELECT a AS k, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, least) AS component_id, coalesce(vec_id = least(vec_id, least), false) AS kept
FROM r LEFT JOIN m USING (k) LEFT JOIN n USING (k)
"""


@query("op11_embeddings", SQL)
def op11_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "embeddings"), THRESHOLD)
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
