"""op13: every vector's cluster after ten rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteprism.llm.centroids import cluster
from siteprism.llm.common import table
from siteprism.llm.registry import query

CLUSTERS, ROUNDS, DIMS, SCALE, SEED = 8, 10, 64, 1024, 3


def _sql() -> str:
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {DIMS})""",
        "e AS MATERIALIZED (SELECT r, i, x[i] AS c FROM v, range(1, %d) t(i))" % (DIMS + 1),
        f"s AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id::VARCHAR), x) - 1 AS k, x FROM v WHERE vec_id IS NOT NULL)",
        f"c0 AS MATERIALIZED (SELECT k, i, x[i] AS c FROM s, range(1, {DIMS + 1}) t(i) WHERE k < {CLUSTERS})",
    ]
    for n in range(ROUNDS + 1):
        steps.append(f"d{n} AS (SELECT e.r, z.k, sum((e.c - z.c) * (e.c - z.c)) AS d FROM e JOIN c{n} z USING (i) GROUP BY e.r, z.k)")
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, k, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)")
        if n < ROUNDS:
            steps.append(f"m{n} AS MATERIALIZED (SELECT k, i, sum(c) AS s, count(*) AS n FROM a{n} JOIN e USING (r) GROUP BY k, i)")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT z.k, z.i, CASE WHEN m.n IS NULL THEN z.c ELSE ((m.s - ((m.s % m.n) + m.n) % m.n) // m.n)::BIGINT END AS c FROM c{n} z LEFT JOIN m{n} m ON m.k = z.k AND m.i = z.i)")
    return f"""
WITH {", ".join(steps)},
h AS (SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY k)
SELECT vec_id, k::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN v USING (r) JOIN h USING (k)
"""


@query("op13_centroids", _sql())
def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster(table(spark, sf_dir, "embeddings"), CLUSTERS, ROUNDS, DIMS, SCALE, SEED)
    said = F.array_join(F.col("centroid").cast("array<string>"), ",")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(said, 256).alias("centroid_sha256"))
