"""op12: every document's leaf, proof and verification in the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteprism.llm.common import table
from siteprism.llm.merkle import checked, manifest
from siteprism.llm.registry import query

#: Rows whose checksum this divides are tampered with.
EVERY = 7
#: Levels that the SQL builds: up to 2 ** LEVELS documents a language.
LEVELS = 20
_POLYNOMIAL = 0xEDB88320


def _sql() -> str:
    def said(c: str) -> str:
        return f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"

    def leaf(chars: str) -> str:
        return f"sha256({' || '.join(said(c) for c in ('doc_id', 'source', 'lang', chars, 'text'))})"

    crc = ["c0 AS (SELECT i, i::BIGINT AS c FROM range(256) t(i))"]
    crc += [f"c{k} AS (SELECT i, xor(c >> 1, {_POLYNOMIAL} * (c & 1)) AS c FROM c{k - 1})" for k in range(1, 9)]
    levels = []
    for tree, first in (("l", "leaves"), ("u", "tops")):
        levels.append(f"{tree}0 AS MATERIALIZED (SELECT tree, r, digest, n FROM {first})")
        for k in range(1, LEVELS + 1):
            levels.append(
                f"{tree}{k} AS MATERIALIZED (SELECT tree, r // 2 AS r, CASE WHEN max(n) = 1 THEN min(digest) ELSE sha256(string_agg(digest, '' ORDER BY r)) END AS digest, "
                f"(max(n) + 1) // 2 AS n FROM {tree}{k - 1} GROUP BY tree, r // 2)"
            )
        if tree == "l":
            levels.append(f"tops AS MATERIALIZED (SELECT 'top' AS tree, tree AS name, row_number() OVER (ORDER BY tree) - 1 AS r, digest, count(*) OVER () AS n FROM l{LEVELS})")
    steps = []
    last = "p0"
    levels.append("p0 AS (SELECT v.*, t.r AS tr, t.digest AS subroot, v.r AS at, '' AS proof, now AS fold FROM leaves v JOIN tops t ON t.name = v.tree)")
    for tree, own in (("l", "p.tree"), ("u", "'top'")):
        for k in range(LEVELS):
            name = f"{tree}p{k}"
            at = f"((CASE WHEN {'true' if tree == 'l' else 'false'} THEN p.at ELSE p.tr END) // {2**k})"
            steps.append(
                f"{name} AS MATERIALIZED (SELECT p.* REPLACE (p.proof || coalesce(s.digest, '') AS proof, "
                f"CASE WHEN x.n = 1 THEN p.fold WHEN s.digest IS NULL THEN sha256(p.fold) WHEN s.r < {at} THEN sha256(s.digest || p.fold) ELSE sha256(p.fold || s.digest) END AS fold) "
                f"FROM {last} p JOIN {tree}{k} x ON x.tree = {own} AND x.r = {at} LEFT JOIN {tree}{k} s ON s.tree = {own} AND s.r = xor({at}, 1))"
            )
            last = name
    return f"""
WITH {", ".join(crc)},
crc AS (SELECT list(c ORDER BY i) AS codes FROM c8),
marked AS (SELECT d.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ord(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
  lambda a, b: xor(a >> 8, codes[(xor(a, b) & 255) + 1])), 4294967295) % {EVERY} = 0 AS hit FROM documents d, crc),
digests AS (SELECT doc_id, coalesce('=' || lang, '-') AS tree, {leaf("n_chars")} AS digest, CASE WHEN hit THEN {leaf("(n_chars + 1)")} ELSE {leaf("n_chars")} END AS now FROM marked),
leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS r, count(*) OVER (PARTITION BY tree) AS n FROM digests),
{", ".join(levels)}, {", ".join(steps)},
root AS (SELECT digest AS root FROM u{LEVELS})
SELECT doc_id, digest AS leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM {last}, root
"""


@query("op12_merkle", _sql())
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % EVERY == 0
    docs = table(spark, sf_dir, "documents")
    found = checked(manifest(docs, now={"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
