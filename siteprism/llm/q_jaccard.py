"""op4: documents linked by common word shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteprism.llm.common import table
from siteprism.llm.jaccard import join
from siteprism.llm.registry import query

SHINGLE, PERCENT = 4, 85


def components_sql(documents: str, shingle: int, percent: int) -> str:
    """Common table expressions up to `comp` (doc_id, n_shingles, component_id) over a table with doc_id and text."""
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
jw AS (SELECT doc_id, regexp_extract_all({lowered}, '[^\x20\x09-\x0D]+') AS w FROM {documents}),
js AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + {shingle - 1}], ' ') AS s
      FROM jw, unnest(range(1, greatest(len(w) - {shingle - 1}, 1) + 1)) u(i) WHERE len(w) > 0),
jn AS (SELECT doc_id, count(*) AS n FROM js GROUP BY doc_id),
jc AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM js a JOIN js b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
jl AS (SELECT a, b FROM jc JOIN jn x ON x.doc_id = a JOIN jn y ON y.doc_id = b WHERE 100 * common >= {percent} * (x.n + y.n - common)),
je AS (SELECT a, b FROM jl UNION SELECT b, a FROM jl),
reach(a, b) AS (SELECT a, b FROM je UNION SELECT r.a, e.b FROM reach r JOIN je e ON r.b = e.a),
jm AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
comp AS (SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
      FROM {documents} d LEFT JOIN jn ON jn.doc_id = d.doc_id LEFT JOIN jm ON jm.a = d.doc_id)"""


SQL = f"WITH RECURSIVE {components_sql('documents', SHINGLE, PERCENT)} SELECT * FROM comp"


@query("op4_jaccard_join", SQL)
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), SHINGLE, PERCENT)
