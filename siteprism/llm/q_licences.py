"""op2: licences named or quoted in every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteprism.llm.common import table
from siteprism.llm.licence_texts import MORE, TEMPLATES
from siteprism.llm.licences import THRESHOLD, scan
from siteprism.llm.registry import query

_ROWS = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, _, t) in enumerate(TEMPLATES))


def _words(text: str) -> str:
    lowered = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all(replace({lowered}, 'licence', 'license'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _grams(words: str) -> str:
    return f"CASE WHEN len({words}) = 1 THEN {words} ELSE list_distinct(list_transform(range(1, len({words})), lambda i: {words}[i] || ' ' || {words}[i + 1])) END"


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
marked AS (SELECT r, i, t, len({_words('t')}) = 0 AS blank FROM lines),
runs AS (SELECT r, i, t, blank, count(*) FILTER (blank) OVER (PARTITION BY r ORDER BY i) AS run FROM marked),
units AS (
  SELECT r, t FROM runs WHERE NOT blank
  UNION SELECT r, string_agg(t, chr(10) ORDER BY i) FROM runs WHERE NOT blank GROUP BY r, run
  UNION SELECT r, text FROM d),
uw AS (SELECT r, {_words('t')} AS w FROM units),
u AS (SELECT row_number() OVER () AS id, r, {_grams('w')} AS g FROM (SELECT DISTINCT r, w FROM uw WHERE len(w) > 0)),
tw AS (SELECT k, name, {_words('t')} AS w FROM (VALUES {_ROWS}) v(k, name, t)),
t AS (SELECT k, name, {_grams('w')} AS g FROM tw WHERE len(w) > 0),
ug AS (SELECT id, r, len(g) AS n, unnest(g) AS x FROM u),
tg AS (SELECT k, name, len(g) AS n, unnest(g) AS x FROM t),
m AS (SELECT ug.r, ug.id, tg.k, any_value(name) AS name, count(*) AS common, any_value(ug.n) + any_value(tg.n) AS total
      FROM ug JOIN tg USING (x) GROUP BY ug.r, ug.id, tg.k),
hit AS (SELECT r, name, common, total FROM m WHERE 200 * common >= {THRESHOLD} * total),
best AS (SELECT r, first(name ORDER BY -(common::DOUBLE / total), name) AS licence, max(2 * common / total) AS score,
      array_to_string(list_sort(list_distinct(list(name))), ',') AS licences FROM hit GROUP BY r)
SELECT doc_id, licence, score, coalesce(licences, '') AS licences FROM d LEFT JOIN best USING (r)
"""


@query("op2_licences", SQL)
def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole lines, paragraphs and texts as in the SQL, and notices and texts anywhere, which the SQL doesn't look for."""
    every = [*TEMPLATES, *MORE]
    found = scan(table(spark, sf_dir, "documents"), [(n, t) for n, _, t in every], passages=[(n, t) for n, form, t in every if form != "line"])
    return found.withColumn("licences", F.array_join("licences", ","))
