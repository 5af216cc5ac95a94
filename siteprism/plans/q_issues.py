"""Issue list queries (A-10 … A-19)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteprism.common import stage_dir
from siteprism.operators import issues as I
from siteprism.operators.guides import GUIDES
from siteprism.plans import facts as D
from siteprism.plans import pages as P
from siteprism.plans import sql_audit as SA
from siteprism.plans import sql_pages as S
from siteprism.plans.q_audit import checks, counts
from siteprism.plans.registry import query
from siteprism.sources import io as IO

_QUICK = f"""{S.FEATURES}, quick AS (
  SELECT site_id, page_seq, url, 'missing_title' AS type, 'high' AS severity, 'The page is missing a title tag.' AS description FROM feat WHERE title = ''
  UNION ALL SELECT site_id, page_seq, url, 'short_title', 'medium', 'The title tag is only ' || length(title) || ' characters.' FROM feat WHERE title <> '' AND length(title) < 30
  UNION ALL SELECT site_id, page_seq, url, 'long_title', 'low', 'The title tag is ' || length(title) || ' characters and may be truncated.' FROM feat WHERE length(title) > 60
  UNION ALL SELECT site_id, page_seq, url, 'missing_description', 'high', 'The page is missing a meta description.' FROM feat WHERE meta_description = ''
  UNION ALL SELECT site_id, page_seq, url, 'short_description', 'medium', 'The meta description is only ' || length(meta_description) || ' characters.' FROM feat WHERE meta_description <> '' AND length(meta_description) < 70
  UNION ALL SELECT site_id, page_seq, url, 'missing_h1', 'high', 'The page is missing an H1 heading.' FROM feat WHERE len(h1) = 0
  UNION ALL SELECT site_id, page_seq, url, 'multiple_h1', 'medium', 'The page has ' || len(h1) || ' H1 tags instead of one.' FROM feat WHERE len(h1) > 1
  UNION ALL SELECT site_id, page_seq, url, 'thin_content', 'high', 'The page only has ' || word_count || ' words.' FROM feat WHERE word_count < 300)"""


def _quick(spark: SparkSession, sf: str) -> DataFrame:
    return I.quick_audit_issues(P.features(spark, sf, ["title", "meta_description", "h1", "word_count"]))


@query("a10_quick_audit_issues", f"WITH {_QUICK} SELECT url, type, severity, description FROM quick")
def a10(spark: SparkSession, sf: str) -> DataFrame:
    return _quick(spark, sf).select("url", "type", "severity", "description")


_COST = "CASE severity WHEN 'critical' THEN 15 WHEN 'high' THEN 10 WHEN 'medium' THEN 5 WHEN 'low' THEN 2 ELSE 0 END"


@query("a11_deduction_score", f"WITH {_QUICK} SELECT site_id, count(*) AS issues_count, greatest(0, 100 - sum({_COST}))::INT AS score FROM quick GROUP BY site_id")
def a11(spark: SparkSession, sf: str) -> DataFrame:
    return I.deduction_score(_quick(spark, sf), ["site_id"])


def _pairs(runs: DataFrame) -> DataFrame:
    """First and last completed run of each site."""
    done = runs.filter("status = 'completed'").groupBy("site_id").agg(F.max("audit_id").alias("after_id"), F.min("audit_id").alias("before_id"))
    return done.filter("after_id <> before_id").select("before_id", "after_id")


@query(
    "a12_compare_audits",
    f"""WITH {D.RUNS}, {D.ISSUES}, pairs AS (SELECT min(audit_id) AS before_id, max(audit_id) AS after_id FROM runs WHERE status = 'completed'
      GROUP BY site_id HAVING min(audit_id) <> max(audit_id)),
    k AS (SELECT DISTINCT audit_id, category, title FROM iss),
    c AS (SELECT before_id, after_id, count_if(b.audit_id IS NULL) AS new_issues, count_if(a.audit_id IS NULL) AS fixed_issues,
        count_if(a.audit_id IS NOT NULL AND b.audit_id IS NOT NULL) AS persistent_issues
      FROM (SELECT DISTINCT before_id, after_id, category, title FROM pairs JOIN k ON k.audit_id IN (before_id, after_id)) u
      LEFT JOIN k b ON b.audit_id = before_id AND b.category = u.category AND b.title = u.title
      LEFT JOIN k a ON a.audit_id = after_id AND a.category = u.category AND a.title = u.title GROUP BY ALL)
    SELECT before_id, after_id, coalesce(ra.score, 0) - coalesce(rb.score, 0) AS score_change, coalesce(new_issues, 0) AS new_issues,
      coalesce(fixed_issues, 0) AS fixed_issues, coalesce(persistent_issues, 0) AS persistent_issues
    FROM pairs LEFT JOIN c USING (before_id, after_id) JOIN runs rb ON rb.audit_id = before_id JOIN runs ra ON ra.audit_id = after_id""",
)
def a12(spark: SparkSession, sf: str) -> DataFrame:
    runs = D.audit_runs(spark, sf)
    return I.compare_audits(_pairs(runs), runs, D.stored_issues(spark, sf))


@query(
    "a12_compare_stored_audits",
    f"""WITH {D.RUNS}, {D.ISSUES}, pairs AS (SELECT min(audit_id) AS before_id, max(audit_id) AS after_id FROM runs WHERE status = 'completed'
      GROUP BY site_id HAVING min(audit_id) <> max(audit_id)),
    k AS (SELECT DISTINCT audit_id, category, title FROM iss),
    b AS (SELECT before_id, after_id, category, title FROM pairs JOIN k ON audit_id = before_id), a AS (SELECT before_id, after_id, category, title FROM pairs JOIN k ON audit_id = after_id)
    SELECT before_id, after_id, count_if(b.title IS NULL) AS new_issues, count_if(a.title IS NULL) AS fixed_issues, count_if(a.title IS NOT NULL AND b.title IS NOT NULL) AS persistent_issues
    FROM b FULL JOIN a USING (before_id, after_id, category, title) GROUP BY ALL""",
)
def a12_stored(spark: SparkSession, sf: str) -> DataFrame:
    """The issues of both audits written to bucketed tables and compared there."""
    runs, tag = D.audit_runs(spark, sf), uuid.uuid4().hex
    sides = I.issue_sides(_pairs(runs), D.stored_issues(spark, sf))
    stored = [IO.write_bucketed(df, f"issues_{side}_{tag}", f"{stage_dir(spark)}/issues-{side}-{tag}", I.ISSUE_KEYS) for df, side in zip(sides, ("before", "after"))]
    return I.compare_sides(*stored)


@query(
    "a13_latest_audit",
    f"""WITH {D.RUNS} SELECT site_id, audit_id, score, completed_at FROM runs WHERE status = 'completed'
    QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY completed_at DESC, audit_id DESC) = 1""",
)
def a13(spark: SparkSession, sf: str) -> DataFrame:
    return I.latest_audit(D.audit_runs(spark, sf))


@query("a14_issue_list", f"WITH {D.ISSUES} SELECT audit_id, seq, severity, title FROM iss WHERE severity = 'high' AND status = 'open'")
def a14(spark: SparkSession, sf: str) -> DataFrame:
    return I.issue_list(D.stored_issues(spark, sf), "high", "open").select("audit_id", "seq", "severity", "title")


@query(
    "a14_issue_stats",
    f"""WITH {D.ISSUES} SELECT audit_id, 'severity' AS dimension, severity AS value, count(*) AS issues FROM iss GROUP BY ALL
    UNION ALL SELECT audit_id, 'category', category, count(*) FROM iss GROUP BY ALL""",
)
def a14s(spark: SparkSession, sf: str) -> DataFrame:
    return I.issue_stats(D.stored_issues(spark, sf))


@query("a15_failed_checks", f"WITH {SA.ctes()} SELECT site_id, check_id, severity, affected_count FROM checks WHERE NOT passed")
def a15(spark: SparkSession, sf: str) -> DataFrame:
    return I.failed_checks(checks(spark, sf)).select("site_id", "check_id", "severity", "affected_count")


@query(
    "a16_report_issue_union",
    f"""WITH {SA.ctes()}, {_QUICK.split(', quick AS')[1].join(['quick AS', ''])}, u AS (
      SELECT site_id, 0 AS src, check_id::BIGINT AS seq, check_name AS title, category, severity FROM checks WHERE NOT passed
      UNION ALL SELECT site_id, 1, page_seq, CASE type WHEN 'missing_description' THEN 'Missing Meta Description' WHEN 'missing_h1' THEN 'Missing H1'
        ELSE type END, 'Quick', severity FROM quick)
    SELECT site_id, title, src, seq, category, severity FROM u
    QUALIFY row_number() OVER (PARTITION BY site_id, title ORDER BY src, seq, category, severity) = 1""",
)
def a16(spark: SparkSession, sf: str) -> DataFrame:
    failed = counts(spark, sf).filter(~F.col("passed")).select(
        "site_id", F.col("check_id").cast("bigint").alias("seq"), F.col("check_name").alias("title"), "category", "severity"
    )
    t = F.col("type")
    name = F.when(t == "missing_description", "Missing Meta Description").when(t == "missing_h1", "Missing H1").otherwise(t)
    quick = _quick(spark, sf).select("site_id", F.col("page_seq").alias("seq"), name.alias("title"), F.lit("Quick").alias("category"), "severity")
    return I.report_issue_union(failed, quick)


@query("a17_open_issues", f"WITH {D.ISSUES} SELECT site_id, severity, count(*) AS issues FROM iss WHERE status = 'open' GROUP BY ALL")
def a17(spark: SparkSession, sf: str) -> DataFrame:
    return I.open_issues_by_severity(D.stored_issues(spark, sf))


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


@query(
    "a18_recommendation_lookup",
    f"""WITH {SA.ctes()}, g(t, d, w, h) AS (VALUES {', '.join(f'({_q(a)}, {_q(b)}, {_q(c)}, {_q(d)})' for a, b, c, d, _ in GUIDES)})
    SELECT site_id, check_name AS title, replace(coalesce(d, 'Issue detected: ' || check_name), '{{average_ttfb_ms}}', coalesce(average_ttfb_ms::VARCHAR, 'N/A')) AS description,
      coalesce(w, 'This issue may impact your site''s SEO performance.') AS why_it_matters,
      coalesce(h, 'Review the affected pages and implement the suggested fix.') AS how_to_fix
    FROM checks LEFT JOIN g ON t = check_name WHERE NOT passed""",
)
def a18(spark: SparkSession, sf: str) -> DataFrame:
    failed = checks(spark, sf).filter(~F.col("passed")).withColumnRenamed("check_name", "title").drop("details", "recommendation")
    return I.recommendation_lookup(failed).select("site_id", "title", "description", "why_it_matters", "how_to_fix")


@query(
    "a19_top_recommendations",
    f"""WITH {D.ISSUES}, p AS (SELECT site_id, title AS issue, severity, 'Do: ' || title AS recommendation, 1 AS src, 'ai_recommendation' AS category,
        row_number() OVER (PARTITION BY site_id ORDER BY seq) AS rn FROM iss WHERE severity = 'critical'),
    w AS (SELECT site_id, title AS issue, 'low' AS severity, title AS recommendation, 2 AS src, 'quick_win' AS category,
        row_number() OVER (PARTITION BY site_id ORDER BY seq) AS rn FROM iss WHERE severity = 'low'),
    t AS (SELECT site_id, title AS issue, severity, 'Fix: ' || title AS recommendation, 3 AS src, 'technical' AS category,
        row_number() OVER (PARTITION BY site_id ORDER BY seq) AS rn FROM iss),
    u AS (SELECT * FROM p WHERE rn <= 10 UNION ALL SELECT * FROM w WHERE rn <= 5 UNION ALL SELECT * FROM t WHERE rn <= 10),
    k AS (SELECT * FROM u QUALIFY src < 3 OR row_number() OVER (PARTITION BY site_id, issue ORDER BY src, rn) = 1)
    SELECT site_id, row_number() OVER (PARTITION BY site_id ORDER BY src, rn)::INT AS priority, category, issue, severity, recommendation
    FROM k QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY src, rn) <= 20""",
)
def a19(spark: SparkSession, sf: str) -> DataFrame:
    i = D.stored_issues(spark, sf).withColumnRenamed("title", "issue").select("site_id", "seq", "issue", "severity")
    text = F.concat(F.lit("Do: "), F.col("issue"))
    return I.top_recommendations(
        i.filter("severity = 'critical'").withColumn("recommendation", text), i.filter("severity = 'low'"), i
    )
