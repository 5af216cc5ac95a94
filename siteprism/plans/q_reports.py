"""Plan, content, report, link graph, listing and source/sink queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteprism.common import materialize, stage_dir
from siteprism.functions import urls as U
from siteprism.operators import audit as A
from siteprism.operators import content as C
from siteprism.operators import duplicates as N
from siteprism.operators import links as G
from siteprism.operators import reports as R
from siteprism.plans import facts as D
from siteprism.plans import pages as P
from siteprism.plans import sql_audit as SA
from siteprism.plans import sql_pages as S
from siteprism.plans.q_audit import _ISSUES, checks, checks_and_hits, counts
from siteprism.plans.q_keywords import _CL, _clusters
from siteprism.plans.registry import query, table
from siteprism.sources import io as IO

# ------------------------------------------------------------------------ plans


def _cluster_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of suppliers' order lines, six sites."""
    c, m = _clusters(spark, sf)
    n = m.groupBy("cluster_id").agg(F.count("*").alias("n_keywords"))
    return c.join(n, "cluster_id", "left").select(
        (F.col("cluster_id") % 6).alias("site_id"), "cluster_id", F.col("label").alias("name"), "intent", F.coalesce("n_keywords", F.lit(0)).alias("n_keywords")
    )


def _plan_issues(spark: SparkSession, sf: str) -> DataFrame:
    i = D.stored_issues(spark, sf).withColumn("site_id", F.col("site_id") % 6)
    return i.withColumn("type", F.concat("type", F.lit("_"), (F.col("audit_id") % 9).cast("string")))


_OPP = f"""{_CL}, {D.ISSUES}, cs AS (SELECT cluster_id % 6 AS site_id, cluster_id, label AS name, intent, (SELECT count(*) FROM mem m WHERE m.cluster_id = cl.cluster_id) AS n_keywords FROM cl),
pi AS (SELECT site_id % 6 AS site_id, type || '_' || (audit_id % 9) AS type, severity FROM iss),
t AS (SELECT site_id, type, count(*) AS n, min(CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END)::INT AS priority FROM pi GROUP BY ALL),
opp AS (SELECT site_id, 1 AS src, 'technical' AS type, type AS category, 'Fix Check ' || replace(substr(type, 7), '_', ' ') || ' Issues' AS title, 'Found ' || n || ' ' || type || ' issues to fix' AS description,
    priority, CASE WHEN n > 3 THEN 'medium' ELSE 'low' END AS effort, CASE WHEN priority <= 2 THEN 'high' ELSE 'medium' END AS impact FROM t
  UNION ALL SELECT site_id, 2, 'content', 'new_content', 'Create Content for: ' || name, 'Target ' || n_keywords || ' keywords with ' || intent || ' intent', CASE intent WHEN 'transactional' THEN 2 ELSE 3 END,
    'high', CASE WHEN n_keywords > 5 THEN 'high' ELSE 'medium' END FROM cs WHERE n_keywords > 0
  UNION ALL SELECT n_nationkey % 6, 3, 'technical', 'on_page', 'Add Missing H1 Tag', 'Homepage is missing H1 heading', 2, 'low', 'medium' FROM nation WHERE n_nationkey < 4),
kk AS (SELECT site_id, greatest(1, count(*) // 4) AS k FROM opp WHERE type = 'content' GROUP BY site_id),
r1 AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY priority, src, title) AS rank FROM opp WHERE effort = 'low' QUALIFY rank <= 5),
r2 AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY priority, src, title) AS rank FROM opp WHERE type = 'technical' AND effort <> 'low' QUALIFY rank <= 5),
r3 AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY priority, src, title) AS rank FROM opp WHERE type = 'content' QUALIFY rank <= 10),
plan0 AS (SELECT *, 1 AS phase, 1 AS week_start, 2 AS week_end FROM r1 UNION ALL SELECT *, 2, 2, 4 FROM r2
  UNION ALL SELECT r3.*, 3, least(4 + 2 * ((rank - 1) // k), 10)::INT, least(least(4 + 2 * ((rank - 1) // k), 10) + 2, 12)::INT FROM r3 JOIN kk USING (site_id)),
plan AS (SELECT * EXCLUDE priority, row_number() OVER (PARTITION BY site_id ORDER BY phase, rank)::INT AS priority FROM plan0)"""


def _opps(spark: SparkSession, sf: str) -> DataFrame:
    home = table(spark, sf, "nation").filter("n_nationkey < 4").select((F.col("n_nationkey") % 6).alias("site_id"), F.lit(0).alias("h1_count"))
    return C.opportunities(_plan_issues(spark, sf), _cluster_sizes(spark, sf), home)


@query("p01_opportunities", f"WITH {_OPP} SELECT site_id, type, category, title, description, priority, effort, impact FROM opp")
def p01(spark: SparkSession, sf: str) -> DataFrame:
    return _opps(spark, sf).drop("src")


@query("p02_action_plan", f"WITH {_OPP} SELECT site_id, priority, phase, title, type, effort, impact, week_start, week_end FROM plan")
def p02(spark: SparkSession, sf: str) -> DataFrame:
    return C.action_plan(_opps(spark, sf)).select("site_id", "priority", "phase", "title", "type", "effort", "impact", "week_start", "week_end")


@query("p03_content_calendar", f"WITH {_OPP} SELECT site_id, week_start AS week, (DATE '2024-01-31' + 7 * week_start)::DATE AS publish_date, title, 'planned' AS status FROM plan WHERE type = 'content'")
def p03(spark: SparkSession, sf: str) -> DataFrame:
    return C.content_calendar(C.action_plan(_opps(spark, sf)), F.lit("2024-01-31").cast("date")).drop("notes")


_BASIC = f"""{_CL}, {D.ISSUES}, bi AS (SELECT site_id % 6 AS site_id, seq, title, severity FROM iss),
bt AS (SELECT s_suppkey % 6 AS site_id, s_suppkey AS seq, s_name AS name, ['Rec A ' || s_suppkey, 'Rec B', 'Rec C'] AS recs FROM supplier),
bk AS (SELECT keyword_id % 5 AS site_id, * EXCLUDE site_id FROM kw),
q1 AS (SELECT site_id, row_number() OVER (PARTITION BY site_id ORDER BY seq) AS rank, 'Fix: ' || title AS task, 'technical' AS type, 1 AS phase, 1 AS part, 1 AS week_start FROM bi WHERE severity IN ('low', 'medium') QUALIFY rank <= 5),
q2 AS (SELECT site_id, row_number() OVER (PARTITION BY site_id ORDER BY seq) AS rank, 'Fix: ' || title AS task, 'technical' AS type, 2 AS phase, 1 AS part, 2 AS week_start FROM bi WHERE severity IN ('high', 'critical') QUALIFY rank <= 5),
q3 AS (SELECT site_id, t * 10 + p AS rank, '[' || name || '] ' || recs[p + 1] AS task, 'technical' AS type, 2 AS phase, 2 AS part, 3 AS week_start FROM
  (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY seq) AS t FROM bt QUALIFY t <= 5), (VALUES (0), (1)) v(p)),
q4 AS (SELECT site_id, row_number() OVER (PARTITION BY site_id ORDER BY coalesce(search_volume, 0)::DOUBLE / greatest(coalesce(nullif(difficulty, 0), 1), 1) DESC, keyword_id) AS rank,
  'Create ' || CASE intent WHEN 'transactional' THEN 'Landing Page' WHEN 'commercial' THEN 'Comparison/Review' WHEN 'navigational' THEN 'Service Page' ELSE 'Blog Post' END || ': ' || text AS task,
  'content' AS type, 3 AS phase, 1 AS part, (4 + (rank - 1) // 2) AS week_start FROM bk QUALIFY rank <= 10),
q5 AS (SELECT r_regionkey + 1 AS site_id, 1 AS rank, 'Create content for: ' || r_name AS task, 'content' AS type, 3 AS phase, 1 AS part, 4 AS week_start FROM region WHERE r_regionkey + 1 NOT IN (SELECT site_id FROM bk)),
bp AS (SELECT * FROM q1 UNION ALL SELECT * FROM q2 UNION ALL SELECT * FROM q3 UNION ALL SELECT * FROM q4 UNION ALL SELECT * FROM q5)"""


@query("p04_action_plan_basic", f"WITH {_BASIC} SELECT site_id, row_number() OVER (PARTITION BY site_id ORDER BY phase, part, rank)::INT AS priority, task, type, phase, week_start::INT AS week_start FROM bp")
def p04(spark: SparkSession, sf: str) -> DataFrame:
    issues = D.stored_issues(spark, sf).withColumn("site_id", F.col("site_id") % 6)
    k = F.col("s_suppkey")
    templates = table(spark, sf, "supplier").select(
        (k % 6).alias("site_id"), k.alias("seq"), F.col("s_name").alias("name"), F.lit(1).alias("page_count"),
        F.array(F.concat(F.lit("Rec A "), k.cast("string")), F.lit("Rec B"), F.lit("Rec C")).alias("recommendations"),
    )
    kw = D.keywords(spark, sf).withColumn("site_id", F.col("keyword_id") % 5)
    seeds = table(spark, sf, "region").select((F.col("r_regionkey") + 1).cast("bigint").alias("site_id"), F.col("r_regionkey").alias("seq"), F.col("r_name").alias("text"))
    return C.action_plan_basic(issues, templates, kw, seeds).select("site_id", "priority", "task", "type", "phase", "week_start")


@query(
    "p05_plan_summary",
    f"""WITH {_OPP}, c AS (SELECT site_id, count(*) AS kc, sum(n_keywords)::BIGINT AS tk FROM cs GROUP BY site_id),
    g AS (SELECT site_id, count(*) AS total_action_items, count_if(type = 'technical') AS technical_tasks, count_if(type = 'content') AS content_tasks,
      count_if(phase = 1) AS phase_1, count_if(phase = 2) AS phase_2, count_if(phase = 3) AS phase_3 FROM plan GROUP BY site_id)
    SELECT site_id, total_action_items, technical_tasks, content_tasks, phase_1, phase_2, phase_3, 'Fix ' || technical_tasks || ' technical issues' || chr(10) || 'Create ' || content_tasks || ' new content pieces'
      || chr(10) || 'Target ' || tk || ' keywords across ' || kc || ' topic clusters' || chr(10) || 'Improve SEO score from ' || (site_id * 10) || ' to 85+' AS expected_outcomes FROM g JOIN c USING (site_id)""",
)
def p05(spark: SparkSession, sf: str) -> DataFrame:
    clusters = _cluster_sizes(spark, sf)
    scores = clusters.select("site_id").distinct().withColumn("score", F.col("site_id") * 10)
    return C.plan_summary(C.action_plan(_opps(spark, sf)), scores, clusters).select(
        "site_id", "total_action_items", "technical_tasks", "content_tasks", "phase_1", "phase_2", "phase_3",
        F.array_join("expected_outcomes", "\n").alias("expected_outcomes"),
    )


@query(
    "p06_plan_stats",
    """SELECT o_custkey AS plan_id, count(*) AS total, count_if(o_orderstatus = 'O') AS todo, count_if(o_orderstatus = 'P') AS in_progress, count_if(o_orderstatus = 'F') AS done,
    count_if(o_orderstatus = 'F') / count(*) * 100 AS progress FROM orders GROUP BY o_custkey""",
)
def p06(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return C.plan_stats(table(spark, sf, "orders").select(
        F.col("o_custkey").alias("plan_id"), F.when(s == "O", "todo").when(s == "P", "in_progress").otherwise("done").alias("status")
    ))


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_B = ", ".join(f"({_lit(i)}, {w}, {_lit(chr(10).join(t))}, {_lit(m)}, {_lit(chr(10).join(o))}, {_lit(chr(10).join(c))})" for i, w, t, m, o, _, c in C.BRIEFS)
_CAP = "array_to_string([upper(left(p, 1)) || lower(substr(p, 2)) for p in regexp_extract_all(text, '[\\p{L}]+|[^\\p{L}]+')], '')"


@query(
    "p07_intent_brief",
    f"""WITH {D.KEYWORDS}, b(i, words, titles, meta, outline, ctas) AS (VALUES {_B})
    SELECT keyword_id, coalesce(intent, 'informational') AS intent, words AS target_word_count, replace(replace(titles, '{{k}}', text), '{{K}}', {_CAP}) AS title_suggestions,
      replace(meta, '{{k}}', text) AS meta_description, outline, ctas AS cta_suggestions FROM kw JOIN b ON i = coalesce(intent, 'informational')""",
)
def p07(spark: SparkSession, sf: str) -> DataFrame:
    b = C.intent_brief(D.keywords(spark, sf))
    return b.select(
        "keyword_id", "intent", "target_word_count", F.array_join("title_suggestions", "\n").alias("title_suggestions"), "meta_description",
        F.array_join("outline", "\n").alias("outline"), F.array_join("cta_suggestions", "\n").alias("cta_suggestions"),
    )


def _drafts(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    head = F.when(i % 3 == 0, F.lit("# Title\n## A\n## B\n## C\n")).when(i % 3 == 1, F.lit("text\n# x\n")).otherwise("")
    return table(spark, sf, "documents").select(
        i.alias("draft_id"), F.concat(head, "text").alias("body"), F.when(i % 4 == 0, "the").when(i % 4 == 1, "De").otherwise("zebra").alias("target_keyword"),
        F.when(i % 5 != 0, i % 1000).cast("int").alias("target_word_count"),
    )


_DRAFT = f"""dr0 AS (SELECT doc_id AS draft_id, CASE doc_id % 3 WHEN 0 THEN '# Title' || chr(10) || '## A' || chr(10) || '## B' || chr(10) || '## C' || chr(10) WHEN 1 THEN 'text' || chr(10) || '# x' || chr(10) ELSE '' END || text AS body,
  CASE doc_id % 4 WHEN 0 THEN 'the' WHEN 1 THEN 'de' ELSE 'zebra' END AS kw, CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 1000)::INT ELSE 1500 END AS target FROM documents),
dr AS (SELECT *, {S.n_words('body')} AS n, (length(lower(body)) - length(replace(lower(body), kw, ''))) // length(kw) AS kc, contains(body, '# ') AS has_h1,
  (length(body) - length(replace(body, chr(10) || '#', ''))) // 2 AS heads FROM dr0)"""


@query(
    "p08_content_score",
    f"""WITH {_DRAFT} SELECT draft_id, n::INT AS word_count, kc::INT AS keyword_count, round(kc * 100.0::DOUBLE / n, 2) AS keyword_density, heads::INT AS heading_count,
    greatest(0, 100 - CASE WHEN n < 300 THEN 20 WHEN n < 1000 THEN 10 ELSE 0 END - CASE WHEN kc / n * 100 < 0.5 THEN 10 WHEN kc / n * 100 > 3 THEN 15 ELSE 0 END
      - CASE WHEN has_h1 THEN 0 ELSE 15 END - CASE WHEN heads < 3 THEN 5 ELSE 0 END)::INT AS score FROM dr""",
)
def p08(spark: SparkSession, sf: str) -> DataFrame:
    return C.content_score(_drafts(spark, sf)).select("draft_id", "word_count", "keyword_count", "keyword_density", "heading_count", "score")


@query(
    "p09_draft_check",
    f"""WITH {_DRAFT}, d AS (SELECT *, round(kc / n * 100, 2) AS k FROM dr) SELECT draft_id, k AS keyword_density, (100 - CASE WHEN n < target * 0.8::DOUBLE THEN 10 ELSE 0 END
      - CASE WHEN k < 0.5 THEN 10 WHEN k > 3 THEN 20 ELSE 0 END - CASE WHEN has_h1 THEN 0 ELSE 15 END - CASE WHEN heads < 3 THEN 5 ELSE 0 END)::INT AS score FROM d""",
)
def p09(spark: SparkSession, sf: str) -> DataFrame:
    return C.draft_check(_drafts(spark, sf)).select("draft_id", "keyword_density", "score")


@query("p10_next_version", "SELECT conv_id AS brief_id, max(turn) + 1 AS next_version FROM conversations GROUP BY conv_id")
def p10(spark: SparkSession, sf: str) -> DataFrame:
    return C.next_version(table(spark, sf, "conversations").select(F.col("conv_id").alias("brief_id"), F.col("turn").alias("version")))


# ---------------------------------------------------------------------- reports

_ALL_FIXES = f"""{_ISSUES}, fx AS (SELECT i.site_id, h.url, title, severity, fix FROM issues i JOIN hits h ON h.site_id = i.site_id AND h.check_id = i.check_id WHERE h.url IS NOT NULL
  UNION ALL SELECT i.site_id, base_url, title, severity, fix FROM issues i JOIN site s ON s.site_id = i.site_id WHERE urls = ''),
fc AS (SELECT site_id, url, count_if(severity = 'critical') AS critical, count_if(severity = 'high') AS high, count_if(severity = 'medium') AS medium, count_if(severity = 'low') AS low FROM fx GROUP BY ALL)"""


def _all_fixes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c, hits = checks_and_hits(spark, sf)
    return R.page_fixes(A.to_issues(c), P.sites(spark, sf), hits)


_PAGE_FIXES = f"WITH {_ALL_FIXES} SELECT site_id, url, critical, high, medium, low, critical + high + medium + low AS total, critical * 100 + high * 10 + medium AS weight FROM fc"
_PAGE_FIX_ROWS = f"WITH {_ALL_FIXES} SELECT site_id, url, title, severity, fix FROM fx"


@query("r01_page_fixes", _PAGE_FIXES)
@query("r01_page_fixes_uncut", _PAGE_FIXES)
def r01(spark: SparkSession, sf: str) -> DataFrame:
    """Every page that a check hits."""
    return _all_fixes(spark, sf)[1]


@query("r01_page_fix_rows", _PAGE_FIX_ROWS)
@query("r01_page_fix_rows_uncut", _PAGE_FIX_ROWS)
def r01r(spark: SparkSession, sf: str) -> DataFrame:
    return _all_fixes(spark, sf)[0].select("site_id", "url", "title", "severity", "fix")


@query(
    "r02_audit_report",
    f"""WITH {_ISSUES} SELECT site_id, severity, title, urls, CASE WHEN affected_count > (CASE WHEN urls = '' THEN 0 ELSE len(string_split(urls, chr(10))) END)
    THEN '... and ' || (affected_count - CASE WHEN urls = '' THEN 0 ELSE len(string_split(urls, chr(10))) END) || ' more' ELSE '' END AS more FROM issues""",
)
def r02(spark: SparkSession, sf: str) -> DataFrame:
    return R.audit_report(A.to_issues(checks(spark, sf))).select("site_id", "severity", "title", F.array_join("urls", "\n").alias("urls"), "more")


@query(
    "r03_executive_summary",
    f"""WITH {SA.ctes()}, s AS (SELECT site_id, {SA.SCORE} AS score, count(*) AS total_checks, count_if(passed) AS passed_checks, count_if(NOT passed AND severity = 'critical') AS critical,
      array_to_string((list(check_name ORDER BY check_id) FILTER (NOT passed))[1:5], ',') AS top_issues FROM {SA.WEIGHTED} GROUP BY site_id)
    SELECT site_id, score, CASE WHEN score >= 95 THEN 'A+' WHEN score >= 90 THEN 'A' WHEN score >= 85 THEN 'B+' WHEN score >= 80 THEN 'B' WHEN score >= 75 THEN 'C+' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade,
      critical, round(passed_checks / total_checks * 100, 1) AS pass_rate, top_issues FROM s""",
)
def r03(spark: SparkSession, sf: str) -> DataFrame:
    return R.executive_summary(checks(spark, sf)).select("site_id", "score", "grade", "critical", "pass_rate", F.array_join("top_issues", ",").alias("top_issues"))


@query(
    "r04_category_listing",
    f"""WITH {SA.ctes()} SELECT site_id, category, string_agg(check_name || CASE WHEN passed THEN ': passed' ELSE ': failed' END, chr(10) ORDER BY check_id) AS checks,
    floor(count_if(passed) / count(*)::DOUBLE * 100)::INT AS score FROM checks GROUP BY ALL""",
)
def r04(spark: SparkSession, sf: str) -> DataFrame:
    return R.category_listing(counts(spark, sf)).select("site_id", "category", F.array_join("checks", "\n").alias("checks"), "score")


_SITES3 = """st AS (SELECT c_custkey AS site_id, c_nationkey AS tenant_id, TIMESTAMP '2001-08-01' - to_days((c_custkey % 30)::INT) AS updated_at FROM customer),
la AS (SELECT site_id, audit_id, score FROM runs WHERE status = 'completed' QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY completed_at DESC, audit_id DESC) = 1)"""


def _tenant_sites(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        c.alias("site_id"), F.col("c_nationkey").alias("tenant_id"),
        (F.lit("2001-08-01").cast("timestamp_ntz") - F.make_dt_interval((c % 30).cast("int"))).alias("updated_at"),
    )


def _site_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return D.keywords(spark, sf).withColumn("site_id", F.col("keyword_id"))


@query(
    "r05_weekly_report",
    f"""WITH {D.KEYWORDS}, {D.RUNS}, {_SITES3}, k AS (SELECT keyword_id AS site_id, count(*) AS t, count_if(is_tracked) AS r FROM kw GROUP BY keyword_id)
    SELECT site_id, score, coalesce(t, 0) AS keywords_total, coalesce(r, 0) AS keywords_tracked FROM st LEFT JOIN la USING (site_id) LEFT JOIN k USING (site_id) WHERE updated_at >= TIMESTAMP '2001-08-01' - INTERVAL 7 DAY""",
)
def r05(spark: SparkSession, sf: str) -> DataFrame:
    return R.weekly_report(_tenant_sites(spark, sf), D.audit_runs(spark, sf), _site_keywords(spark, sf), F.lit("2001-08-01").cast("timestamp_ntz"))


@query(
    "r06_tenant_dashboard",
    f"""WITH {D.RUNS}, {_SITES3} SELECT tenant_id, count(*) AS sites, coalesce(sum(a), 0)::BIGINT AS audits, coalesce(sum(k), 0)::BIGINT AS keywords FROM st
    LEFT JOIN (SELECT site_id, count(*) AS a FROM runs GROUP BY 1) USING (site_id) LEFT JOIN (SELECT p_partkey AS site_id, count(*) AS k FROM part GROUP BY 1) USING (site_id) GROUP BY tenant_id""",
)
def r06(spark: SparkSession, sf: str) -> DataFrame:
    return R.tenant_dashboard(_tenant_sites(spark, sf), {"audits": D.audit_runs(spark, sf), "keywords": _site_keywords(spark, sf)})


@query(
    "r07_site_dashboard",
    f"""WITH {D.RUNS}, {D.ISSUES}, {_SITES3}, o AS (SELECT site_id, {', '.join(f"count_if(severity = '{x}') AS {x}" for x in ('critical', 'high', 'medium', 'low'))} FROM iss WHERE status = 'open' GROUP BY site_id)
    SELECT site_id, audit_id, score, {', '.join(f'coalesce({x}, 0) AS {x}' for x in ('critical', 'high', 'medium', 'low'))}, coalesce(k, 0) AS keywords FROM st LEFT JOIN la USING (site_id) LEFT JOIN o USING (site_id)
    LEFT JOIN (SELECT p_partkey AS site_id, count(*) AS k FROM part GROUP BY 1) USING (site_id)""",
)
def r07(spark: SparkSession, sf: str) -> DataFrame:
    return R.site_dashboard(_tenant_sites(spark, sf), D.audit_runs(spark, sf), D.stored_issues(spark, sf), {"keywords": _site_keywords(spark, sf)})


# ------------------------------------------------------------------- link graph


def _linked(spark: SparkSession, sf: str) -> DataFrame:
    return P.features(spark, sf, ["internal_links"])


_LINKS = f"WITH {S.FEATURES}, {SA.LINKS.strip()}"


@query("l01_links", f"WITH {S.FEATURES}, e AS (SELECT site_id, page_seq, unnest(internal_links) AS l FROM feat) SELECT site_id, page_seq, l.url AS dst, l.text AS text, l.nofollow AS nofollow FROM e")
def l01(spark: SparkSession, sf: str) -> DataFrame:
    return G.links(_linked(spark, sf)).select("site_id", "page_seq", "dst", "text", "nofollow")


@query("l02_in_degree", f"{_LINKS} SELECT site_id, dst, n AS in_degree FROM indeg")
def l02(spark: SparkSession, sf: str) -> DataFrame:
    return G.in_degree(G.links(_linked(spark, sf)))


@query("l02_out_degree", f"{_LINKS} SELECT site_id, src, count(DISTINCT dst) AS out_degree FROM edges GROUP BY ALL")
def l02o(spark: SparkSession, sf: str) -> DataFrame:
    return G.out_degree(G.links(_linked(spark, sf)))


def _tree(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Order graph: seven sites, each order links to the orders 3k, 3k+7 and back to k/2."""
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select(k, (k % 7).alias("site_id"))
    nxt = F.explode(F.array(k * 8, k * 8 + 7, k * 8 + 14, (k / 16).cast("bigint") * 7 + k % 7)).alias("d")
    node = lambda c: F.concat(F.lit("u"), c.cast("string"))
    raw = o.select("site_id", k, nxt)
    known = o.select(k.alias("d"))
    edges = raw.join(known, "d").select("site_id", node(k).alias("src"), node(F.col("d")).alias("dst"))
    roots = o.filter(k < 7).select("site_id", node(k).alias("url"))
    seeds = o.filter(k % 1000 == 999).select("site_id", node(k).alias("url"))
    return edges, roots, seeds


@query(
    "l03_crawl_depth",
    """WITH RECURSIVE o AS (SELECT o_orderkey AS k FROM orders),
    e AS (SELECT a.k AS s, b.k AS d FROM (SELECT k, unnest([k * 8, k * 8 + 7, k * 8 + 14, (k // 16) * 7 + k % 7]) AS t FROM o) a JOIN o b ON b.k = a.t),
    w AS (SELECT k, 0 AS depth FROM o WHERE k < 7 UNION SELECT k, 1 FROM o WHERE k % 1000 = 999 UNION SELECT e.d, w.depth + 1 FROM w JOIN e ON e.s = w.k WHERE w.depth < 40)
    SELECT k % 7 AS site_id, 'u' || k AS url, min(depth)::INT AS depth FROM w GROUP BY k""",
)
def l03(spark: SparkSession, sf: str) -> DataFrame:
    return G.crawl_depth(*_tree(spark, sf))


@query("l04_frontier", f"{_LINKS} SELECT DISTINCT site_id, dst AS url FROM edges e WHERE NOT EXISTS (SELECT 1 FROM feat f WHERE f.site_id = e.site_id AND f.url = e.dst)")
def l04(spark: SparkSession, sf: str) -> DataFrame:
    return G.frontier(_linked(spark, sf))


@query(
    "l05_is_internal",
    f"""WITH {S.FEATURES}, u AS (SELECT site_id, unnest(internal_links || external_links).url AS url FROM feat) SELECT site_id, url, {S.is_internal(S.host('url'), 'site_id')} AS is_internal, count(*) AS n FROM u GROUP BY ALL""",
)
def l05(spark: SparkSession, sf: str) -> DataFrame:
    f = P.features(spark, sf, ["internal_links", "external_links"])
    u = f.select("site_id", F.explode(F.concat("internal_links", "external_links")).alias("l")).select("site_id", F.col("l.url").alias("url"))
    s = P.sites(spark, sf).select("site_id", F.concat(F.lit("https://"), "site_id").alias("base_url"))
    return G.internal_urls(u, s).groupBy("site_id", "url", "is_internal").agg(F.count("*").alias("n"))


@query(
    "l06_robots_allowed",
    f"""WITH {S.RICH} SELECT page_id, NOT (hub_id % 4 <> 0 AND (starts_with({S.path('url')}, '/en/') OR (hub_id % 3 = 0 AND starts_with({S.path('url')}, '/CSS')))) AS allowed FROM rich""",
)
def l06(spark: SparkSession, sf: str) -> DataFrame:
    p = P.raw_pages(spark, sf).select("page_id", "site_id", "url")
    return G.robots_allowed(p, P.robots(spark, sf), "OtherBot").select("page_id", "allowed")


@query("l07_seed_filter", "SELECT p_partkey AS seq FROM part")
def l07(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    urls = table(spark, sf, "part").select((k % 3).alias("site_id"), k.alias("seq"), F.concat(F.lit("https://a.site"), (k % 3).cast("string"), F.lit(".test/"), k.cast("string")).alias("url"))
    s = urls.select("site_id").distinct().withColumn("base_url", F.concat(F.lit("https://www.site"), F.col("site_id").cast("string"), F.lit(".test")))
    return G.seed_filter(urls, s).select("seq")


@query("l08_crawl_stats", "SELECT l_orderkey AS crawl_id, count(*) AS pages_crawled, sum(l_linenumber % 3)::BIGINT AS errors_count, count_if(l_returnflag = 'R') AS js_rendered_count FROM lineitem GROUP BY l_orderkey")
def l08(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("crawl_id"), F.array_repeat(F.lit("timeout"), F.col("l_linenumber") % 3).alias("errors"), (F.col("l_returnflag") == "R").alias("js_rendered")
    )
    return G.crawl_stats(li, ["crawl_id"])


def _near_sql(site: str) -> str:
    return f"""WITH w AS (SELECT {site} AS site_id, doc_id, {S.word_list('lower(text)')} AS w FROM documents),
    s AS (SELECT DISTINCT site_id, doc_id, array_to_string(w[i : i + 2], ' ') AS s FROM w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) u(i) WHERE len(w) > 0),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT a.site_id, a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.site_id = b.site_id AND a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL)
    SELECT c.site_id, b AS page_seq, b::VARCHAR AS url, min(a)::VARCHAR AS near_duplicate_of, arg_min(k / (x.n + y.n - k), a) AS similarity
    FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k) GROUP BY c.site_id, b"""


def _near(spark: SparkSession, sf: str, site) -> DataFrame:
    d = table(spark, sf, "documents").select(site.alias("site_id"), F.col("doc_id").alias("page_seq"), F.col("doc_id").cast("string").alias("url"), F.col("text").alias("text_content"))
    return N.near_duplicates(d)


@query("f13_near_duplicates", _near_sql("source"))
def f13(spark: SparkSession, sf: str) -> DataFrame:
    """Near copies among the documents of a source."""
    return _near(spark, sf, F.col("source"))


@query("f13_near_duplicates_lang", _near_sql("lang"))
def f13_lang(spark: SparkSession, sf: str) -> DataFrame:
    """Near copies among the documents of a language: few, large sites."""
    return _near(spark, sf, F.col("lang"))


@query("d01_duplicate_content", "SELECT source AS site_id, doc_id AS page_seq, count(*) OVER (PARTITION BY source, md5(text)) AS group_size FROM documents QUALIFY group_size > 1")
def d01(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(
        F.col("source").alias("site_id"), F.col("doc_id").alias("page_seq"), F.col("doc_id").cast("string").alias("url"), F.lit(200).alias("status_code"), "text"
    )
    return A.duplicate_groups(d, F.md5("text")).select("site_id", "page_seq", "group_size")


# --------------------------------------------------------------------- listings


@query("q01_listing", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def q01(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = R.listing(table(spark, sf, "orders"), {"o_orderstatus": "O"}, [F.col("o_orderdate").desc(), F.col("o_orderkey")], 3)
    return rows.select("o_orderkey", "o_orderdate")


@query("q01_listing_total", "SELECT count(*) AS total, ceil(count(*) / 20)::BIGINT AS pages FROM orders WHERE o_orderstatus = 'O'")
def q01t(spark: SparkSession, sf: str) -> DataFrame:
    return R.listing(table(spark, sf, "orders"), {"o_orderstatus": "O"})[1]


@query("q02_search", "SELECT p_partkey FROM part WHERE p_name ILIKE '%BOLT%' OR p_brand ILIKE '%BOLT%'")
def q02(spark: SparkSession, sf: str) -> DataFrame:
    return R.search(table(spark, sf, "part"), ["p_name", "p_brand"], "BOLT").select("p_partkey")


@query("q03_predicates", f"WITH {D.KEYWORDS} SELECT keyword_id FROM kw WHERE intent IN ('commercial', 'navigational') AND previous_position IS NULL AND current_position BETWEEN 10 AND 60")
def q03(spark: SparkSession, sf: str) -> DataFrame:
    k = D.keywords(spark, sf)
    return k.filter(F.col("intent").isin("commercial", "navigational") & F.col("previous_position").isNull() & F.col("current_position").between(10, 60)).select("keyword_id")


@query("q04_nulls_last", f"WITH {D.KEYWORDS} SELECT keyword_id, search_volume FROM kw ORDER BY search_volume DESC NULLS LAST, keyword_id LIMIT 40")
def q04(spark: SparkSession, sf: str) -> DataFrame:
    return D.keywords(spark, sf).orderBy(F.col("search_volume").desc_nulls_last(), "keyword_id").limit(40).select("keyword_id", "search_volume")


@query("q05_join", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def q05(spark: SparkSession, sf: str) -> DataFrame:
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select("o_orderkey", "c_name", "n_name")


@query("q06_with_children", "SELECT c_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def q06(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    out = R.with_children(table(spark, sf, "customer").select("c_custkey"), o, "c_custkey", "o_orderkey", ["o_orderkey"], "orders")
    return out.select("c_custkey", F.array_join(F.transform("orders", lambda x: x["o_orderkey"].cast("string")), ",").alias("orders"))


@query("q07_aggregates", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 6) AS mean, max(o_orderdate) AS last, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY o_custkey")
def q07(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("o_totalprice")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.round(F.sum(p), 2).alias("total"), F.round(F.avg(p), 6).alias("mean"), F.max("o_orderdate").alias("last"),
        F.countDistinct("o_orderpriority").alias("kinds"),
    )


@query("q08_tenant", "SELECT c_custkey AS site_id FROM customer WHERE c_nationkey = 7")
def q08(spark: SparkSession, sf: str) -> DataFrame:
    return R.for_tenant(_tenant_sites(spark, sf), 7).select("site_id")


# -------------------------------------------------------------- sources and sinks


def _folder(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{stage_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("io01_read_pages", f"SELECT page_id, {S.host('url')} AS tenant_id, length(html)::INT AS n FROM pages WHERE {S.host('url')} = (SELECT min({S.host('url')}) FROM pages)")
def io01(spark: SparkSession, sf: str) -> DataFrame:
    """Pages written by tenant, read back with the tenant predicate (pruned)."""
    path = _folder(spark, "pages")
    pages = P.raw_pages(spark, sf).withColumnRenamed("site_id", "tenant_id")
    pages.write.partitionBy("tenant_id").parquet(path)
    return IO.read_pages(spark, path, pages.agg(F.min("tenant_id")).first()[0]).select("page_id", "tenant_id", F.length("html").alias("n"))


@query("io01_stored_html", "SELECT page_id, left(md5(url), 12) AS storage_key, length(html)::INT AS n, md5(html) AS digest FROM pages")
def io01_html(spark: SparkSession, sf: str) -> DataFrame:
    """Pages stored as an object each, read back by key and joined to their rows."""
    path = _folder(spark, "objects")
    pages = P.raw_pages(spark, sf)
    IO.write_html(pages, path)
    rows = pages.select("page_id", IO.storage_key(F.col("url")).alias("storage_key")).join(IO.read_html(spark, path), "storage_key")
    return rows.select("page_id", "storage_key", F.length("html").alias("n"), F.md5("html").alias("digest"))


@query("io02_robots_facts", f"WITH {S.RICH} SELECT site_id, CASE WHEN content IS NULL THEN '' ELSE 'https://' || site_id || '/sitemap.xml' END AS sitemap_urls, CASE WHEN content IS NULL THEN NULL WHEN hub_id % 5 = 0 OR hub_id % 7 = 0 THEN 3 ELSE hub_id % 7 END::DOUBLE AS crawl_delay FROM site JOIN robots USING (site_id)")
def io02(spark: SparkSession, sf: str) -> DataFrame:
    return IO.robots_facts(P.robots(spark, sf)).select("site_id", F.array_join("sitemap_urls", ",").alias("sitemap_urls"), "crawl_delay")


def _sitemap_docs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Nested sitemaps: region → nation → supplier pages."""
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier")
    url = lambda p, c: F.concat(F.lit(f"https://x.test/{p}"), F.col(c).cast("string"), F.lit(".xml"))
    loc = lambda c: F.concat(F.lit("<url><loc> "), c, F.lit(" </loc></url>"))
    regions = n.groupBy("n_regionkey").agg(F.array_join(F.collect_list(loc(url("n", "n_nationkey"))), "").alias("xml")).select(url("r", "n_regionkey").alias("url"), "xml")
    page = F.concat(F.lit("https://x.test/s/"), F.col("s_suppkey").cast("string"))
    nations = s.groupBy("s_nationkey").agg(F.array_join(F.collect_list(loc(page)), "").alias("xml")).select(url("n", "s_nationkey").alias("url"), "xml")
    roots = table(spark, sf, "region").select(F.col("r_name").alias("site_id"), url("r", "r_regionkey").alias("url"))
    return regions.unionByName(nations), roots


@query("io03_sitemap_urls", "SELECT r_name AS site_id, 'https://x.test/s/' || s_suppkey AS url, 1 AS depth FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def io03(spark: SparkSession, sf: str) -> DataFrame:
    return IO.sitemap_urls(*_sitemap_docs(spark, sf))


@query("io04_serp_json", f"WITH {D.SERP} SELECT keyword, type, rank_group, domain, url, title, has_links, has_rating FROM serp")
def io04(spark: SparkSession, sf: str) -> DataFrame:
    """Result payloads built from the SERP facts, then parsed."""
    i = D.serp_items(spark, sf)
    item = F.struct(
        "type", "rank_group", "domain", "url", "title", F.when(F.col("has_links"), F.array(F.lit("a"))).alias("links"),
        F.when(F.col("has_rating"), F.struct(F.lit(5).alias("value"))).alias("rating"),
    )
    doc = F.struct(F.array(F.struct(F.array(F.struct(F.collect_list(item).alias("items"))).alias("result"))).alias("tasks"))
    raw = i.groupBy("keyword").agg(F.to_json(doc).alias("json"))
    return IO.serp_items(raw).select("keyword", "type", "rank_group", "domain", "url", "title", "has_links", "has_rating")


@query(
    "io05_keyword_json",
    f"WITH {D.KEYWORDS} SELECT keyword_id, text, search_volume, cpc::DOUBLE AS cpc, competition::DOUBLE AS competition, difficulty, coalesce(intent, 'navigational') AS intent FROM kw",
)
def io05(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword payloads built from the keyword table, then parsed."""
    info = F.struct("search_volume", "cpc", "competition", F.create_map(F.coalesce("intent", F.lit("navigational")), F.lit(True)).alias("search_intent_info"))
    doc = F.struct(F.col("text").alias("keyword"), info.alias("keyword_info"), F.struct(F.col("difficulty").alias("keyword_difficulty")).alias("keyword_properties"))
    raw = D.keywords(spark, sf).select("keyword_id", F.to_json(doc).alias("json"))
    return IO.keyword_rows(raw).select("keyword_id", "text", "search_volume", F.col("cpc").cast("double"), F.col("competition").cast("double"), "difficulty", "intent")


_WRITTEN = f"""WITH {_ISSUES} SELECT 'run' AS part, site_id, NULL::INT AS check_id, NULL AS url, {SA.SCORE}::BIGINT AS n FROM {SA.WEIGHTED} GROUP BY site_id
    UNION ALL SELECT 'check', site_id, check_id, NULL, passed::BIGINT FROM checks
    UNION ALL SELECT 'issue', site_id, check_id, NULL, affected_count FROM issues
    UNION ALL SELECT 'hit', site_id, check_id, url, n::BIGINT FROM hits"""


@query("io07_write_audit", _WRITTEN)
@query("io07_write_audit_uncut", _WRITTEN)
def io07(spark: SparkSession, sf: str) -> DataFrame:
    """The tables of all 100 checks and of their uncut hits, written by tenant and all read back."""
    c, hits = checks_and_hits(spark, sf, with_details=True)
    c = materialize(c)
    owned = lambda df: df.withColumn("tenant_id", F.lit("t1"))
    path = _folder(spark, "audit")
    IO.write_audit(path, owned(A.audit_score(c)), owned(c), owned(A.to_issues(c)), hits=owned(hits))
    none = lambda kind: F.lit(None).cast(kind)
    parts = [
        ("run", "audit_runs", none("int"), none("string"), "score"), ("check", "seo_audit_checks", "check_id", none("string"), "passed"),
        ("issue", "seo_issues", "check_id", none("string"), "affected_count"), ("hit", "seo_audit_hits", "check_id", "url", "n"),
    ]
    column = lambda x: F.col(x) if isinstance(x, str) else x
    read = [
        spark.read.parquet(f"{path}/{name}").select(
            F.lit(part).alias("part"), "site_id", column(check).alias("check_id"), column(url).alias("url"), F.col(n).cast("bigint").alias("n")
        )
        for part, name, check, url, n in parts
    ]
    return read[0].unionByName(read[1]).unionByName(read[2]).unionByName(read[3])


@query("io08_issue_export", f"WITH {D.ISSUES} SELECT category AS \"Category\", severity AS \"Severity\", title AS \"Title\", type AS \"Description\", url AS \"Affected URL\", status AS \"Recommendation\" FROM iss")
def io08(spark: SparkSession, sf: str) -> DataFrame:
    """Issue export written as CSV and read back."""
    path = _folder(spark, "issues")
    IO.write_csv(IO.issue_export(D.stored_issues(spark, sf).withColumns({"description": F.col("type"), "fix": F.col("status")})), path)
    cols = ", ".join(f"`{c}` string" for c in ("Category", "Severity", "Title", "Description", "Affected URL", "Recommendation"))
    return spark.read.option("header", True).schema(cols).csv(path)


@query(
    "io09_keyword_export",
    f"""WITH {D.KEYWORDS} SELECT text AS "Keyword", coalesce(search_volume::VARCHAR, '') AS "Search Volume", coalesce(difficulty::VARCHAR, '') AS "Difficulty", coalesce(intent, '') AS "Intent",
    coalesce(current_position::VARCHAR, '') AS "Current Position", is_tracked::VARCHAR AS "Is Tracked" FROM kw""",
)
def io09(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword export written as JSON and read back."""
    path = _folder(spark, "keywords")
    out = IO.keyword_export(D.keywords(spark, sf), True).drop("CPC", "Competition")
    IO.write_json(out, path)
    return spark.read.schema(out.schema).json(path)


@query(
    "io10_site_export",
    f"""WITH {D.RUNS}, {D.KEYWORDS} SELECT site_id::VARCHAR AS site_id, 'audits' AS section, '{{"audit_id":' || audit_id || CASE WHEN score IS NULL THEN '' ELSE ',"score":' || score END || ',"status":"' || status || '"}}' AS record
      FROM runs QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY completed_at DESC, audit_id DESC) <= 10
    UNION ALL SELECT p_partkey::VARCHAR, 'content_briefs', '{{"brief_id":' || p_partkey || ',"target_keyword":"' || p_name || '","status":"draft"}}' FROM part
    UNION ALL SELECT keyword_id::VARCHAR, 'keywords', '{{"keyword":"' || text || '"' || CASE WHEN search_volume IS NULL THEN '' ELSE ',"search_volume":' || search_volume END ||
      CASE WHEN current_position IS NULL THEN '' ELSE ',"position":' || current_position END || ',"is_tracked":' || CASE WHEN is_tracked THEN 'true' ELSE 'false' END || '}}' FROM kw""",
)
def io10(spark: SparkSession, sf: str) -> DataFrame:
    k = table(spark, sf, "part")
    briefs = k.select(F.col("p_partkey").alias("site_id"), F.col("p_partkey").alias("brief_id"), F.col("p_name").alias("target_keyword"), F.lit("draft").alias("status"))
    words = D.keywords(spark, sf).withColumn("site_id", F.col("keyword_id"))
    return IO.site_export(D.audit_runs(spark, sf), words, briefs).withColumn("site_id", F.col("site_id").cast("string"))


@query("l09_link_hosts", f"WITH {S.FEATURES}, u AS (SELECT unnest(external_links).url AS url FROM feat) SELECT {S.host('url')} AS host, count(*) AS n FROM u GROUP BY ALL")
def l09(spark: SparkSession, sf: str) -> DataFrame:
    f = P.features(spark, sf, ["external_links"]).select(F.explode("external_links").alias("l"))
    return f.groupBy(U.host(F.col("l.url")).alias("host")).agg(F.count("*").alias("n"))
