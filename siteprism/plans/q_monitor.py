"""Page speed, monitoring and usage queries over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteprism.operators import limits as L
from siteprism.operators import monitor as M
from siteprism.operators import vitals as V
from siteprism.plans import facts as D
from siteprism.plans.registry import query, table

AS_OF = "2024-01-31"


def as_of() -> F.Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def _t(c: str) -> str:
    return f"TIMESTAMP '{AS_OF}' - INTERVAL {c}"


# ------------------------------------------------------------------- page speed


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots: user = URL, event type decides the strategy, value the metrics."""
    v, e = F.col("value"), F.col("event_id")
    s = table(spark, sf, "events").select(
        e.alias("snapshot_id"), F.concat(F.lit("s"), (F.col("user_id") % 10).cast("string")).alias("site_id"),
        F.concat(F.lit("https://x.test/"), F.col("user_id").cast("string")).alias("url"),
        F.when(F.col("event_type").isin("view", "click", "error"), "mobile").otherwise("desktop").alias("strategy"),
        F.col("event_type").alias("template_type"), F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("checked_at"),
        F.when(e % 17 != 0, e * 7 % 101).cast("int").alias("performance_score"), F.floor(v * 50).cast("int").alias("lcp_ms"),
        F.floor(v * 10).cast("int").alias("tbt_ms"), ((e % 40) / 100.0).alias("cls"), F.floor(v * 30).cast("int").alias("fcp_ms"),
        F.floor(v * 8).cast("int").alias("ttfb_ms"),
    )
    opp = lambda k, m: F.struct(
        F.concat(F.lit("opp-"), (F.col("snapshot_id") % m).cast("string")).alias("id"),
        F.concat(F.lit("Title "), (F.col("snapshot_id") % m).cast("string"), F.lit("/"), (F.col("snapshot_id") % 3).cast("string")).alias("title"),
        (F.col("snapshot_id") % k).cast("int").alias("savings_ms"), (F.col("snapshot_id") % 1000).cast("int").alias("savings_bytes"),
        ((F.col("snapshot_id") % 100) / 100.0).alias("score"),
    )
    return s.withColumns({"cwv_status": V.cwv_status(F.col("lcp_ms"), F.col("cls"), F.col("tbt_ms")), "opportunities": F.array(opp(700, 12))})


_SNAP = """snap AS (SELECT event_id AS snapshot_id, 's' || (user_id % 10) AS site_id, 'https://x.test/' || user_id AS url,
  CASE WHEN event_type IN ('view', 'click', 'error') THEN 'mobile' ELSE 'desktop' END AS strategy, event_type AS template_type, date_trunc('day', ts)::TIMESTAMP AS checked_at,
  CASE WHEN event_id % 17 <> 0 THEN (event_id * 7 % 101)::INT END AS performance_score, floor(value * 50)::INT AS lcp_ms, floor(value * 10)::INT AS tbt_ms,
  (event_id % 40) / 100.0::DOUBLE AS cls, floor(value * 30)::INT AS fcp_ms, floor(value * 8)::INT AS ttfb_ms,
  'opp-' || (event_id % 12) AS opp_id, 'Title ' || (event_id % 12) || '/' || (event_id % 3) AS opp_title, (event_id % 700)::INT AS opp_ms,
  (event_id % 1000)::INT AS opp_bytes, (event_id % 100) / 100.0::DOUBLE AS opp_score FROM events),
sc AS (SELECT *, CASE greatest(CASE WHEN lcp_ms <= 2500 THEN 1 WHEN lcp_ms <= 4000 THEN 2 ELSE 3 END, CASE WHEN cls <= 0.1::DOUBLE THEN 1 WHEN cls <= 0.25::DOUBLE THEN 2 ELSE 3 END,
  CASE WHEN tbt_ms <= 200 THEN 1 WHEN tbt_ms <= 600 THEN 2 ELSE 3 END) WHEN 1 THEN 'good' WHEN 2 THEN 'needs_improvement' ELSE 'poor' END AS cwv_status FROM snap)"""
_LATEST = _SNAP + """, newest AS (SELECT * FROM sc QUALIFY checked_at = max(checked_at) OVER (PARTITION BY site_id, url, strategy)),
lat AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY checked_at DESC, snapshot_id)::INT AS recency FROM newest)"""


def _psi(spark: SparkSession, sf: str) -> DataFrame:
    """Page-speed JSON built from the events, then parsed like a payload."""
    s = snapshots(spark, sf)
    num = lambda c: F.struct(F.lit("T").alias("title"), (F.col("snapshot_id") % 10 / 10).alias("score"), (F.col(c) + 0.5).alias("numericValue"))
    css = F.struct(
        F.lit("Unused CSS").alias("title"), (F.col("snapshot_id") % 3 / 2).alias("score"), F.col("lcp_ms").alias("numericValue"),
        F.struct((F.col("snapshot_id") % 5 * 100).alias("overallSavingsMs"), F.lit(2048).alias("overallSavingsBytes")).alias("details"),
    )
    audits = F.struct(
        *[num(c).alias(a) for c, a in V.LAB.items() if c in ("lcp_ms", "tbt_ms", "fcp_ms", "ttfb_ms")],
        F.struct(F.col("cls").alias("numericValue")).alias(V.CLS_AUDIT), css.alias("unused-css-rules"),
        F.struct(F.lit("DOM").alias("title"), F.struct(F.array(*[F.lit(x) for x in "abcdefghijkl"]).alias("items")).alias("details")).alias("dom-size"),
    )
    doc = F.struct(
        F.struct(
            F.struct(F.struct((F.col("performance_score") / 100).alias("score")).alias("performance")).alias("categories"), audits.alias("audits")
        ).alias("lighthouseResult"),
        F.struct(
            F.lit("AVERAGE").alias("overall_category"),
            F.struct(
                F.struct((F.col("lcp_ms") % 3).alias("percentile")).alias("LARGEST_CONTENTFUL_PAINT_MS"),
                F.struct((F.col("snapshot_id") % 50).alias("percentile")).alias("CUMULATIVE_LAYOUT_SHIFT_SCORE"),
            ).alias("metrics"),
        ).alias("loadingExperience"),
    )
    return V.parse(s.select("snapshot_id", F.to_json(doc).alias("json")))


@query("v01_lab_metrics", f"WITH {_SNAP} SELECT snapshot_id, floor((performance_score / 100.0::DOUBLE) * 100.0::DOUBLE) AS score_floor, lcp_ms, tbt_ms, fcp_ms, ttfb_ms, round(cls, 3) AS cls FROM snap")
def v01(spark: SparkSession, sf: str) -> DataFrame:
    return V.lab_metrics(_psi(spark, sf)).select(
        "snapshot_id", F.col("performance_score").cast("double").alias("score_floor"), "lcp_ms", "tbt_ms", "fcp_ms", "ttfb_ms", "cls"
    )


@query(
    "v02_field_metrics",
    f"WITH {_SNAP} SELECT snapshot_id, nullif(lcp_ms % 3, 0)::DOUBLE AS field_lcp_ms, nullif(snapshot_id % 50, 0) / 100.0::DOUBLE AS field_cls, 'AVERAGE' AS overall_category FROM snap",
)
def v02(spark: SparkSession, sf: str) -> DataFrame:
    return V.field_metrics(_psi(spark, sf)).select("snapshot_id", "field_lcp_ms", "field_cls", "overall_category")


@query(
    "v03_opportunities",
    f"""WITH {_SNAP}, o AS (SELECT snapshot_id, 'unused-css-rules' AS id, CASE WHEN snapshot_id % 5 = 0 THEN lcp_ms ELSE (snapshot_id % 5 * 100)::INT END AS ms, 2048 AS bytes FROM snap WHERE snapshot_id % 3 < 2
      UNION ALL SELECT snapshot_id, 'server-response-time', ttfb_ms, 0 FROM snap)
    SELECT snapshot_id, string_agg(id || ':' || ms || ':' || bytes, ',' ORDER BY ms DESC, bytes DESC, CASE id WHEN 'unused-css-rules' THEN 1 ELSE 2 END) AS opportunities, 'dom-size,12' AS diagnostics FROM o GROUP BY snapshot_id""",
)
def v03(spark: SparkSession, sf: str) -> DataFrame:
    show = lambda o: F.concat_ws(":", o["id"], o["savings_ms"].cast("string"), o["savings_bytes"].cast("string"))
    p = _psi(spark, sf).select("snapshot_id", V.opportunities().alias("o"), V.diagnostics().alias("d"))
    return p.select(
        "snapshot_id", F.array_join(F.transform("o", show), ",").alias("opportunities"),
        F.array_join(F.transform("d", lambda d: F.concat_ws(",", d["id"], F.size(d["items"]).cast("string"))), ";").alias("diagnostics"),
    )


@query("v04_cwv_status", f"WITH {_SNAP} SELECT snapshot_id, cwv_status, CASE WHEN fcp_ms <= 1800 THEN 'good' WHEN fcp_ms <= 3000 THEN 'needs_improvement' ELSE 'poor' END AS fcp_status FROM sc")
def v04(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots(spark, sf).select("snapshot_id", "cwv_status", V.metric_status(F.col("fcp_ms"), "fcp").alias("fcp_status"))


@query("v05_latest_snapshots", f"WITH {_LATEST} SELECT site_id, url, strategy, snapshot_id, checked_at FROM lat")
def v05(spark: SparkSession, sf: str) -> DataFrame:
    return V.latest_snapshots(snapshots(spark, sf)).select("site_id", "url", "strategy", "snapshot_id", "checked_at")


@query("v06_performance_history", f"WITH {_SNAP} SELECT snapshot_id, checked_at, performance_score FROM snap WHERE url = 'https://x.test/7' AND strategy = 'mobile' AND checked_at >= {_t('20 DAY')}")
def v06(spark: SparkSession, sf: str) -> DataFrame:
    return V.performance_history(snapshots(spark, sf), "https://x.test/7", "mobile", 20, as_of()).select("snapshot_id", "checked_at", "performance_score")


@query(
    "v07_site_summary",
    f"""WITH {_LATEST}, g AS (SELECT site_id, count(*) AS total_snapshots, count(DISTINCT url) AS pages_analyzed,
      avg(performance_score) FILTER (strategy = 'mobile') AS m, avg(performance_score) FILTER (strategy = 'desktop') AS d, count_if(cwv_status = 'good') / count(*) * 100 AS r,
      avg(lcp_ms) FILTER (strategy = 'mobile') AS l, avg(cls) FILTER (strategy = 'mobile') AS c, avg(fcp_ms) FILTER (strategy = 'mobile') AS f,
      avg(ttfb_ms) FILTER (strategy = 'mobile') AS t, max(checked_at) AS last_analyzed FROM lat GROUP BY site_id)
    SELECT site_id, total_snapshots, pages_analyzed, round(nullif(m, 0), 1) AS avg_mobile_score, round(nullif(d, 0), 1) AS avg_desktop_score, round(r, 1) AS cwv_pass_rate,
      trunc(nullif(l, 0))::INT AS avg_lcp_ms, round(nullif(c, 0), 3) AS avg_cls, trunc(nullif(f, 0))::INT AS avg_fcp_ms, trunc(nullif(t, 0))::INT AS avg_ttfb_ms, last_analyzed FROM g""",
)
def v07(spark: SparkSession, sf: str) -> DataFrame:
    return V.site_summary(snapshots(spark, sf))


@query(
    "v08_worst_pages",
    f"""WITH {_LATEST}, r AS (SELECT site_id, 'lcp' AS list, url, lcp_ms::DOUBLE AS value, -lcp_ms AS k, recency FROM lat WHERE strategy = 'mobile'
      UNION ALL SELECT site_id, 'cls', url, cls, -cls, recency FROM lat WHERE strategy = 'mobile'
      UNION ALL SELECT site_id, 'score', url, performance_score, performance_score, recency FROM lat WHERE strategy = 'mobile' AND performance_score IS NOT NULL)
    SELECT site_id, list, url, value, row_number() OVER (PARTITION BY site_id, list ORDER BY k, recency)::INT AS rank FROM r QUALIFY rank <= 5""",
)
def v08(spark: SparkSession, sf: str) -> DataFrame:
    return V.worst_pages(snapshots(spark, sf))


@query(
    "v09_common_opportunities",
    f"""WITH {_LATEST}, g AS (SELECT site_id, opp_id AS id, count(*) AS affected_pages, sum(opp_ms)::BIGINT AS total_savings_ms, arg_max(opp_title, recency) AS title, min(recency) AS f FROM lat GROUP BY ALL)
    SELECT site_id, id, affected_pages, total_savings_ms, title, row_number() OVER (PARTITION BY site_id ORDER BY affected_pages DESC, f, id)::INT AS rank FROM g QUALIFY rank <= 10""",
)
def v09(spark: SparkSession, sf: str) -> DataFrame:
    return V.common_opportunities(snapshots(spark, sf))


@query(
    "v10_opportunities_summary",
    f"""WITH {_SNAP}, n AS (SELECT * FROM sc WHERE strategy = 'mobile' QUALIFY checked_at = max(checked_at) OVER (PARTITION BY site_id, url)),
    l AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY checked_at DESC, snapshot_id) AS recency FROM n)
    SELECT site_id, opp_id AS id, count(*) AS affected_pages, sum(opp_ms)::BIGINT AS total_savings_ms, sum(opp_bytes)::BIGINT AS total_savings_bytes, round(avg(opp_score), 2) AS avg_score,
      array_to_string((list(url ORDER BY opp_ms DESC, recency))[1:10], ',') AS pages FROM l GROUP BY ALL""",
)
def v10(spark: SparkSession, sf: str) -> DataFrame:
    return V.opportunities_summary(snapshots(spark, sf)).withColumn("pages", F.array_join("pages", ","))


@query("v11_list_snapshots", f"WITH {_SNAP} SELECT snapshot_id, site_id, url FROM sc WHERE strategy = 'mobile' AND template_type = 'view' ORDER BY checked_at DESC, snapshot_id LIMIT 20 OFFSET 20")
def v11(spark: SparkSession, sf: str) -> DataFrame:
    from siteprism.operators.reports import listing

    rows, _ = listing(snapshots(spark, sf), {"strategy": "mobile", "template_type": "view"}, [F.col("checked_at").desc(), F.col("snapshot_id")], 2)
    return rows.select("snapshot_id", "site_id", "url")


# ------------------------------------------------------------------- monitoring


def checks(spark: SparkSession, sf: str) -> DataFrame:
    """Uptime probes: site = user, an error event is a failed probe."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("site_id"), F.col("event_id").alias("check_id"), F.col("ts").alias("checked_at"), (F.col("event_type") != "error").alias("is_up"),
    )


def _sites(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("site_id"))


_CHK = "chk AS (SELECT user_id AS site_id, event_id AS check_id, ts AS checked_at, event_type <> 'error' AS is_up FROM events)"
_PCT = ", ".join(
    f"coalesce(count_if(checked_at >= {_t(f'{d} DAY')}), 0) AS total_{d}d, coalesce(count_if(checked_at >= {_t(f'{d} DAY')} AND is_up), 0) AS up_{d}d, "
    f"coalesce(100.0::DOUBLE * count_if(checked_at >= {_t(f'{d} DAY')} AND is_up) / nullif(count_if(checked_at >= {_t(f'{d} DAY')}), 0), 100) AS uptime_{d}d"
    for d in (1, 7, 30)
)


@query("m01_is_up", "SELECT event_id, (floor(value * 3)::INT BETWEEN 200 AND 399) AS is_up FROM events")
def m01(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", M.is_up(F.floor(F.col("value") * 3)).alias("is_up"))


@query("m02_uptime_stats", f"WITH {_CHK} SELECT c_custkey AS site_id, {_PCT} FROM customer LEFT JOIN chk ON site_id = c_custkey GROUP BY c_custkey")
def m02(spark: SparkSession, sf: str) -> DataFrame:
    out = M.uptime_stats(checks(spark, sf), _sites(spark, sf), as_of())
    return out


@query(
    "m03_current_status",
    f"""WITH {_CHK}, l AS (SELECT * FROM chk QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY checked_at DESC, check_id DESC) = 1)
    SELECT c_custkey AS site_id, CASE WHEN check_id IS NULL THEN 'unknown' WHEN is_up THEN 'up' ELSE 'down' END AS status, checked_at AS last_checked_at FROM customer LEFT JOIN l ON site_id = c_custkey""",
)
def m03(spark: SparkSession, sf: str) -> DataFrame:
    return M.current_status(checks(spark, sf), _sites(spark, sf))


@query("m04_downtime_checks", f"WITH {_CHK} SELECT site_id, count_if(NOT is_up) AS incidents FROM chk WHERE checked_at >= {_t('30 DAY')} GROUP BY site_id")
def m04(spark: SparkSession, sf: str) -> DataFrame:
    return M.downtime_checks(checks(spark, sf), as_of())


_NEWEST = f"{_CHK}, nw AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY checked_at DESC, check_id DESC) AS rn FROM chk)"


@query("m05_consecutive_failures", f"WITH {_NEWEST} SELECT site_id, CASE WHEN count(*) < 3 THEN 0 ELSE count_if(NOT is_up) END AS failures FROM nw WHERE rn <= 3 GROUP BY site_id")
def m05(spark: SparkSession, sf: str) -> DataFrame:
    return M.consecutive_failures(checks(spark, sf), 3)


def _rules(spark: SparkSession, sf: str) -> DataFrame:
    """Two rules per customer site, parameters from the key."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("site_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("i"))
    k = F.col("site_id") * 2 + F.col("i")
    return c.select(
        k.alias("rule_id"), "site_id", F.when(k % 3 != 0, k % 3).cast("int").alias("consecutive_failures"),
        F.when(k % 5 != 0, k % 40).cast("int").alias("position_drop"), F.when(k % 4 != 0, k % 100).cast("int").alias("min_position"),
        F.when(k % 3 == 0, F.array(F.col("site_id"), F.col("site_id") + 1500)).when(k % 7 == 0, F.array().cast("array<bigint>")).alias("keyword_ids"), F.when(k % 6 != 0, k % 100).cast("int").alias("threshold"),
        F.when(k % 7 != 0, k % 60).cast("double").alias("drop_percentage"), (k % 2 == 0).alias("check_noindex"), (k % 3 == 0).alias("check_404"),
        F.when(k % 4 != 0, k % 9).cast("int").alias("check_deindex_count"), F.when(k % 8 != 0, k % 120).cast("int").alias("cooldown_minutes"),
        F.when(k % 9 != 0, as_of() - F.make_dt_interval(F.lit(0), F.lit(0), (k % 100).cast("int"))).alias("last_triggered_at"),
        F.when(k % 2 == 0, "uptime").otherwise("ranking_drop").alias("alert_type"), F.when(k % 5 == 0, "paused").otherwise("active").alias("status"),
    )


_RULES = f"""rl AS (SELECT c_custkey * 2 + i AS rule_id, c_custkey AS site_id FROM customer, (VALUES (0), (1)) v(i)),
rules AS (SELECT rule_id, site_id, CASE WHEN rule_id % 3 <> 0 THEN rule_id % 3 END AS consecutive_failures, CASE WHEN rule_id % 5 <> 0 THEN rule_id % 40 END AS position_drop,
  CASE WHEN rule_id % 4 <> 0 THEN rule_id % 100 END AS min_position, CASE WHEN rule_id % 3 = 0 THEN [site_id, site_id + 1500] WHEN rule_id % 7 = 0 THEN [] END AS keyword_ids, CASE WHEN rule_id % 6 <> 0 THEN rule_id % 100 END AS threshold,
  CASE WHEN rule_id % 7 <> 0 THEN rule_id % 60 END AS drop_percentage, rule_id % 2 = 0 AS check_noindex, rule_id % 3 = 0 AS check_404,
  CASE WHEN rule_id % 4 <> 0 THEN rule_id % 9 END AS check_deindex_count, CASE WHEN rule_id % 8 <> 0 THEN rule_id % 120 END AS cooldown_minutes,
  CASE WHEN rule_id % 9 <> 0 THEN TIMESTAMP '{AS_OF}' - to_minutes((rule_id % 100)::INT) END AS last_triggered_at,
  CASE WHEN rule_id % 2 = 0 THEN 'uptime' ELSE 'ranking_drop' END AS alert_type, CASE WHEN rule_id % 5 = 0 THEN 'paused' ELSE 'active' END AS status FROM rl)"""


@query(
    "m06_uptime_alerts",
    f"""WITH {_NEWEST}, {_RULES}, j AS (SELECT rule_id, r.site_id, coalesce(consecutive_failures, 2) AS n, count_if(rn <= coalesce(consecutive_failures, 2)) AS c,
      count_if(rn <= coalesce(consecutive_failures, 2) AND NOT is_up) AS d, bool_or(rn = 1 AND NOT is_up) AS down FROM rules r JOIN nw USING (site_id) GROUP BY ALL)
    SELECT rule_id, site_id, 'critical' AS severity, d AS failures FROM j WHERE down AND c >= n AND d >= n""",
)
def m06(spark: SparkSession, sf: str) -> DataFrame:
    return M.uptime_alerts(_rules(spark, sf), checks(spark, sf))


@query(
    "m07_ranking_drop_alerts",
    f"""WITH {D.KEYWORDS}, {_RULES}, h AS (SELECT rule_id, r.site_id, text, keyword_id, current_position - previous_position AS dr FROM rules r JOIN kw ON kw.keyword_id % 1500 = r.site_id
      WHERE (coalesce(len(keyword_ids), 0) = 0 OR list_contains(keyword_ids, keyword_id)) AND is_tracked AND previous_position <> 0 AND previous_position <= coalesce(min_position, 100) AND current_position - previous_position >= coalesce(position_drop, 10))
    SELECT rule_id, site_id, CASE WHEN count(*) < 5 THEN 'warning' ELSE 'critical' END AS severity, count(*) AS drops, array_to_string((list(text ORDER BY dr DESC, keyword_id))[1:5], ',') AS worst FROM h GROUP BY ALL""",
)
def m07(spark: SparkSession, sf: str) -> DataFrame:
    kw = D.keywords(spark, sf).withColumn("site_id", F.col("keyword_id") % 1500)
    return M.ranking_drop_alerts(_rules(spark, sf), kw).withColumn("worst", F.array_join("worst", ","))


@query(
    "m08_audit_score_alerts",
    f"""WITH {D.RUNS}, {_RULES}, t AS (SELECT site_id, score, row_number() OVER (PARTITION BY site_id ORDER BY completed_at DESC, audit_id DESC) AS rn FROM runs WHERE status = 'completed' AND score IS NOT NULL),
    p AS (SELECT site_id, max(score) FILTER (rn = 1) AS current, max(score) FILTER (rn = 2) AS previous FROM t WHERE rn <= 2 GROUP BY site_id),
    j AS (SELECT rule_id, site_id, current, previous, CASE WHEN previous > 0 AND 100.0::DOUBLE * (previous - current) / previous >= drop_percentage THEN 'score_drop' WHEN current < coalesce(threshold, 70) THEN 'below_threshold' END AS reason
      FROM rules JOIN p USING (site_id))
    SELECT rule_id, site_id, reason, CASE WHEN current >= 50 THEN 'warning' ELSE 'critical' END AS severity, current, previous FROM j WHERE reason IS NOT NULL""",
)
def m08(spark: SparkSession, sf: str) -> DataFrame:
    return M.audit_score_alerts(_rules(spark, sf), D.audit_runs(spark, sf))


def _crawls(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Crawls are orders of a customer's site, their pages the order lines."""
    crawls = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("crawl_id"), F.col("o_custkey").alias("site_id"),
        F.when(F.col("o_orderstatus") == "P", "running").otherwise("completed").alias("status"), F.col("o_orderdate").alias("completed_at"),
        F.col("o_orderdate").alias("started_at"),
    )
    pages = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("crawl_id"), (F.col("l_partkey") % 4).cast("string").alias("url"), (F.col("l_linestatus") == "O").alias("noindex"),
        F.when(F.col("l_returnflag") == "R", 404).otherwise(200).alias("status_code"),
    )
    return crawls, pages


_CRAWLS = """cr AS (SELECT o_orderkey AS crawl_id, o_custkey AS site_id, CASE o_orderstatus WHEN 'P' THEN 'running' ELSE 'completed' END AS status, o_orderdate AS completed_at FROM orders),
pg AS (SELECT l_orderkey AS crawl_id, (l_partkey % 4)::VARCHAR AS url, l_linestatus = 'O' AS noindex, CASE l_returnflag WHEN 'R' THEN 404 ELSE 200 END AS status_code FROM lineitem),
two AS (SELECT crawl_id, site_id, row_number() OVER (PARTITION BY site_id ORDER BY completed_at DESC, crawl_id DESC) AS age FROM cr WHERE status = 'completed' QUALIFY age <= 2),
ch AS (SELECT site_id, url, 'newly_noindex' AS change FROM (SELECT site_id, url FROM two JOIN pg USING (crawl_id) WHERE age = 1 AND noindex INTERSECT SELECT site_id, url FROM two JOIN pg USING (crawl_id) WHERE age = 2 AND NOT noindex)
  UNION ALL SELECT site_id, url, 'newly_404' FROM (SELECT site_id, url FROM two JOIN pg USING (crawl_id) WHERE age = 1 AND status_code = 404 INTERSECT SELECT site_id, url FROM two JOIN pg USING (crawl_id) WHERE age = 2 AND status_code BETWEEN 200 AND 399))"""


@query("m09_index_changes", f"WITH {_CRAWLS} SELECT site_id, url, change FROM ch")
def m09(spark: SparkSession, sf: str) -> DataFrame:
    return M.index_changes(*_crawls(spark, sf))


@query(
    "m09_index_status_alerts",
    f"""WITH {_CRAWLS}, {_RULES}, c AS (SELECT site_id, count_if(change = 'newly_noindex') AS a, count_if(change = 'newly_404') AS b,
      coalesce(string_agg(url, ',' ORDER BY url) FILTER (change = 'newly_noindex'), '') AS newly_noindex, coalesce(string_agg(url, ',' ORDER BY url) FILTER (change = 'newly_404'), '') AS newly_404 FROM ch GROUP BY site_id),
    j AS (SELECT rule_id, site_id, CASE WHEN check_noindex THEN a ELSE 0 END + CASE WHEN check_404 THEN b ELSE 0 END AS total_issues, newly_noindex, newly_404, check_deindex_count FROM rules JOIN c USING (site_id))
    SELECT rule_id, site_id, CASE WHEN total_issues < 20 THEN 'warning' ELSE 'critical' END AS severity, total_issues, newly_noindex, newly_404 FROM j WHERE total_issues >= coalesce(check_deindex_count, 5)""",
)
def m09a(spark: SparkSession, sf: str) -> DataFrame:
    return M.index_status_alerts(_rules(spark, sf), *_crawls(spark, sf)).withColumns(
        {c: F.array_join(c, ",") for c in ("newly_noindex", "newly_404")}
    )


@query(
    "m10_cooldown_filter",
    f"WITH {_RULES} SELECT rule_id, site_id FROM rules WHERE last_triggered_at IS NULL OR TIMESTAMP '{AS_OF}' - last_triggered_at >= to_minutes(coalesce(cooldown_minutes, 60)::INT)",
)
def m10(spark: SparkSession, sf: str) -> DataFrame:
    r = _rules(spark, sf)
    return M.cooldown_filter(r.select("rule_id", "site_id"), r, as_of())


_RECURSIVE = """ev AS (SELECT k, us, row_number() OVER (PARTITION BY k ORDER BY us) AS rn FROM (SELECT DISTINCT {key} AS k, epoch_us(ts) AS us FROM events)),
run AS (SELECT k, us, rn, [us] AS acc, true AS allowed, 0 AS current FROM ev WHERE rn = 1
  UNION ALL SELECT e.k, e.us, e.rn, CASE WHEN len(f) < {limit} THEN f || [e.us] ELSE f END, len(f) < {limit}, len(f)
  FROM (SELECT r.k, r.rn, e.us, list_filter(r.acc, lambda x: x > e.us - {w}) AS f FROM run r JOIN ev e ON e.k = r.k AND e.rn = r.rn + 1) q JOIN ev e ON e.k = q.k AND e.rn = q.rn + 1)"""


@query(
    "m10_cooldown_sequence",
    f"WITH RECURSIVE {_RECURSIVE.format(key='user_id', limit=1, w=86400 * 1_000_000)} SELECT k AS rule_id, make_timestamp(us) AS ts, allowed AS fires FROM run",
)
def m10s(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "events").select(F.col("user_id").alias("rule_id"), "ts")
    return M.cooldown_sequence(c, 1440).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "m11_auto_resolve",
    f"""WITH {_NEWEST}, {_RULES}, g AS (SELECT site_id FROM nw WHERE rn <= 3 GROUP BY site_id HAVING count(*) = 3 AND bool_and(is_up))
    SELECT rule_id, site_id, CASE WHEN alert_type = 'uptime' AND status = 'active' AND site_id IN (SELECT site_id FROM g) THEN 'resolved' ELSE status END AS status FROM rules""",
)
def m11(spark: SparkSession, sf: str) -> DataFrame:
    ev = _rules(spark, sf).select("rule_id", "site_id", "alert_type", "status")
    return M.auto_resolve(ev, checks(spark, sf)).select("rule_id", "site_id", "status")


@query("m12_active_rules", f"WITH {_RULES} SELECT rule_id, site_id FROM rules WHERE status = 'active' AND alert_type = 'uptime' ORDER BY rule_id DESC LIMIT 20 OFFSET 20")
def m12(spark: SparkSession, sf: str) -> DataFrame:
    from siteprism.operators.reports import listing

    rows, _ = listing(_rules(spark, sf), {"status": "active", "alert_type": "uptime"}, [F.col("rule_id").desc()], 2)
    return rows.select("rule_id", "site_id")


@query("m13_stale_crawls", f"WITH {_CRAWLS} SELECT crawl_id, CASE WHEN status = 'running' AND completed_at < TIMESTAMP '2001-08-01 02:00:00' - INTERVAL 2 HOUR THEN 'failed' ELSE status END AS status FROM cr")
def m13(spark: SparkSession, sf: str) -> DataFrame:
    return M.stale_crawls(_crawls(spark, sf)[0], F.lit("2001-08-01 02:00:00").cast("timestamp_ntz")).select("crawl_id", "status")


# ------------------------------------------------------------------------ usage


@query(
    "u01_sliding_rate_limit",
    f"WITH RECURSIVE {_RECURSIVE.format(key='event_type', limit=5, w=3600 * 1_000_000)} SELECT k AS endpoint, make_timestamp(us) AS ts, allowed, current::INT AS current FROM run",
)
def u01(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "events").select(F.col("event_type").alias("endpoint"), "ts")
    return L.sliding_rate_limit(r, ["endpoint"], 5, 3600).select("endpoint", F.col("ts").cast("timestamp_ntz").alias("ts"), "allowed", "current")


@query("u01_rolling_counts", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3599999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS in_window FROM events")
def u01r(spark: SparkSession, sf: str) -> DataFrame:
    return L.rolling_counts(table(spark, sf, "events").select("event_id", "user_id", "ts"), ["user_id"], 3600).select("event_id", "in_window")


_PATHS = ["/api/v1/analyze/x", "/api/v1/sites/7/audits", "/api/v1/usage", "/api/v2/sites"]
_PLANS = ["free", "pro", "enterprise"]


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        e, F.col("user_id").alias("tenant_id"), "ts", D._pick(e, 4, *_PATHS).alias("path"), D._pick(F.col("user_id"), 4, *_PLANS).alias("plan"),
        D._pick(e, 6, *L.USAGE_TYPES).alias("usage_type"), (e % 7 + 1).cast("int").alias("amount"),
    )


_REQ = f"""rq AS (SELECT event_id, user_id AS tenant_id, ts, (['{"','".join(_PATHS)}'])[event_id % 4 + 1] AS path, (['{"','".join(_PLANS)}'])[user_id % 4 + 1] AS plan,
  (['{"','".join(L.USAGE_TYPES)}'])[event_id % 6 + 1] AS usage_type, (event_id % 7 + 1)::INT AS amount FROM events)"""


@query(
    "u02_effective_limit",
    f"""WITH {_REQ} SELECT event_id, CASE WHEN plan IS NULL THEN 30 WHEN starts_with(path, '/api/v1/analyze') THEN 10 * CASE plan WHEN 'pro' THEN 4 WHEN 'enterprise' THEN 20 ELSE 1 END
    WHEN starts_with(path, '/api/v1/sites/') THEN 20 * CASE plan WHEN 'pro' THEN 4 WHEN 'enterprise' THEN 20 ELSE 1 END ELSE CASE plan WHEN 'pro' THEN 120 WHEN 'enterprise' THEN 600 ELSE 60 END END AS per_minute FROM rq""",
)
def u02(spark: SparkSession, sf: str) -> DataFrame:
    return _requests(spark, sf).select("event_id", L.effective_limit(F.col("path"), F.col("plan")).alias("per_minute"))


@query("u03_normalize_path", f"WITH {_REQ} SELECT event_id, regexp_replace(path, '/7/', '/{{id}}/') AS path FROM rq")
def u03(spark: SparkSession, sf: str) -> DataFrame:
    from siteprism.functions import urls as U

    return _requests(spark, sf).select("event_id", U.normalize_path(F.col("path")).alias("path"))


_SUMS = ", ".join(f"coalesce(sum(amount) FILTER (usage_type = '{t}'), 0)::BIGINT AS {t}" for t in L.USAGE_TYPES)
_MONTH = "date_trunc('month', ts)::DATE AS month"


@query("u04_monthly_usage", f"WITH {_REQ} SELECT tenant_id, {_MONTH}, {_SUMS} FROM rq GROUP BY ALL")
def u04(spark: SparkSession, sf: str) -> DataFrame:
    return L.monthly_usage(_requests(spark, sf))


def _tenants(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("tenant_id"))
    k = F.col("tenant_id")
    tenants = c.withColumn("plan", F.coalesce(D._pick(k, 3, *_PLANS), F.lit("free")))
    overrides = c.filter("tenant_id % 2 = 0").select("tenant_id", *[(k % (10 * (i + 1))).cast("int").alias(t) for i, t in enumerate(L.USAGE_TYPES)])
    return tenants, overrides


_QUOTA = f"""qt AS (SELECT c_custkey AS tenant_id, (['{"','".join(_PLANS)}'])[c_custkey % 3 + 1] AS plan FROM customer),
quota AS (SELECT tenant_id, plan, {', '.join(f"CASE WHEN tenant_id % 2 = 0 AND tenant_id % {10 * (i + 1)} <> 0 THEN (tenant_id % {10 * (i + 1)})::INT ELSE CASE plan WHEN 'free' THEN {L.PLANS[0][i + 1]} WHEN 'pro' THEN {L.PLANS[1][i + 1]} ELSE 0 END END AS {t}" for i, t in enumerate(L.USAGE_TYPES))} FROM qt),
ql AS (UNPIVOT (SELECT * EXCLUDE plan FROM quota) ON {', '.join(L.USAGE_TYPES)} INTO NAME usage_type VALUE quota)"""


@query("u05_effective_quota", f"WITH {_QUOTA} SELECT * FROM quota")
def u05(spark: SparkSession, sf: str) -> DataFrame:
    return L.effective_quota(*_tenants(spark, sf))


@query(
    "u06_quota_check",
    f"""WITH RECURSIVE {_REQ}, {_QUOTA}, ev AS (SELECT tenant_id, usage_type, {_MONTH}, event_id, amount, quota, row_number() OVER (PARTITION BY tenant_id, usage_type, date_trunc('month', ts) ORDER BY ts, event_id) AS rn
      FROM rq JOIN ql USING (tenant_id, usage_type)),
    r AS (SELECT *, quota = 0 OR amount <= quota AS allowed, CASE WHEN quota = 0 OR amount <= quota THEN amount ELSE 0 END AS used FROM ev WHERE rn = 1
      UNION ALL SELECT e.*, e.quota = 0 OR r.used + e.amount <= e.quota, r.used + CASE WHEN e.quota = 0 OR r.used + e.amount <= e.quota THEN e.amount ELSE 0 END
      FROM r JOIN ev e ON e.tenant_id = r.tenant_id AND e.usage_type = r.usage_type AND e.month = r.month AND e.rn = r.rn + 1)
    SELECT event_id, allowed FROM r""",
)
def u06(spark: SparkSession, sf: str) -> DataFrame:
    quota = L.effective_quota(*_tenants(spark, sf))
    return L.quota_check(_requests(spark, sf).drop("path", "plan"), quota).select("event_id", "allowed")


@query(
    "u07_usage_summary",
    f"""WITH {_REQ}, {_QUOTA}, mu AS (SELECT tenant_id, {_MONTH}, {_SUMS} FROM rq GROUP BY ALL), ml AS (UNPIVOT mu ON {', '.join(L.USAGE_TYPES)} INTO NAME usage_type VALUE used)
    SELECT tenant_id, month, usage_type, used, nullif(quota, 0) AS "limit", CASE WHEN quota <> 0 THEN greatest(0, quota - used) END AS remaining FROM ml JOIN ql USING (tenant_id, usage_type)""",
)
def u07(spark: SparkSession, sf: str) -> DataFrame:
    return L.usage_summary(L.monthly_usage(_requests(spark, sf)), L.effective_quota(*_tenants(spark, sf)))


@query(
    "u08_usage_history",
    """WITH mo AS (SELECT o_custkey AS tenant_id, date_trunc('month', o_orderdate)::DATE AS month, count(*)::BIGINT AS audits FROM orders GROUP BY ALL)
    SELECT tenant_id, month, audits, row_number() OVER (PARTITION BY tenant_id ORDER BY month DESC)::INT AS age FROM mo QUALIFY age <= 3""",
)
def u08(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("tenant_id"), F.col("o_orderdate").alias("ts"), F.lit("audits").alias("usage_type"), F.lit(1).alias("amount")
    )
    return L.usage_history(L.monthly_usage(o), 3).select("tenant_id", "month", "audits", "age")


@query(
    "u09_limit_events",
    f"WITH RECURSIVE {_RECURSIVE.format(key='event_type', limit=5, w=3600 * 1_000_000)} SELECT k AS endpoint, make_timestamp(us) AS ts, 5 AS \"limit\", current::INT AS current, ((acc[1] + 3600000000 - us) // 1000000)::INT AS retry_after FROM run WHERE NOT allowed",
)
def u09(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "events").select(F.col("event_type").alias("endpoint"), "ts")
    return L.limit_events(L.sliding_rate_limit(r, ["endpoint"], 5, 3600), 5).select(
        "endpoint", F.col("ts").cast("timestamp_ntz").alias("ts"), "limit", "current", "retry_after"
    )
