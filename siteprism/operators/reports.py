"""Report datasets and generic listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteprism.common import ordered_list, severity_rank, top_k
from siteprism.operators import audit as A
from siteprism.operators import issues as I


def page_fixes(issues: DataFrame, sites: DataFrame, hits: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(issue × page rows, per-page severity counts with their order key).

    ``issues(site_id, title, severity, fix, affected_urls, details)``; without
    URLs the site root stands in.  ``current``/``target`` come from the detail
    entry of the same URL.  With ``hits`` (of :func:`audit_hits`, for issues
    with a check_id) every hit page counts; the lists in the issues are only
    previews of ten URLs.
    """
    j = issues.join(sites.select("site_id", "base_url"), "site_id")
    if hits is None:
        urls = F.when(F.coalesce(F.size("affected_urls"), F.lit(0)) > 0, F.col("affected_urls")).otherwise(F.array("base_url"))
        rows = j.withColumn("url", F.explode(urls))
        rows = rows.withColumn("entry", F.try_element_at(F.filter("details", lambda d: F.get_json_object(d, "$.url") == F.col("url")), F.lit(1)))
    else:
        keys = ["site_id", "check_id"]
        narrow = j.select(*keys, "base_url", "title", "severity", "fix")
        placed = hits.filter("url is not null").select(*keys, "url")
        root = narrow.join(placed.select(*keys).distinct(), keys, "left_anti").withColumn("url", F.col("base_url"))
        told = hits.select(*keys, "ord", "page_seq", F.posexplode("details").alias("pos", "d")).withColumn("url", F.get_json_object("d", "$.url"))
        entries = told.filter("url is not null").groupBy(*keys, "url").agg(F.min_by("d", F.struct("ord", "page_seq", "pos")).alias("entry"))
        rows = narrow.join(placed, keys).unionByName(root).join(entries, [*keys, "url"], "left")
    rows = rows.select(
        "site_id", "url", "title", F.lower(F.coalesce("severity", F.lit("low"))).alias("severity"), "fix",
        F.get_json_object("entry", "$.current").alias("current"), F.get_json_object("entry", "$.target").alias("target"),
    )
    s = F.col("severity")
    counts = rows.groupBy("site_id", "url").agg(*[F.count_if(s == x).alias(x) for x in ("critical", "high", "medium", "low")])
    counts = counts.withColumns({
        "total": F.col("critical") + F.col("high") + F.col("medium") + F.col("low"),
        "weight": F.col("critical") * 100 + F.col("high") * 10 + F.col("medium"),
    })
    return rows.withColumn("severity_order", F.coalesce(F.lit(4) - severity_rank(s), F.lit(4))), counts


def audit_report(issues: DataFrame, listed: int = 10) -> DataFrame:
    """Issue sections: first URLs and how many more there are."""
    shown = F.slice("affected_urls", 1, listed)
    more = F.greatest(F.col("affected_count") - F.size(shown), F.lit(0))
    return issues.select(
        "site_id", "severity", "title", "affected_count", shown.alias("urls"),
        F.when(more > 0, F.concat(F.lit("... and "), more.cast("string"), F.lit(" more"))).otherwise("").alias("more"), "fix",
    )


def executive_summary(checks: DataFrame) -> DataFrame:
    """One row per site: score, grade, counts, impact, first five issues, pass rate."""
    s = A.audit_summary(checks)
    n = lambda k: F.coalesce(F.try_element_at("issues_by_severity", F.lit(k)), F.lit(0)).alias(k)
    base = s.select("site_id", "score", "total_checks", "passed_checks", "failed_checks", n("critical"), n("high"), n("medium"), n("low"))
    top = top_k(A.to_issues(checks), ["site_id"], [F.col("check_id")], 5).groupBy("site_id").agg(
        ordered_list(F.col("title"), F.col("_rn")).alias("top_issues")
    )
    t = A.traffic_impact(F.col("critical"), F.col("high"), F.col("medium"), F.col("score"))
    return base.join(top, "site_id", "left").select(
        "site_id", "score", A.grade(F.col("score")).alias("grade"), "total_checks", "passed_checks", "failed_checks",
        "critical", "high", "medium", "low", F.round(F.col("passed_checks") / F.col("total_checks") * 100, 1).alias("pass_rate"),
        t["potential_score"].alias("potential_score"), t["potential_traffic_increase"].alias("potential_traffic_increase"),
        t["confidence"].alias("confidence"), F.coalesce("top_issues", F.array().cast("array<string>")).alias("top_issues"),
    )


def category_listing(checks: DataFrame) -> DataFrame:
    """Checks of each category in id order, with the category score (≤ 10 rows each); the checks are read once."""
    shown = F.concat("check_name", F.when(F.col("passed"), F.lit(": passed")).otherwise(F.lit(": failed")))
    listed = checks.groupBy("site_id", "category").agg(
        ordered_list(shown, F.col("check_id")).alias("checks"), F.count("*").alias("total"), F.count_if("passed").alias("passed_checks")
    )
    return A.with_category_score(listed)


def weekly_report(sites: DataFrame, runs: DataFrame, keywords: DataFrame, as_of: Column) -> DataFrame:
    """Sites updated in the last seven days with latest score and keyword counts."""
    fresh = sites.filter(F.col("updated_at") >= as_of - F.make_dt_interval(F.lit(7)))
    k = keywords.groupBy("site_id").agg(F.count("*").alias("keywords_total"), F.count_if("is_tracked").alias("keywords_tracked"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return fresh.join(I.latest_audit(runs).select("site_id", "score"), "site_id", "left").join(k, "site_id", "left").select(
        "site_id", "score", zero("keywords_total"), zero("keywords_tracked")
    )


def tenant_dashboard(sites: DataFrame, facts: dict[str, DataFrame]) -> DataFrame:
    """Counts per tenant: sites plus one count per fact table with a site_id."""
    out = sites.groupBy("tenant_id").agg(F.count("*").alias("sites"))
    for name, df in facts.items():
        per_site = df.groupBy("site_id").agg(F.count("*").alias("_n"))
        c = sites.select("tenant_id", "site_id").join(per_site, "site_id").groupBy("tenant_id").agg(F.sum("_n").cast("bigint").alias(name))
        out = out.join(c, "tenant_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def site_dashboard(sites: DataFrame, runs: DataFrame, issues: DataFrame, facts: dict[str, DataFrame]) -> DataFrame:
    """Latest audit, open issues per severity and fact counts per site."""
    s = F.col("severity")
    open_ = issues.filter("status = 'open'").groupBy("site_id").agg(*[F.count_if(s == x).alias(x) for x in ("critical", "high", "medium", "low")])
    out = sites.select("site_id").join(I.latest_audit(runs).select("site_id", "audit_id", "score"), "site_id", "left").join(open_, "site_id", "left")
    for name, df in facts.items():
        out = out.join(df.groupBy("site_id").agg(F.count("*").alias(name)), "site_id", "left")
    return out.na.fill(0, ["critical", "high", "medium", "low", *facts])


def listing(df: DataFrame, equals: dict | None = None, order: list[Column] | None = None, page: int = 1, per_page: int = 20) -> tuple[DataFrame, DataFrame]:
    """One page of a filtered table, and a row with total and page count."""
    for c, v in (equals or {}).items():
        df = df.filter(F.col(c) == v)
    total = df.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / per_page))
    ordered = df.orderBy(*order) if order else df
    return ordered.offset((page - 1) * per_page).limit(per_page), total


def search(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    """Rows where any of the columns contains the text, case-insensitively."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False))
    return df.filter(hit)


def with_children(parents: DataFrame, children: DataFrame, key: str, order: str, payload: list[str], name: str) -> DataFrame:
    """Parents with the ordered list of their children (for keys with few children)."""
    c = children.groupBy(key).agg(ordered_list(F.struct(*payload), F.col(order)).alias(name))
    return parents.join(c, key, "left")


def for_tenant(df: DataFrame, tenant_id) -> DataFrame:
    """The mandatory tenant predicate of every read; prunes a tenant-partitioned table."""
    return df.filter(F.col("tenant_id") == tenant_id)
