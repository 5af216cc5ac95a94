"""Page-speed snapshots: parsing, latest per URL, summaries, opportunities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteprism.common import falsy_zero, ordered_list, top_k

# Audit that carries each lab metric.
LAB = {
    "lcp_ms": "largest-contentful-paint", "tbt_ms": "total-blocking-time", "fcp_ms": "first-contentful-paint",
    "ttfb_ms": "server-response-time", "speed_index_ms": "speed-index", "tti_ms": "interactive",
}
CLS_AUDIT = "cumulative-layout-shift"
# Field metric names.
FIELD = {
    "lcp_ms": "LARGEST_CONTENTFUL_PAINT_MS", "fid_ms": "FIRST_INPUT_DELAY_MS", "cls": "CUMULATIVE_LAYOUT_SHIFT_SCORE",
    "fcp_ms": "FIRST_CONTENTFUL_PAINT_MS", "inp_ms": "INTERACTION_TO_NEXT_PAINT", "ttfb_ms": "EXPERIMENTAL_TIME_TO_FIRST_BYTE",
}
# Audits reported as opportunities and as diagnostics.
OPPORTUNITIES = [
    "render-blocking-resources", "unused-css-rules", "unused-javascript", "modern-image-formats", "offscreen-images",
    "unminified-css", "unminified-javascript", "efficient-animated-content", "uses-optimized-images",
    "uses-responsive-images", "uses-text-compression", "server-response-time", "redirects", "uses-rel-preconnect",
    "uses-rel-preload", "font-display", "third-party-summary", "lcp-lazy-loaded",
]
DIAGNOSTICS = [
    "largest-contentful-paint-element", "layout-shift-elements", "long-tasks", "main-thread-tasks", "bootup-time",
    "mainthread-work-breakdown", "dom-size", "network-requests", "resource-summary", "third-party-facades",
    "critical-request-chains",
]
DIAGNOSTICS_WITH_ITEMS = ["dom-size", "bootup-time", "mainthread-work-breakdown"]

_AUDIT = (
    "struct<title:string,description:string,score:double,numericValue:double,displayValue:string,"
    "details:struct<overallSavingsMs:double,overallSavingsBytes:double,items:array<string>>>"
)
SCHEMA = (
    f"struct<lighthouseResult:struct<categories:struct<performance:struct<score:double>>,audits:map<string,{_AUDIT}>>,"
    "loadingExperience:struct<overall_category:string,metrics:map<string,struct<percentile:double,distributions:array<string>>>>>"
)


def parse(raw: DataFrame) -> DataFrame:
    """``raw(…, json)`` → the parsed result in columns ``audits``, ``field``, ``score``."""
    r = raw.withColumn("_j", F.from_json("json", SCHEMA))
    return r.withColumns(
        {
            "audits": F.col("_j.lighthouseResult.audits"), "field": F.col("_j.loadingExperience"),
            "performance_score": (F.col("_j.lighthouseResult.categories.performance.score") * 100).cast("int"),
        }
    ).drop("_j", "json")


def _audit(name: str) -> Column:
    return F.try_element_at("audits", F.lit(name))


def lab_metrics(parsed: DataFrame) -> DataFrame:
    """Seven lab metrics, truncated to ms; layout shift at three decimals."""
    ms = {k: _audit(a)["numericValue"].cast("int") for k, a in LAB.items()}
    return parsed.withColumns({**ms, "cls": F.round(_audit(CLS_AUDIT)["numericValue"], 3)})


def field_metrics(parsed: DataFrame) -> DataFrame:
    """Percentiles of real users (0 counts as missing), layout shift / 100."""
    def value(name: str, key: str) -> Column:
        p = falsy_zero(F.try_element_at("field.metrics", F.lit(key))["percentile"])
        return (p / 100 if name == "cls" else p).alias(f"field_{name}")

    dist = F.map_filter(
        F.transform_values("field.metrics", lambda _, m: m["distributions"]), lambda _, d: F.size(d) > 0
    )
    return parsed.select(
        "*", *[value(n, k) for n, k in FIELD.items()], dist.alias("field_distributions"),
        F.col("field.overall_category").alias("overall_category"),
    )


def opportunities() -> Column:
    """Audits below a full score with their savings, largest first."""
    ids = F.array(*[F.lit(i) for i in OPPORTUNITIES])

    def build(i: Column) -> Column:
        a = F.try_element_at("audits", i)
        ms = F.coalesce(falsy_zero(a["details"]["overallSavingsMs"]), a["numericValue"], F.lit(0))
        return F.struct(
            i.alias("id"), F.coalesce(a["title"], i).alias("title"), F.coalesce(a["description"], F.lit("")).alias("description"),
            a["score"].alias("score"), ms.cast("int").alias("savings_ms"),
            F.coalesce(a["details"]["overallSavingsBytes"], F.lit(0)).cast("int").alias("savings_bytes"),
            F.coalesce(a["displayValue"], F.lit("")).alias("display_value"),
        )

    found = F.filter(F.transform(ids, build), lambda o: o["score"] < 1)
    # array_sort by a key struct: savings descending, list order among equals.
    keyed = F.transform(found, lambda o, i: F.struct((-o["savings_ms"]).alias("a"), (-o["savings_bytes"]).alias("b"), i.alias("c"), o.alias("o")))
    return F.transform(F.array_sort(keyed), lambda k: k["o"])


def diagnostics(most: int | None = None) -> Column:
    """The diagnostics of a report; of their items all, or the first `most`."""
    ids = F.filter(F.array(*[F.lit(i) for i in DIAGNOSTICS]), lambda i: F.try_element_at("audits", i).isNotNull())
    with_items = F.array(*[F.lit(i) for i in DIAGNOSTICS_WITH_ITEMS])

    def build(i: Column) -> Column:
        a = F.try_element_at("audits", i)
        return F.struct(
            i.alias("id"), a["title"].alias("title"), a["description"].alias("description"), a["displayValue"].alias("display_value"),
            a["score"].alias("score"), F.when(F.array_contains(with_items, i), a["details"]["items"] if most is None else F.slice(a["details"]["items"], 1, most)).alias("items"),
        )

    return F.transform(ids, build)


def _level(c: Column, good: float, fair: float) -> Column:
    return F.when(c <= good, 1).when(c <= fair, 2).when(c.isNotNull(), 3)


def _status(level: Column) -> Column:
    return F.when(level == 1, "good").when(level == 2, "needs_improvement").when(level == 3, "poor").otherwise("unknown")


def cwv_status(lcp: Column, cls: Column, tbt: Column) -> Column:
    """Worst of the three metrics; unknown when none is there."""
    return _status(F.greatest(_level(lcp, 2500, 4000), _level(cls, 0.1, 0.25), _level(tbt, 200, 600)))


def metric_status(c: Column, metric: str) -> Column:
    good, fair = {"lcp": (2500, 4000), "cls": (0.1, 0.25), "fcp": (1800, 3000)}[metric]
    return _status(_level(c, good, fair))


def latest_snapshots(snapshots: DataFrame, strategy: str | None = None, template: str | None = None, limit: int | None = None) -> DataFrame:
    """Newest snapshots per (site, URL, strategy), ties kept; all, or on request the `limit` newest of a site with their rank.

    ``rank() = 1`` becomes a group limit before the shuffle.  The template
    filter comes after, the per-site limit last.
    """
    s = snapshots if strategy is None else snapshots.filter(F.col("strategy") == strategy)
    w = W.partitionBy("site_id", "url", "strategy").orderBy(F.col("checked_at").desc())
    newest = s.withColumn("_r", F.rank().over(w)).filter("_r = 1").drop("_r")
    if template:
        newest = newest.filter(F.col("template_type") == template)
    if limit is None:
        return newest
    return top_k(newest, ["site_id"], [F.col("checked_at").desc(), F.col("snapshot_id")], limit, "recency")


def performance_history(snapshots: DataFrame, url: str, strategy: str, days: int, as_of: Column) -> DataFrame:
    return snapshots.filter(
        (F.col("url") == url) & (F.col("strategy") == strategy) & (F.col("checked_at") >= as_of - F.make_dt_interval(F.lit(days)))
    ).orderBy("checked_at", "snapshot_id")


def site_summary(snapshots: DataFrame) -> DataFrame:
    """Averages per site over the latest snapshots of all its pages; 0 averages become NULL."""
    s = latest_snapshots(snapshots)
    mobile, desktop = F.col("strategy") == "mobile", F.col("strategy") == "desktop"
    mean = lambda c, cond: falsy_zero(F.avg(F.when(cond, F.col(c))))
    rated = F.count_if(F.coalesce("cwv_status", F.lit("")) != "")
    return s.groupBy("site_id").agg(
        F.count("*").alias("total_snapshots"), F.countDistinct("url").alias("pages_analyzed"),
        F.round(mean("performance_score", mobile), 1).alias("avg_mobile_score"),
        F.round(mean("performance_score", desktop), 1).alias("avg_desktop_score"),
        F.round(F.coalesce(F.count_if(F.col("cwv_status") == "good") / falsy_zero(rated) * 100, F.lit(0.0)), 1).alias("cwv_pass_rate"),
        mean("lcp_ms", mobile).cast("int").alias("avg_lcp_ms"), F.round(mean("cls", mobile), 3).alias("avg_cls"),
        mean("fcp_ms", mobile).cast("int").alias("avg_fcp_ms"), mean("ttfb_ms", mobile).cast("int").alias("avg_ttfb_ms"),
        F.max("checked_at").alias("last_analyzed"),
    )


def worst_pages(snapshots: DataFrame, n: int = 5) -> DataFrame:
    """Mobile only: highest LCP, highest CLS and lowest score per site."""
    s = latest_snapshots(snapshots, "mobile")
    base = ["site_id", "url", "snapshot_id", "checked_at"]
    rows = s.select(*base, F.explode(F.array(
        F.struct(F.lit("lcp").alias("list"), F.col("lcp_ms").cast("double").alias("value"), (-F.col("lcp_ms")).cast("double").alias("key")),
        F.struct(F.lit("cls").alias("list"), F.col("cls").alias("value"), (-F.col("cls")).alias("key")),
        F.struct(F.lit("score").alias("list"), F.col("performance_score").cast("double").alias("value"), F.col("performance_score").cast("double").alias("key")),
    )).alias("m")).select(*base, "m.*").filter("value is not null")
    return top_k(rows, ["site_id", "list"], [F.col("key"), F.col("checked_at").desc(), F.col("snapshot_id")], n, "rank").select("site_id", "list", "url", "value", "rank")


def common_opportunities(snapshots: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent opportunities per site; the oldest snapshot names them."""
    o = latest_snapshots(snapshots).select("site_id", F.struct((-F.unix_micros(F.col("checked_at").cast("timestamp"))).alias("age"), "snapshot_id").alias("recency"), F.explode("opportunities").alias("o"))
    g = o.groupBy("site_id", F.col("o.id").alias("id")).agg(
        F.count("*").alias("affected_pages"), F.sum("o.savings_ms").cast("bigint").alias("total_savings_ms"),
        F.max_by(F.col("o.title"), "recency").alias("title"), F.min("recency").alias("_first"),
    )
    return top_k(g, ["site_id"], [F.col("affected_pages").desc(), F.col("_first"), F.col("id")], n, "rank").drop("_first")


def opportunities_summary(snapshots: DataFrame, pages: int = 10) -> DataFrame:
    """Mobile latest: totals and mean score per opportunity with its worst pages."""
    o = latest_snapshots(snapshots, "mobile").select("site_id", F.struct((-F.unix_micros(F.col("checked_at").cast("timestamp"))).alias("age"), "snapshot_id").alias("recency"), "url", F.explode("opportunities").alias("o")).select(
        "site_id", "recency", "url", "o.*"
    )
    g = o.groupBy("site_id", "id").agg(
        F.count("*").alias("affected_pages"), F.sum("savings_ms").cast("bigint").alias("total_savings_ms"),
        F.sum("savings_bytes").cast("bigint").alias("total_savings_bytes"), F.round(F.avg("score"), 2).alias("avg_score"),
    )
    worst = top_k(o, ["site_id", "id"], [F.col("savings_ms").desc(), F.col("recency")], pages).groupBy("site_id", "id").agg(
        ordered_list(F.col("url"), F.col("_rn")).alias("pages")
    )
    return g.join(worst, ["site_id", "id"])
