"""Uptime, ranking, score and index alerts in batch form; every window takes as_of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteprism.common import ordered_list, top_k
from siteprism.operators.limits import sliding_rate_limit


def is_up(status: Column) -> Column:
    return F.coalesce((status >= 200) & (status < 400), F.lit(False))


def _since(as_of: Column, days: int) -> Column:
    return F.col("checked_at") >= as_of - F.make_dt_interval(F.lit(days))


def uptime_stats(checks: DataFrame, sites: DataFrame, as_of: Column, windows: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    """Checks, up checks and percentage for several windows in one aggregate.

    A site without checks in a window counts as 100 % up.
    """
    recent = checks.filter(_since(as_of, max(windows)))
    aggs = []
    for d in windows:
        inside = _since(as_of, d)
        aggs += [F.count_if(inside).alias(f"total_{d}d"), F.count_if(inside & F.col("is_up")).alias(f"up_{d}d")]
    out = sites.select("site_id").distinct().join(recent.groupBy("site_id").agg(*aggs), "site_id", "left").na.fill(0)
    pct = lambda d: F.when(F.col(f"total_{d}d") == 0, 100.0).otherwise(100.0 * F.col(f"up_{d}d") / F.col(f"total_{d}d"))
    return out.withColumns({f"uptime_{d}d": pct(d) for d in windows})


def current_status(checks: DataFrame, sites: DataFrame) -> DataFrame:
    """up / down from the newest check, unknown without any."""
    last = checks.groupBy("site_id").agg(F.max(F.struct("checked_at", "check_id", "is_up")).alias("m"))
    return sites.select("site_id").distinct().join(last, "site_id", "left").select(
        "site_id", F.when(F.col("m").isNull(), "unknown").when(F.col("m.is_up"), "up").otherwise("down").alias("status"),
        F.col("m.checked_at").alias("last_checked_at"),
    )


def downtime_checks(checks: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    return checks.filter(_since(as_of, days)).groupBy("site_id").agg(F.count_if(~F.col("is_up")).alias("incidents"))


def newest_checks(checks: DataFrame, n: int) -> DataFrame:
    return top_k(checks, ["site_id"], [F.col("checked_at").desc(), F.col("check_id").desc()], n)


def consecutive_failures(checks: DataFrame, n: int) -> DataFrame:
    """Down checks among the newest n; 0 with fewer than n checks."""
    g = newest_checks(checks, n).groupBy("site_id").agg(F.count("*").alias("c"), F.count_if(~F.col("is_up")).alias("d"))
    return g.select("site_id", F.when(F.col("c") < n, 0).otherwise(F.col("d")).alias("failures"))


def uptime_alerts(rules: DataFrame, checks: DataFrame) -> DataFrame:
    """Critical alert per rule whose site is down with n of the newest n checks down.

    ``rules(rule_id, site_id, consecutive_failures)``, NULL = 2.  The newest n are down where the site's run of down
    checks, those behind its last check that was up, has n or more: one count per site serves rules of any n.
    """
    at = F.struct("checked_at", "check_id")
    last_up = checks.filter("is_up").groupBy("site_id").agg(F.max(at).alias("_up"))
    behind = checks.filter("not is_up").join(last_up, "site_id", "left").filter(F.col("_up").isNull() | (at > F.col("_up")))
    runs = behind.groupBy("site_id").agg(F.count("*").alias("run"))
    n = F.coalesce("consecutive_failures", F.lit(2)).cast("int")
    return rules.join(runs, "site_id").filter(F.col("run") >= n).select("rule_id", "site_id", F.lit("critical").alias("severity"), n.alias("failures"))


def ranking_drop_alerts(rules: DataFrame, keywords: DataFrame) -> DataFrame:
    """Rules whose tracked keywords fell by the threshold; five worst drops listed.

    ``rules(rule_id, site_id, position_drop, min_position, keyword_ids)``.
    """
    threshold, floor = F.coalesce("position_drop", F.lit(10)), F.coalesce("min_position", F.lit(100))
    k = keywords.filter("is_tracked and current_position is not null and previous_position is not null and previous_position <> 0")
    j = k.select("site_id", "keyword_id", "text", "current_position", "previous_position").join(rules, "site_id")
    listed = F.coalesce(F.size("keyword_ids"), F.lit(0)) <= 0
    drop = F.col("current_position") - F.col("previous_position")
    hits = j.filter(
        (listed | F.array_contains("keyword_ids", F.col("keyword_id"))) & (F.col("previous_position") <= floor) & (drop >= threshold)
    ).withColumn("drop", drop)
    counts = hits.groupBy("rule_id", "site_id").agg(F.count("*").alias("drops"))
    worst = top_k(hits, ["rule_id"], [F.col("drop").desc(), F.col("keyword_id")], 5).groupBy("rule_id").agg(
        ordered_list(F.col("text"), F.col("_rn")).alias("worst")
    )
    return counts.join(worst, "rule_id").select(
        "rule_id", "site_id", F.when(F.col("drops") < 5, "warning").otherwise("critical").alias("severity"), "drops", "worst"
    )


def audit_score_alerts(rules: DataFrame, runs: DataFrame) -> DataFrame:
    """Score below the threshold or dropped by a share; the drop reason wins.

    ``rules(rule_id, site_id, threshold, drop_percentage)``.
    """
    scored = runs.filter("status = 'completed' and score is not null")
    two = top_k(scored, ["site_id"], [F.col("completed_at").desc(), F.col("audit_id").desc()], 2).groupBy("site_id").agg(
        F.max(F.when(F.col("_rn") == 1, F.col("score"))).alias("current"), F.max(F.when(F.col("_rn") == 2, F.col("score"))).alias("previous")
    )
    j = rules.join(two, "site_id")
    share = F.when(F.col("previous") > 0, 100.0 * (F.col("previous") - F.col("current")) / F.col("previous"))
    reason = F.when(share >= F.col("drop_percentage"), "score_drop").when(
        F.col("current") < F.coalesce("threshold", F.lit(70)), "below_threshold"
    )
    return j.withColumn("reason", reason).filter("reason is not null").select(
        "rule_id", "site_id", "reason", F.when(F.col("current") >= 50, "warning").otherwise("critical").alias("severity"), "current", "previous"
    )


def index_changes(crawls: DataFrame, pages: DataFrame) -> DataFrame:
    """URLs newly noindex or newly 404 between a site's last two completed crawls.

    ``crawls(crawl_id, site_id, status, completed_at)``, ``pages(crawl_id, url,
    noindex, status_code)``.  Both crawls are aggregated per URL in one shuffle
    instead of a self join.
    """
    two = top_k(crawls.filter("status = 'completed'"), ["site_id"], [F.col("completed_at").desc(), F.col("crawl_id").desc()], 2)
    pairs = two.select("crawl_id", "site_id", F.col("_rn").alias("age"), F.count("*").over(_site_window()).alias("n")).filter("n = 2")
    p = pages.join(pairs.drop("n"), "crawl_id")
    now, before = F.col("age") == 1, F.col("age") == 2
    status = F.col("status_code")
    per_url = p.groupBy("site_id", "url").agg(
        F.bool_or(now & F.col("noindex")).alias("now_noindex"), F.bool_or(before & ~F.col("noindex")).alias("was_indexable"),
        F.bool_or(now & (status == 404)).alias("now_404"), F.bool_or(before & status.between(200, 399)).alias("was_ok"),
    )
    kinds = F.array_compact(F.array(
        F.when(F.col("now_noindex") & F.col("was_indexable"), "newly_noindex"), F.when(F.col("now_404") & F.col("was_ok"), "newly_404")
    ))
    return per_url.select("site_id", "url", F.explode(kinds).alias("change"))


def _site_window():
    from pyspark.sql import Window

    return Window.partitionBy("site_id")  # after a top-2: at most two rows


def index_status_alerts(rules: DataFrame, crawls: DataFrame, pages: DataFrame) -> DataFrame:
    """``rules(rule_id, site_id, check_noindex, check_404, check_deindex_count)``."""
    changes = index_changes(crawls, pages)
    counts = changes.groupBy("site_id").agg(
        F.count_if(F.col("change") == "newly_noindex").alias("noindex_n"), F.count_if(F.col("change") == "newly_404").alias("gone_n")
    )
    urls = top_k(changes, ["site_id", "change"], [F.col("url")], 10).groupBy("site_id").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("change") == c, F.col("url")))).alias(c) for c in ("newly_noindex", "newly_404")]
    )
    on = lambda c: F.coalesce(c, F.lit(True))
    total = F.when(on("check_noindex"), F.col("noindex_n")).otherwise(0) + F.when(on("check_404"), F.col("gone_n")).otherwise(0)
    return (
        rules.join(counts, "site_id").join(urls, "site_id").withColumn("total_issues", total)
        .filter(F.col("total_issues") >= F.coalesce("check_deindex_count", F.lit(5)))
        .select("rule_id", "site_id", F.when(F.col("total_issues") < 20, "warning").otherwise("critical").alias("severity"),
                "total_issues", "newly_noindex", "newly_404")
    )


def cooldown_filter(candidates: DataFrame, rules: DataFrame, as_of: Column) -> DataFrame:
    """Candidates whose rule was never triggered or long enough ago."""
    r = rules.select("rule_id", "last_triggered_at", "cooldown_minutes")
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("last_triggered_at").cast("timestamp"))
    ready = F.col("last_triggered_at").isNull() | (age >= F.coalesce("cooldown_minutes", F.lit(60)).cast("bigint") * 60_000_000)
    return candidates.join(r, "rule_id").filter(ready).drop("last_triggered_at", "cooldown_minutes")


def cooldown_sequence(candidates: DataFrame, cooldown_minutes: int) -> DataFrame:
    """Which of a rule's candidate times fire when each firing mutes the next minutes.

    The same feedback as a rate limit of one per window, so it runs on it.
    """
    return sliding_rate_limit(candidates, ["rule_id"], 1, cooldown_minutes * 60).select("rule_id", "ts", F.col("allowed").alias("fires"))


def auto_resolve(events: DataFrame, checks: DataFrame) -> DataFrame:
    """Resolve active uptime events of sites whose three newest checks are up."""
    good = newest_checks(checks, 3).groupBy("site_id").agg(
        F.bool_and("is_up").alias("a"), F.count("*").alias("c")
    ).filter("a and c = 3").select("site_id", F.lit(True).alias("_good"))
    active = (F.col("alert_type") == "uptime") & (F.col("status") == "active") & F.col("_good").isNotNull()
    return events.join(good, "site_id", "left").withColumn("status", F.when(active, "resolved").otherwise(F.col("status"))).drop("_good")


def stale_crawls(crawls: DataFrame, as_of: Column, hours: int = 2) -> DataFrame:
    """Crawls running longer than `hours` become failed."""
    old = (F.col("status") == "running") & (F.col("started_at") < as_of - F.make_dt_interval(F.lit(0), F.lit(hours)))
    return crawls.withColumn("status", F.when(old, "failed").otherwise(F.col("status")))
