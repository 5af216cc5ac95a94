"""Keywords: discovery, SERP facts, rank tracking, gaps, clusters, strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteprism.common import ordered_list, top_k
from siteprism.functions import text as X
from siteprism.functions import urls as U

# Substrings that decide the search intent, tested in this order.
TRANSACTIONAL = [
    "book", "reserve", "reserva", "reservar", "buy", "comprar", "purchase", "order", "price", "precio", "cheap",
    "barato", "discount", "descuento", "deal", "oferta", "coupon", "cupon", "sale", "booking", "disponibilidad",
    "availability", "quote", "presupuesto", "hire", "contratar",
]
COMMERCIAL = [
    "best", "mejor", "top", "review", "reseña", "compare", "comparar", "vs", "versus", "alternative", "alternativa",
    "recommended", "recomendado", "rating", "valoracion", "opinion", "opiniones", "which", "cual", "worth", "value",
    "quality", "calidad",
]
INFORMATIONAL = [
    "how", "como", "what", "que", "why", "por que", "when", "cuando", "where", "donde", "who", "quien", "guide",
    "guia", "tutorial", "tips", "consejos", "ideas", "example", "ejemplo", "definition", "meaning", "significado",
    "history", "historia", "list", "lista",
]
HOTELS = ["hotel", "hotels", "hoteles", "resort", "hostel"]
PLACES = ["mallorca", "barcelona", "tenerife", "lanzarote", "menorca", "costa brava", "spain", "españa"]
API_INTENTS = ["informational", "navigational", "commercial", "transactional"]

# Result item type that sets each SERP feature.
FEATURE_TYPES = {
    "featured_snippet": "featured_snippet", "people_also_ask": "people_also_ask", "local_pack": "local_pack",
    "knowledge_panel": "knowledge_graph", "video_carousel": "video", "image_pack": "images",
    "top_stories": "top_stories", "shopping_results": "shopping",
}


def classify_intent(text: Column, api_intents: Column | None = None) -> Column:
    """Intent from the API's flags (array of names) first, then from substrings."""
    low = F.lower(text)
    has = lambda words: low.rlike("|".join(words))
    guess = (
        F.when(has(TRANSACTIONAL), "transactional").when(has(COMMERCIAL), "commercial").when(has(INFORMATIONAL), "informational")
        .when(has(HOTELS) & has(PLACES), "commercial").when(has(HOTELS), "navigational").otherwise("informational")
    )
    if api_intents is None:
        return guess
    given = F.coalesce(*[F.when(F.array_contains(api_intents, i), F.lit(i)) for i in API_INTENTS])
    return F.coalesce(given, guess)


def dedupe_keywords(found: DataFrame, keep: int | None = None) -> DataFrame:
    """First row per (site, lower(text)), optionally the first `keep` per site.

    ``found(site_id, seq, text, …)``; a partial aggregate, no window over a site.
    """
    cols = [c for c in found.columns if c not in ("site_id", "seq")]
    first = (
        found.filter(F.coalesce("text", F.lit("")) != "")
        .groupBy("site_id", F.lower("text").alias("key"))
        .agg(F.min_by(F.struct("seq", *cols), "seq").alias("r"))
        .select("site_id", "r.*")
    )
    return first if keep is None else top_k(first, ["site_id"], [F.col("seq")], keep).drop("_rn")


def upsert_keywords(existing: DataFrame, found: DataFrame) -> DataFrame:
    """Merge discovered metrics into the keyword table by (site_id, text).

    Known keywords get volume, cpc and competition replaced and keep the rest;
    new ones come with difficulty and intent.  ``is_new`` marks inserts.
    """
    metrics, rest = ["search_volume", "cpc", "competition"], ["difficulty", "intent"]
    e = existing.select("site_id", "text", *metrics, *rest).withColumn("_e", F.lit(True))
    f = found.select("site_id", "text", *[F.col(c).alias(f"f_{c}") for c in metrics + rest]).withColumn("_f", F.lit(True))
    j = e.join(f, ["site_id", "text"], "full_outer")
    new = F.col("_e").isNull()
    return j.select(
        "site_id", "text",
        *[F.when(F.col("_f").isNotNull(), F.col(f"f_{c}")).otherwise(F.col(c)).alias(c) for c in metrics],
        *[F.when(new, F.col(f"f_{c}")).otherwise(F.col(c)).alias(c) for c in rest],
        new.alias("is_new"),
    )


def serp_features(items: DataFrame) -> DataFrame:
    """Ten feature flags per keyword from its result items."""
    t = F.col("type")
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return items.groupBy("keyword").agg(
        *[flag(t == v).alias(k) for k, v in FEATURE_TYPES.items()],
        flag((t == "organic") & F.col("has_links")).alias("sitelinks"),
        flag((t == "organic") & F.col("has_rating")).alias("reviews"),
    )


def competitor_positions(items: DataFrame, n: int = 10) -> DataFrame:
    """First ten organic results per keyword, in item order."""
    organic = items.filter("type = 'organic'").select("keyword", "item_seq", F.col("rank_group").alias("position"), "domain", "url")
    return top_k(organic, ["keyword"], [F.col("item_seq"), F.col("domain"), F.col("url")], n, "rank")


def find_position(items: DataFrame, targets: DataFrame) -> DataFrame:
    """Own position and URL per (site, keyword), NULL when not ranking.

    ``targets(site_id, keyword, primary_domain)``.
    """
    organic = items.filter("type = 'organic'").select(
        "keyword", U.bare_domain(F.col("domain")).alias("_d"), "item_seq", F.col("rank_group").alias("position"), "url"
    )
    best = organic.groupBy("keyword", "_d").agg(F.min(F.struct("item_seq", "position", "url")).alias("m"))
    t = targets.withColumn("_d", U.bare_domain(F.col("primary_domain")))
    return t.join(best, ["keyword", "_d"], "left").select("site_id", "keyword", "m.position", F.col("m.url").alias("ranking_url"))


def update_rankings(keywords: DataFrame, results: DataFrame, checked_at: Column) -> DataFrame:
    """Shift current to previous and take the new position; failed results skip.

    ``results(keyword_id, success, position, url)``, one row per keyword.
    """
    ok = results.filter("success").select("keyword_id", F.col("position").alias("_p"), F.col("url").alias("_u"), F.lit(True).alias("_ok"))
    j = keywords.join(ok, "keyword_id", "left")
    done = F.col("_ok").isNotNull()
    take = lambda new, old: F.when(done, new).otherwise(F.col(old)).alias(old)
    changed = {"previous_position", "current_position", "best_position", "ranking_url", "last_checked_at"}
    return j.select(
        *[c for c in keywords.columns if c not in changed],
        take(F.col("current_position"), "previous_position"), take(F.col("_p"), "current_position"),
        take(F.least("best_position", "_p"), "best_position"), take(F.col("_u"), "ranking_url"),
        take(checked_at, "last_checked_at"),
    )


def ranking_state(history: DataFrame) -> DataFrame:
    """Current, previous and best position per keyword from its full history.

    ``history(keyword_id, check_seq, checked_at, position)``.
    """
    last_two = top_k(history, ["keyword_id"], [F.col("checked_at").desc(), F.col("check_seq").desc()], 2)
    now = last_two.groupBy("keyword_id").agg(
        F.max(F.when(F.col("_rn") == 1, F.col("position"))).alias("current_position"),
        F.max(F.when(F.col("_rn") == 2, F.col("position"))).alias("previous_position"),
        F.max("checked_at").alias("last_checked_at"),
    )
    best = history.groupBy("keyword_id").agg(F.min("position").alias("best_position"), F.count("*").alias("checks"))
    return now.join(best, "keyword_id")


def sites_with_tracked(sites: DataFrame, keywords: DataFrame) -> DataFrame:
    return sites.join(keywords.filter("is_tracked").select("site_id").distinct(), "site_id", "left_semi")


def track_top(keywords: DataFrame, limit: int = 50, min_volume: int = 100) -> DataFrame:
    """Untracked keywords to start tracking: the most searched ones per site."""
    candidates = keywords.filter(~F.col("is_tracked") & (F.col("search_volume") >= min_volume))
    return top_k(candidates, ["site_id"], [F.col("search_volume").desc(), F.col("keyword_id")], limit, "rank")


def set_tracking(keywords: DataFrame, chosen: DataFrame, tracked: bool) -> DataFrame:
    """Set the flag for listed (site_id, keyword_id) rows."""
    c = chosen.select("site_id", "keyword_id").distinct().withColumn("_hit", F.lit(True))
    return keywords.join(c, ["site_id", "keyword_id"], "left").withColumn(
        "is_tracked", F.when(F.col("_hit").isNotNull(), F.lit(tracked)).otherwise(F.col("is_tracked"))
    ).drop("_hit")


def keyword_gaps(ours: DataFrame, theirs: DataFrame, limit: int = 100, min_volume: int = 50) -> DataFrame:
    """Keywords competitors have and we lack, by priority.

    ``ours(site_id, text)``, ``theirs(site_id, seq, competitor, text,
    search_volume, difficulty, intent)``.  First-seen facts and counts are a
    partial aggregate, the top `limit` is taken on those narrow rows, and only
    the winners' competitor names are collected.
    """
    own = ours.filter(F.coalesce("text", F.lit("")) != "").select("site_id", F.lower("text").alias("keyword")).distinct()
    rival = theirs.filter(F.coalesce("text", F.lit("")) != "").withColumn("keyword", F.lower("text"))
    facts = rival.groupBy("site_id", "keyword").agg(
        F.min_by(F.struct("search_volume", "difficulty", "intent"), "seq").alias("f"), F.count("*").alias("competitor_count")
    )
    gaps = facts.filter(F.col("f.search_volume") > min_volume).join(own, ["site_id", "keyword"], "left_anti")
    easy = (F.col("f.difficulty") > 0) & (F.col("f.difficulty") < 50)
    priority = F.col("f.search_volume") * F.col("competitor_count") * F.when(easy, 1.5).otherwise(1.0)
    best = top_k(
        gaps.select("site_id", "keyword", "f.*", "competitor_count", priority.alias("priority_score")),
        ["site_id"], [F.col("priority_score").desc(), F.col("keyword")], limit, "rank",
    )
    names = rival.join(best.select("site_id", "keyword"), ["site_id", "keyword"], "left_semi").groupBy("site_id", "keyword").agg(
        ordered_list(F.col("competitor"), F.col("seq")).alias("competitors")
    )
    return best.join(names, ["site_id", "keyword"])


def upsert_gaps(existing: DataFrame, gaps: DataFrame) -> DataFrame:
    """Merge new gap rows into the stored ones by (site_id, keyword); status stays."""
    cols = ["search_volume", "difficulty", "intent", "competitor_count", "competitors", "priority_score"]
    g = gaps.select("site_id", "keyword", *[F.col(c).alias(f"g_{c}") for c in cols]).withColumn("_g", F.lit(True))
    j = existing.join(g, ["site_id", "keyword"], "full_outer")
    return j.select(
        "site_id", "keyword", *[F.when(F.col("_g").isNotNull(), F.col(f"g_{c}")).otherwise(F.col(c)).alias(c) for c in cols],
        F.coalesce("status", F.lit("new")).alias("status"),
    )


def list_keywords(
    keywords: DataFrame, members: DataFrame | None = None, cluster_id: str | None = None, search: str | None = None,
    page: int = 1, per_page: int = 50,
) -> DataFrame:
    """One page of keywords by volume, NULLs last; optional cluster and search."""
    k = keywords
    if members is not None and cluster_id is not None:
        k = k.join(members.filter(F.col("cluster_id") == cluster_id).select("keyword_id").distinct(), "keyword_id", "left_semi")
    if search:
        k = k.filter(F.col("text").ilike(f"%{search}%"))
    return k.orderBy(F.col("search_volume").desc_nulls_last(), "keyword_id").offset((page - 1) * per_page).limit(per_page)


def cluster_stats(clusters: DataFrame, members: DataFrame, keywords: DataFrame) -> DataFrame:
    """Keyword count and total volume per cluster, 0 for empty ones."""
    stats = members.join(keywords.select("keyword_id", "search_volume"), "keyword_id").groupBy("cluster_id").agg(
        F.count("*").alias("keyword_count"), F.sum("search_volume").alias("total_volume")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return clusters.join(stats, "cluster_id", "left").select(*clusters.columns, zero("keyword_count"), zero("total_volume"))


def ranking_history(history: DataFrame, keyword_id, days: int, as_of: Column) -> DataFrame:
    """Checks of one keyword in the last days, newest first."""
    return history.filter(
        (F.col("keyword_id") == keyword_id) & (F.col("checked_at") >= as_of - F.make_dt_interval(F.lit(days)))
    ).orderBy(F.col("checked_at").desc(), F.col("check_seq").desc())


def rankings_summary(keywords: DataFrame) -> DataFrame:
    """Seven figures per site over tracked keywords, in one aggregate."""
    now, before = F.col("current_position"), F.col("previous_position")
    return keywords.filter("is_tracked").groupBy("site_id").agg(
        F.count("*").alias("total_tracked"), F.count_if(now <= 3).alias("in_top_3"), F.count_if(now <= 10).alias("in_top_10"),
        F.count_if(now.isNull()).alias("not_ranking"), F.count_if(now < before).alias("improved"),
        F.count_if(now > before).alias("declined"), F.round(F.avg(now), 1).alias("average_position"),
    )


def ranking_changes(keywords: DataFrame, limit: int = 20) -> DataFrame:
    """Biggest improvements, declines, new and lost rankings per site, in one pass."""
    now, before = F.col("current_position"), F.col("previous_position")
    kind = (
        F.when(now < before, "improved").when(now > before, "declined")
        .when(now.isNotNull() & before.isNull(), "new").when(now.isNull() & before.isNotNull(), "lost")
    )
    key = F.when(now < before, now - before).when(now > before, before - now).when(before.isNull(), now).otherwise(before)
    rows = keywords.filter("is_tracked").select(
        "site_id", "keyword_id", "current_position", "previous_position", kind.alias("change_type"),
        X.position_change(before, now).alias("change"), key.alias("_key"),
    ).filter("change_type is not null")
    return top_k(rows, ["site_id", "change_type"], [F.col("_key"), F.col("keyword_id")], limit, "rank").drop("_key")


def intent_clusters(keywords: DataFrame, pool: int | None = None, listed: int = 10) -> DataFrame:
    """Keywords per site and intent: totals over all (on request over the `pool` best of a site), and the `listed` best by volume per difficulty."""
    v = F.coalesce("search_volume", F.lit(0))
    d = F.greatest(F.when(F.coalesce("difficulty", F.lit(0)) == 0, F.lit(1)).otherwise(F.col("difficulty")), F.lit(1))
    order = [(v / d).desc(), F.col("keyword_id")]
    best = keywords if pool is None else top_k(keywords, ["site_id"], order, pool).drop("_rn")
    best = best.withColumn("intent", F.coalesce("intent", F.lit("informational")))
    key = ["site_id", "intent"]
    top = top_k(best, key, order, listed).groupBy(*key).agg(ordered_list(F.col("text"), F.col("_rn")).alias("keywords"))
    totals = best.groupBy(*key).agg(F.sum(v).cast("bigint").alias("total_volume"), F.count("*").alias("keyword_count"))
    return totals.join(top, key).withColumn("name", F.concat(F.initcap("intent"), F.lit(" Keywords")))


def suggest_format(intent: Column) -> Column:
    return (
        F.when(intent == "informational", "Blog post or guide").when(intent == "transactional", "Product page or landing page")
        .when(intent == "commercial", "Comparison or review article").when(intent == "navigational", "Category or pillar page")
        .otherwise("Blog post")
    )


def keyword_strategy(clusters: DataFrame, members: DataFrame, keywords: DataFrame) -> DataFrame:
    """Per cluster: size, truncated mean volume, first five keywords, format.

    ``clusters(cluster_id, label, intent)``, ``members(cluster_id, keyword_id, seq)``.
    """
    m = members.join(keywords.select("keyword_id", "text", "search_volume"), "keyword_id")
    stats = m.groupBy("cluster_id").agg(
        F.count("*").alias("keyword_count"), F.floor(F.avg(F.coalesce("search_volume", F.lit(0)))).cast("bigint").alias("avg_search_volume")
    )
    first = top_k(m.select("cluster_id", "seq", "keyword_id", "text"), ["cluster_id"], [F.col("seq"), F.col("keyword_id")], 5).groupBy(
        "cluster_id"
    ).agg(ordered_list(F.col("text"), F.col("_rn")).alias("top_keywords"))
    return clusters.join(stats, "cluster_id", "left").join(first, "cluster_id", "left").select(
        "cluster_id", "label", "intent", F.coalesce("keyword_count", F.lit(0)).alias("keyword_count"),
        F.coalesce("avg_search_volume", F.lit(0)).alias("avg_search_volume"),
        F.coalesce("top_keywords", F.array().cast("array<string>")).alias("top_keywords"),
        suggest_format(F.lower("intent")).alias("suggested_format"),
    )


def priority_keywords(keywords: DataFrame, n: int = 10) -> DataFrame:
    return top_k(keywords, ["site_id"], [F.coalesce("search_volume", F.lit(0)).desc(), F.col("keyword_id")], n, "rank")


def serp_content_types(results: DataFrame) -> DataFrame:
    """Content formats seen among a keyword's results; Article when none shows."""
    url, title = F.lower("url"), F.lower("title")
    # Format names and the substrings that show them.
    tests = [
        ("Blog post", url.rlike("blog|article")), ("Guide/Tutorial", title.rlike("guide|how to")), ("Review", title.contains("review")),
        ("List/Roundup", title.rlike("best|top")), ("Comparison", title.rlike("vs|versus")),
    ]
    seen = results.groupBy("keyword").agg(*[F.max(F.coalesce(c, F.lit(False))).alias(f"t{i}") for i, (_, c) in enumerate(tests)])
    names = F.array_compact(F.array(*[F.when(F.col(f"t{i}"), n) for i, (n, _) in enumerate(tests)]))
    return seen.select("keyword", F.when(F.size(names) == 0, F.array(F.lit("Article"))).otherwise(names).alias("content_types"))


def keyword_report(keywords: DataFrame, n: int = 30) -> DataFrame:
    """Top keywords per site by volume with the site's count and total volume."""
    totals = keywords.groupBy("site_id").agg(
        F.count("*").alias("keywords_found"), F.sum(F.coalesce("search_volume", F.lit(0))).cast("bigint").alias("total_volume")
    )
    top = priority_keywords(keywords, n)
    return top.join(totals, "site_id").select(
        "site_id", "rank", F.left("text", F.lit(40)).alias("text"), F.coalesce("search_volume", F.lit(0)).alias("search_volume"),
        "difficulty", "intent", "keywords_found", "total_volume",
    )
