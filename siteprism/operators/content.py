"""Plans, briefs, drafts: opportunities, action plans, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteprism.common import literal_rows, severity_rank, top_k
from siteprism.functions import text as X
from siteprism.operators.templates import title_case


def opportunities(issues: DataFrame, clusters: DataFrame, homepages: DataFrame | None = None) -> DataFrame:
    """One row per issue type and per keyword cluster of a site, by priority.

    ``issues(site_id, type, severity)``, ``clusters(site_id, cluster_id, name,
    intent, n_keywords)``, ``homepages(site_id, h1_count)``.
    """
    worst = F.lit(5) - F.max(F.coalesce(severity_rank(F.col("severity")), F.lit(1)))
    tech = issues.groupBy("site_id", "type").agg(F.count("*").alias("n"), worst.alias("priority"))
    label = title_case(F.replace("type", F.lit("_"), F.lit(" ")))
    a = tech.select(
        "site_id", F.lit(1).alias("src"), F.lit("technical").alias("type"), F.col("type").alias("category"),
        F.concat(F.lit("Fix "), label, F.lit(" Issues")).alias("title"),
        F.concat(F.lit("Found "), F.col("n").cast("string"), F.lit(" "), "type", F.lit(" issues to fix")).alias("description"),
        "priority", F.when(F.col("n") > 3, "medium").otherwise("low").alias("effort"),
        F.when(F.col("priority") <= 2, "high").otherwise("medium").alias("impact"),
    )
    b = clusters.filter("n_keywords > 0").select(
        "site_id", F.lit(2).alias("src"), F.lit("content").alias("type"), F.lit("new_content").alias("category"),
        F.concat(F.lit("Create Content for: "), "name").alias("title"),
        F.concat(F.lit("Target "), F.col("n_keywords").cast("string"), F.lit(" keywords with "), "intent", F.lit(" intent")).alias("description"),
        F.when(F.col("intent") == "transactional", 2).otherwise(3).alias("priority"), F.lit("high").alias("effort"),
        F.when(F.col("n_keywords") > 5, "high").otherwise("medium").alias("impact"),
    )
    out = a.unionByName(b)
    if homepages is not None:
        out = out.unionByName(
            homepages.filter("h1_count = 0").select(
                "site_id", F.lit(3).alias("src"), F.lit("technical").alias("type"), F.lit("on_page").alias("category"),
                F.lit("Add Missing H1 Tag").alias("title"), F.lit("Homepage is missing H1 heading").alias("description"),
                F.lit(2).alias("priority"), F.lit("low").alias("effort"), F.lit("medium").alias("impact"),
            )
        )
    return out


ORDER = ["priority", "src", "title"]


def action_plan(opps: DataFrame, weeks: int = 12) -> DataFrame:
    """Five quick wins, five technical tasks, ten content tasks per site, dated."""
    order = [F.col(c) for c in ORDER]
    span = max(4, weeks - 4) // 2
    content = F.col("type") == "content"
    step = opps.filter(content).groupBy("site_id").agg(F.count("*").alias("_n")).withColumn(
        "_k", F.greatest(F.lit(1), F.floor(F.col("_n") / span))
    )
    cut = lambda df, n, phase: top_k(df, ["site_id"], order, n, "rank").withColumn("phase", F.lit(phase))
    low = F.col("effort") == "low"
    quick = cut(opps.filter(low), 5, 1).withColumns({"week_start": F.lit(1), "week_end": F.lit(2)})
    tech = cut(opps.filter((F.col("type") == "technical") & ~low), 5, 2).withColumns({"week_start": F.lit(2), "week_end": F.lit(4)})
    start = F.least(F.lit(4) + 2 * F.floor((F.col("rank") - 1) / F.col("_k")), F.greatest(F.lit(4), F.lit(weeks - 2))).cast("int")
    later = cut(opps.filter(content), 10, 3).join(step.select("site_id", "_k"), "site_id").withColumn("week_start", start).withColumn(
        "week_end", F.least(F.col("week_start") + 2, F.lit(weeks))
    ).drop("_k")
    return _numbered(quick.unionByName(tech).unionByName(later))


def _numbered(rows: DataFrame) -> DataFrame:
    """Running priority over phases; a site has a few dozen rows at most."""
    from pyspark.sql import Window

    name = F.when(F.col("phase") == 1, "Quick Wins").when(F.col("phase") == 2, "Technical Optimization").otherwise("Content Strategy")
    if "phase_name" not in rows.columns:
        rows = rows.withColumn("phase_name", name)
    cols = [c for c in ("phase", "part", "rank") if c in rows.columns]
    return rows.withColumn("priority", F.row_number().over(Window.partitionBy("site_id").orderBy(*cols)))


def content_calendar(plan: DataFrame, as_of: Column) -> DataFrame:
    """Content tasks with their publish date."""
    return plan.filter("type = 'content'").select(
        "site_id", F.col("week_start").alias("week"), F.date_add(as_of, F.col("week_start") * 7).alias("publish_date"), "title",
        F.lit("planned").alias("status"), F.col("description").alias("notes"),
    )


def content_type_of(intent: Column) -> Column:
    return (
        F.when(intent == "transactional", "Landing Page").when(intent == "commercial", "Comparison/Review")
        .when(intent == "navigational", "Service Page").otherwise("Blog Post")
    )


def action_plan_basic(issues: DataFrame, templates: DataFrame, keywords: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Plan from issue rows, template recommendations and keywords (five slices).

    ``issues(site_id, seq, title, severity)``, ``templates(site_id, seq, name,
    page_count, recommendations)``, ``keywords(site_id, keyword_id, text,
    search_volume, difficulty, intent)``, ``seeds(site_id, seq, text)`` for
    sites without keywords.
    """
    seq = [F.col("seq")]
    fix = F.concat(F.lit("Fix: "), "title").alias("task")
    base = ["site_id", "rank", "task", "type", "phase", "part", "week_start", "week_end"]

    def shaped(df: DataFrame, kind: str, phase: int, part: int, start, end) -> DataFrame:
        return df.withColumns({
            "type": F.lit(kind), "phase": F.lit(phase), "part": F.lit(part), "week_start": start, "week_end": end,
        }).select(*base)

    one = lambda sev, n: top_k(issues.filter(F.col("severity").isin(*sev)), ["site_id"], seq, n, "rank").select("site_id", "rank", fix)
    quick = shaped(one(["low", "medium"], 5), "technical", 1, 1, F.lit(1), F.lit(2))
    hard = shaped(one(["high", "critical"], 5), "technical", 2, 1, F.lit(2), F.lit(4))
    five = top_k(templates, ["site_id"], seq, 5, "_t").select(
        "site_id", "_t", "name", F.posexplode(F.slice("recommendations", 1, 2)).alias("_p", "_r")
    )
    tpl = shaped(
        five.select("site_id", (F.col("_t") * 10 + F.col("_p")).alias("rank"), F.concat(F.lit("["), "name", F.lit("] "), "_r").alias("task")),
        "technical", 2, 2, F.lit(3), F.lit(4),
    )
    v = F.coalesce("search_volume", F.lit(0)) / F.greatest(F.when(F.coalesce("difficulty", F.lit(0)) == 0, 1).otherwise(F.col("difficulty")), F.lit(1))
    kind = content_type_of(F.coalesce("intent", F.lit("informational")))
    best = top_k(keywords, ["site_id"], [v.desc(), F.col("keyword_id")], 10, "rank")
    week = F.lit(4) + F.floor((F.col("rank") - 1) / 2).cast("int")
    content = shaped(
        best.select("site_id", "rank", F.concat(F.lit("Create "), kind, F.lit(": "), "text").alias("task")), "content", 3, 1, week, week + 2
    )
    out = quick.unionByName(hard).unionByName(tpl).unionByName(content)
    if seeds is not None:
        bare = seeds.join(keywords.select("site_id").distinct(), "site_id", "left_anti")
        w2 = F.lit(2) + 2 * F.col("rank")
        first = top_k(bare, ["site_id"], seq, 3, "rank").select("site_id", "rank", F.concat(F.lit("Create content for: "), "text").alias("task"))
        out = out.unionByName(shaped(first, "content", 3, 1, w2, w2 + 2))
    name = F.when(F.col("phase") == 1, "Quick Wins").when((F.col("phase") == 2) & (F.col("part") == 2), "Template Optimization").when(
        F.col("phase") == 2, "Technical Optimization").otherwise("Content Strategy")
    return _numbered(out.withColumn("phase_name", name))


def plan_summary(plan: DataFrame, scores: DataFrame, clusters: DataFrame) -> DataFrame:
    """Counts per phase and type with the outcome lines.

    ``scores(site_id, score)``, ``clusters(site_id, n_keywords)``.
    """
    p = plan.groupBy("site_id").agg(
        F.count("*").alias("total_action_items"), F.count_if(F.col("type") == "technical").alias("technical_tasks"),
        F.count_if(F.col("type") == "content").alias("content_tasks"), *[F.count_if(F.col("phase") == i).alias(f"phase_{i}") for i in (1, 2, 3)],
    )
    c = clusters.groupBy("site_id").agg(F.count("*").alias("keyword_clusters"), F.sum("n_keywords").cast("bigint").alias("total_keywords"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    j = p.join(scores, "site_id", "left").join(c, "site_id", "left").withColumns({x: zero(x) for x in ("score", "keyword_clusters", "total_keywords")})
    s = lambda x: F.col(x).cast("string")
    # Outcome lines.
    lines = F.array(
        F.concat(F.lit("Fix "), s("technical_tasks"), F.lit(" technical issues")),
        F.concat(F.lit("Create "), s("content_tasks"), F.lit(" new content pieces")),
        F.concat(F.lit("Target "), s("total_keywords"), F.lit(" keywords across "), s("keyword_clusters"), F.lit(" topic clusters")),
        F.concat(F.lit("Improve SEO score from "), s("score"), F.lit(" to 85+")),
    )
    return j.withColumn("expected_outcomes", lines)


def plan_stats(tasks: DataFrame) -> DataFrame:
    """Tasks by status and the share done."""
    s = F.col("status")
    return tasks.groupBy("plan_id").agg(
        F.count("*").alias("total"), F.count_if(s == "todo").alias("todo"), F.count_if(s == "in_progress").alias("in_progress"),
        F.count_if(s == "done").alias("done"), (F.count_if(s == "done") / F.count("*") * 100).alias("progress"),
    )


# Brief per intent; {k} is the keyword, {K} the keyword in title case.
BRIEFS = [
    ("transactional", 800,
     ["Book {K} - Best Rates & Availability", "{K} | Official Reservations", "Reserve {K} - Exclusive Offers Available"],
     "Book {k} with best price guarantee. Check availability, compare rates, and secure your reservation today. Special offers available.",
     ["Overview", "Room Types & Rates", "Booking Information", "Special Offers", "Guest Reviews"],
     ["book", "reserve", "rates", "availability"], ["Book Now", "Check Availability", "Get Best Price"]),
    ("commercial", 2000,
     ["Best {K} - Expert Reviews & Comparison", "Top {K} Ranked for 2025", "{K} Guide: Which One Is Right for You?"],
     "Compare the best {k} options with our expert guide. Detailed reviews, pros & cons, and recommendations to help you choose.",
     ["Introduction", "Quick Comparison Table", "Detailed Reviews", "Pros and Cons", "How to Choose", "Our Recommendation"],
     ["best", "review", "compare", "top", "vs"], ["See Full Details", "Compare Prices", "Read Full Review"]),
    ("navigational", 1000,
     ["{K} - Official Information", "About {K} | Location, Contact & Details", "{K} - Everything You Need to Know"],
     "Official information about {k}. Find location details, contact information, hours, and everything you need to plan your visit.",
     ["About", "Location & Access", "Services & Amenities", "Contact Information", "Nearby Attractions"],
     ["location", "contact", "hours", "address"], ["Get Directions", "Contact Us", "Visit Website"]),
    ("informational", 1500,
     ["Complete Guide to {K} (2025)", "{K}: What You Need to Know Before You Go", "Everything About {K} - Tips & Insights"],
     "Discover everything about {k}. Our comprehensive guide covers tips, recommendations, and insider knowledge to help you make the most of your experience.",
     ["Introduction", "Overview", "Key Highlights", "Practical Tips", "Frequently Asked Questions", "Summary & Next Steps"],
     ["guide", "tips", "how to", "best"], ["Learn More", "Read Related Guide", "Get Started"]),
]


def brief_table(spark: SparkSession) -> DataFrame:
    return literal_rows(
        spark, BRIEFS,
        "brief_intent string, target_word_count int, titles array<string>, meta string, outline array<string>, extra array<string>, ctas array<string>",
    )


def intent_brief(keywords: DataFrame) -> DataFrame:
    """Content brief per keyword by its intent (unknown = informational)."""
    intent = F.coalesce("intent", F.lit("informational"))
    known = F.when(intent.isin("transactional", "commercial", "navigational"), intent).otherwise("informational")
    j = keywords.withColumn("brief_intent", known).join(brief_table(keywords.sparkSession), "brief_intent")
    fill = lambda c: F.replace(F.replace(c, F.lit("{k}"), F.col("text")), F.lit("{K}"), F.col("_kt"))
    return j.withColumn("_kt", title_case(F.col("text"))).select(
        "site_id", "keyword_id", "text", intent.alias("intent"), "target_word_count", F.transform("titles", fill).alias("title_suggestions"),
        fill(F.col("meta")).alias("meta_description"), "outline", F.array_distinct(F.concat(F.array("text"), F.col("extra"))).alias("keywords_to_include"),
        F.col("ctas").alias("cta_suggestions"),
    )


def _markdown(body: Column) -> tuple[Column, Column]:
    return body.contains("# "), X.occurrences(body, F.lit("\n#"))


def content_score(drafts: DataFrame) -> DataFrame:
    """``drafts(draft_id, target_keyword, body)`` → score and facts, not below 0."""
    body, kw = F.coalesce("body", F.lit("")), F.coalesce("target_keyword", F.lit(""))
    h1, heads = _markdown(body)
    d = drafts.select("draft_id", X.word_count(body).alias("word_count"), X.occurrences(F.lower(body), F.lower(kw)).alias("keyword_count"), h1.alias("has_h1"), heads.alias("heading_count"))
    n = F.col("word_count")
    density = F.when(n > 0, F.col("keyword_count") / n * 100).otherwise(0.0)
    points = (
        F.when(n < 300, 20).when(n < 1000, 10).otherwise(0) + F.when(density < 0.5, 10).when(density > 3, 15).otherwise(0)
        + F.when(F.col("has_h1"), 0).otherwise(15) + F.when(F.col("heading_count") < 3, 5).otherwise(0)
    )
    issues = F.array_compact(F.array(
        F.when(n < 1000, "word_count"), F.when(density < 0.5, "keyword_density").when(density > 3, "keyword_stuffing"),
        F.when(~F.col("has_h1"), "missing_h1"), F.when(F.col("heading_count") < 3, "few_headings"),
    ))
    return d.select("*", F.round(density, 2).alias("keyword_density"), F.greatest(F.lit(0), F.lit(100) - points).alias("score"), issues.alias("issues"))


def draft_check(drafts: DataFrame) -> DataFrame:
    """Draft against its brief's length; density rounded first, no floor.

    Also reads ``target_word_count`` (NULL = 1500).
    """
    body, kw = F.coalesce("body", F.lit("")), F.coalesce("target_keyword", F.lit(""))
    h1, heads = _markdown(body)
    n, target = X.word_count(body), F.coalesce("target_word_count", F.lit(1500))
    d = drafts.select(
        "draft_id", n.alias("word_count"), target.alias("target"), h1.alias("has_h1"), heads.alias("heading_count"),
        F.when((n > 0) & (kw != ""), F.round(X.occurrences(F.lower(body), F.lower(kw)) / n * 100, 2)).otherwise(0.0).alias("keyword_density"),
    )
    short, k = F.col("word_count") < F.col("target") * 0.8, F.col("keyword_density")
    points = (
        F.when(short, 10).otherwise(0) + F.when(k < 0.5, 10).when(k > 3, 20).otherwise(0)
        + F.when(F.col("has_h1"), 0).otherwise(15) + F.when(F.col("heading_count") < 3, 5).otherwise(0)
    )
    return d.withColumn("score", F.lit(100) - points)


def next_version(drafts: DataFrame) -> DataFrame:
    return drafts.groupBy("brief_id").agg((F.max("version") + 1).alias("next_version"))
