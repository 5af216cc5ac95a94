"""Issue lists: quick per-page issues, scores from them, comparison, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteprism.common import severity_rank, top_k
from siteprism.operators.guides import guide_table

_N = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))


def quick_audit_issues(pages: DataFrame) -> DataFrame:
    """Per-page issues of the light audit: title, description, h1, length.

    Reads ``url, title, meta_description, h1, word_count``; each rule family
    gives at most one issue.
    """
    title, desc = F.coalesce("title", F.lit("")), F.coalesce("meta_description", F.lit(""))
    n_h1, words = _N("h1"), F.coalesce("word_count", F.lit(0))

    def issue(kind: str, category: str, severity: str, name: str, text: Column, fix: str) -> Column:
        return F.struct(
            F.lit(kind).alias("type"), F.lit(category).alias("category"), F.lit(severity).alias("severity"),
            F.lit(name).alias("title"), text.alias("description"), F.lit(fix).alias("suggested_fix"),
        )

    fmt, lit = F.format_string, F.lit
    # Names, texts and fixes shown to users.
    found = F.array_compact(
        F.array(
            F.when(title == "", issue("missing_title", "On-Page", "high", "Missing Title Tag", lit("The page is missing a title tag."),
                                      "Add a unique, descriptive title tag between 50-60 characters."))
            .when(F.length(title) < 30, issue("short_title", "On-Page", "medium", "Title Tag Too Short",
                                              fmt("The title tag is only %d characters.", F.length(title)),
                                              "Expand the title to 50-60 characters for better SEO."))
            .when(F.length(title) > 60, issue("long_title", "On-Page", "low", "Title Tag Too Long",
                                              fmt("The title tag is %d characters and may be truncated.", F.length(title)),
                                              "Shorten the title to under 60 characters.")),
            F.when(desc == "", issue("missing_description", "On-Page", "high", "Missing Meta Description",
                                     lit("The page is missing a meta description."),
                                     "Add a compelling meta description between 150-160 characters."))
            .when(F.length(desc) < 70, issue("short_description", "On-Page", "medium", "Meta Description Too Short",
                                             fmt("The meta description is only %d characters.", F.length(desc)),
                                             "Expand the description to 150-160 characters.")),
            F.when(n_h1 == 0, issue("missing_h1", "On-Page", "high", "Missing H1 Tag", lit("The page is missing an H1 heading."),
                                    "Add a single H1 tag containing your primary keyword."))
            .when(n_h1 > 1, issue("multiple_h1", "On-Page", "medium", "Multiple H1 Tags",
                                  fmt("The page has %d H1 tags instead of one.", n_h1), "Use only one H1 tag per page.")),
            F.when(words < 300, issue("thin_content", "Content", "high", "Thin Content",
                                      fmt("The page only has %d words.", words),
                                      "Add more valuable content, aim for at least 500-1000 words.")),
        )
    )
    return pages.select("site_id", "page_seq", "url", F.explode(found).alias("i")).select("site_id", "page_seq", "url", "i.*")


# Points off the score per issue, by severity.
DEDUCTIONS = {"critical": 15, "high": 10, "medium": 5, "low": 2}


def deduction_score(issues: DataFrame, keys: list[str], unknown: int = 0) -> DataFrame:
    """100 minus the deductions of all issues, not below 0.

    ``unknown`` is what an unlisted severity costs: 1, 0 or (as low) 2.
    """
    cost = F.lit(unknown)
    for s, d in DEDUCTIONS.items():
        cost = F.when(F.lower(F.coalesce("severity", F.lit("low"))) == s, F.lit(d)).otherwise(cost)
    return issues.groupBy(*keys).agg(
        F.count("*").alias("issues_count"), F.greatest(F.lit(0), F.lit(100) - F.sum(cost)).cast("int").alias("score")
    )


def compare_audits(pairs: DataFrame, runs: DataFrame, issues: DataFrame) -> DataFrame:
    """New, fixed and persistent (category, title) keys between two audits.

    ``pairs(before_id, after_id)``, ``runs(audit_id, score)``,
    ``issues(audit_id, category, title)``.  Sides are made distinct on their
    key first, so repeated issues never meet in the join.
    """
    keys = issues.select("audit_id", "category", "title").distinct()
    side = lambda col, flag: (
        pairs.join(keys, pairs[col] == keys.audit_id).select("before_id", "after_id", "category", "title", F.lit(1).alias(flag))
    )
    both = side("before_id", "b").unionByName(side("after_id", "a"), allowMissingColumns=True)
    per_key = both.groupBy("before_id", "after_id", "category", "title").agg(F.max("b").alias("b"), F.max("a").alias("a"))
    counts = per_key.groupBy("before_id", "after_id").agg(
        F.count_if(F.col("b").isNull()).alias("new_issues"), F.count_if(F.col("a").isNull()).alias("fixed_issues"),
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("persistent_issues"),
    )
    score = lambda col, name: runs.select(F.col("audit_id").alias(col), F.col("score").alias(name))
    out = pairs.join(counts, ["before_id", "after_id"], "left").join(score("before_id", "_sb"), "before_id", "left").join(
        score("after_id", "_sa"), "after_id", "left"
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "before_id", "after_id", (zero("_sa") - zero("_sb")).alias("score_change"),
        *[zero(c).alias(c) for c in ("new_issues", "fixed_issues", "persistent_issues")],
    )


ISSUE_KEYS = ["before_id", "after_id", "category", "title"]


def issue_sides(pairs: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The issues before and after of all pairs, one row per ISSUE_KEYS, to be stored in buckets and compared."""
    keys = issues.select("audit_id", "category", "title").distinct()
    return tuple(pairs.join(keys, pairs[c] == keys.audit_id).select(*ISSUE_KEYS) for c in ("before_id", "after_id"))


def compare_sides(before: DataFrame, after: DataFrame) -> DataFrame:
    """New, fixed and persistent issues per pair; sides in equal buckets of ISSUE_KEYS are joined without a shuffle."""
    b, a = before.withColumn("_b", F.lit(1)), after.withColumn("_a", F.lit(1))
    per_key = b.hint("merge").join(a, ISSUE_KEYS, "full")
    return per_key.groupBy("before_id", "after_id").agg(
        F.count_if(F.col("_b").isNull()).alias("new_issues"), F.count_if(F.col("_a").isNull()).alias("fixed_issues"),
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("persistent_issues"),
    )


def latest_audit(runs: DataFrame) -> DataFrame:
    """Newest completed audit per site, ties by id; one partial aggregate."""
    return (
        runs.filter("status = 'completed'").groupBy("site_id")
        .agg(F.max(F.struct("completed_at", "audit_id", "score")).alias("m")).select("site_id", "m.audit_id", "m.score", "m.completed_at")
    )


def issue_list(issues: DataFrame, severity: str | None = None, status: str | None = None) -> DataFrame:
    """Issues of chosen severity/status, most severe first, then by title."""
    if severity:
        issues = issues.filter(F.col("severity") == severity)
    if status:
        issues = issues.filter(F.col("status") == status)
    return issues.orderBy(severity_rank(F.col("severity")).desc_nulls_last(), "title")


def issue_stats(issues: DataFrame) -> DataFrame:
    """Counts per audit by severity and by category, long form."""
    both = issues.select("audit_id", F.explode(F.array(
        F.struct(F.lit("severity").alias("dimension"), F.col("severity").alias("value")),
        F.struct(F.lit("category").alias("dimension"), F.col("category").alias("value")),
    )).alias("d"))
    return both.groupBy("audit_id", "d.dimension", "d.value").agg(F.count("*").alias("issues"))


def failed_checks(checks: DataFrame) -> DataFrame:
    return checks.filter(~F.col("passed")).orderBy("site_id", "check_id")


def report_issue_union(checks: DataFrame, issues: DataFrame) -> DataFrame:
    """Failed checks, then stored issues; the first row of each title wins.

    Both sides need ``site_id, seq, title, category, severity``.
    """
    cols = ["site_id", "seq", "title", "category", F.coalesce("severity", F.lit("medium")).alias("severity")]
    rows = checks.select(*cols, F.lit(0).alias("src")).unionByName(issues.select(*cols, F.lit(1).alias("src")))
    first = rows.groupBy("site_id", "title").agg(F.min(F.struct("src", "seq", "category", "severity")).alias("m"))
    return first.select("site_id", "title", "m.src", "m.seq", "m.category", "m.severity")


def open_issues_by_severity(issues: DataFrame) -> DataFrame:
    return issues.filter("status = 'open'").groupBy("site_id", "severity").agg(F.count("*").alias("issues"))


def recommendation_lookup(issues: DataFrame) -> DataFrame:
    """Long guidance per issue title, with a generic text for unlisted ones.

    ``average_ttfb_ms`` (optional column) is filled into the one text that has
    a place for it.
    """
    ttfb = F.col("average_ttfb_ms").cast("string") if "average_ttfb_ms" in issues.columns else F.lit(None).cast("string")
    g = guide_table(issues.sparkSession)
    j = issues.join(g, F.col("title") == F.col("guide_title"), "left").drop("guide_title")
    return j.withColumns(
        {
            "description": F.replace(
                F.coalesce("description", F.concat(F.lit("Issue detected: "), "title")),
                F.lit("{average_ttfb_ms}"), F.coalesce(ttfb, F.lit("N/A")),
            ),
            "why_it_matters": F.coalesce("why_it_matters", F.lit("This issue may impact your site's SEO performance.")),
            "how_to_fix": F.coalesce("how_to_fix", F.lit("Review the affected pages and implement the suggested fix.")),
        }
    )


def top_recommendations(priority: DataFrame, quick: DataFrame, issues: DataFrame) -> DataFrame:
    """Up to 10 priority, 5 quick and 10 technical items per site, 20 in all.

    Inputs ``(site_id, seq, issue, severity, recommendation)``.  A technical
    item is dropped when its text is already listed, an earlier technical one
    included.  All lists are cut before anything is combined.
    """
    cut = lambda df, n, src, cat: top_k(df, ["site_id"], [F.col("seq")], n, "rn").select(
        "site_id", "issue", "severity", "recommendation", F.lit(src).alias("src"), "rn", F.lit(cat).alias("category")
    )
    quick = quick.withColumns({"severity": F.lit("low"), "recommendation": F.col("issue")})
    technical = issues.withColumn("recommendation", F.concat(F.lit("Fix: "), "issue"))
    listed = cut(priority, 10, 1, "ai_recommendation").unionByName(cut(quick, 5, 2, "quick_win"))
    third = cut(technical, 10, 3, "technical")
    rows = listed.unionByName(third)  # at most 25 rows per site from here on
    seen = Window.partitionBy("site_id", "issue").orderBy("src", "rn")
    kept = rows.withColumn("_first", F.row_number().over(seen)).filter((F.col("src") < 3) | (F.col("_first") == 1))
    order = Window.partitionBy("site_id").orderBy("src", "rn")
    ranked = kept.withColumn("priority", F.row_number().over(order)).filter("priority <= 20")
    return ranked.select("site_id", "priority", "category", "issue", "severity", "recommendation")

