"""Readers for crawl inputs and API payloads, writers for audits and exports."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteprism.common import materialize, top_k
from siteprism.functions import text as X
from siteprism.operators.keywords import API_INTENTS, classify_intent

# ------------------------------------------------------------------ IO-1 pages


def read_pages(spark: SparkSession, path: str, tenant_id: str | None = None, crawl_id: str | None = None) -> DataFrame:
    """Stored page rows; the predicates prune partitions when laid out by them."""
    df = spark.read.parquet(path)
    for column, value in (("tenant_id", tenant_id), ("crawl_job_id", crawl_id)):
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def storage_key(url: Column) -> Column:
    """The name that a page's HTML is stored under."""
    return F.left(F.md5(url), F.lit(12))


def write_html(pages: DataFrame, path: str) -> None:
    """Store ``url, html`` as an object per page, under its key; pages of one key are one object, the first by HTML."""
    objects = pages.groupBy(storage_key(F.col("url")).alias("storage_key")).agg(F.min("html").alias("value"))
    objects.filter("value IS NOT NULL").write.partitionBy("storage_key").text(path)


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """Stored HTML objects, one row per file: ``<key>.html`` files, or what :func:`write_html` has written."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{html,txt}").option("recursiveFileLookup", "true").load(path)
    written = F.regexp_extract("path", r"storage_key=([^/]+)/[^/]+\.txt$", 1)
    html = F.decode("content", "UTF-8")
    return files.select(
        F.when(written != "", written).otherwise(F.regexp_extract("path", r"([^/]+)\.html$", 1)).alias("storage_key"),
        F.when(written != "", F.regexp_replace(html, r"\n\z", "")).otherwise(html).alias("html"),
    ).filter("storage_key <> ''")


# ------------------------------------------------------------- IO-2, IO-3 texts


def robots_facts(robots: DataFrame) -> DataFrame:
    """Sitemap addresses and crawl delay of each robots.txt.

    The lines of one file are folded in order inside the row.  The last delay
    of a named agent wins, 0 or none falls back to the last ``*`` delay.
    """
    raw = F.split(F.coalesce("content", F.lit("")), r"\r?\n")
    lines = F.transform(raw, lambda x: F.lower(X.strip(x)))
    start = F.struct(
        F.lit(None).cast("string").alias("agent"), F.lit(None).cast("double").alias("named"), F.lit(None).cast("double").alias("star")
    )
    value = lambda x: X.strip(F.regexp_extract(x, r"^[^:]*:(.*)$", 1))

    def step(acc: Column, x: Column) -> Column:
        delay = F.when(x.startswith("crawl-delay:") & (F.coalesce(acc["agent"], F.lit("")) != ""), value(x).try_cast("double"))
        agent = F.when(x.startswith("user-agent:"), value(x)).otherwise(acc["agent"])
        star = acc["agent"] == "*"
        return F.struct(
            agent.alias("agent"), F.coalesce(F.when(~star, delay), acc["named"]).alias("named"),
            F.coalesce(F.when(star, delay), acc["star"]).alias("star"),
        )

    last = F.aggregate(lines, start, step)
    maps = F.transform(F.filter(raw, lambda x: F.lower(x).startswith("sitemap:")), value)
    return robots.select(
        "site_id", maps.alias("sitemap_urls"), F.coalesce(F.nullif(last["named"], F.lit(0.0)), last["star"]).alias("crawl_delay")
    )


def sitemap_urls(documents: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Page URLs of sitemap trees, with all nested documents or on request those up to max_depth.

    ``documents(url, xml)``, ``roots(site_id, url)`` → ``(site_id, url, depth)``.
    Each round joins the level's documents by URL, is written to the shared
    stage folder and ends the search when it finds no new document.  A site's
    document counts once, at its least depth, so cycles end too.
    """
    locs = documents.select(
        "url", F.explode(F.transform(F.regexp_extract_all("xml", F.lit(r"(?s)<loc>(.*?)</loc>"), 1), X.strip)).alias("loc")
    ).filter("loc <> ''")
    locs = materialize(locs.withColumn("nested", F.col("loc").endswith(".xml") | F.lower("loc").contains("sitemap")))
    level, out = materialize(roots.select("site_id", "url").distinct()), None
    visited = level
    for depth in itertools.count() if max_depth is None else range(max_depth + 1):
        found = materialize(level.join(locs, "url").select("site_id", "loc", "nested"))
        pages = found.filter(~F.col("nested")).select("site_id", F.col("loc").alias("url"), F.lit(depth).alias("depth"))
        out = pages if out is None else out.unionByName(pages)
        new = found.filter("nested").select("site_id", F.col("loc").alias("url")).distinct()
        level = materialize(new.join(visited, ["site_id", "url"], "left_anti"))
        if level.isEmpty():
            break
        visited = visited.unionByName(level)
    return out


# ------------------------------------------------------------ IO-4, IO-5 payloads

# Field names of the payload.
SERP_SCHEMA = (
    "struct<tasks:array<struct<result:array<struct<items:array<struct<type:string,rank_group:int,domain:string,url:string,"
    "title:string,description:string,links:array<string>,rating:string>>>>>>>"
)


def serp_items(raw: DataFrame) -> DataFrame:
    """``raw(keyword, json)`` → one row per result item, in order."""
    items = F.flatten(F.flatten(F.transform(
        F.from_json("json", SERP_SCHEMA)["tasks"],
        lambda t: F.transform(F.coalesce(t["result"], F.array()), lambda r: F.coalesce(r["items"], F.array())),
    )))
    text = lambda c: F.coalesce(F.col(f"i.{c}"), F.lit("")).alias(c)
    return raw.select("keyword", F.posexplode(items).alias("item_seq", "i")).select(
        "keyword", "item_seq", text("type"), F.col("i.rank_group").alias("rank_group"), text("domain"), text("url"), text("title"),
        text("description"), (F.coalesce(F.size("i.links"), F.lit(0)) > 0).alias("has_links"),
        (~F.coalesce(F.col("i.rating"), F.lit("")).isin("", "null", "0", "{}", "false")).alias("has_rating"),
    )


# Field names of the payload.
KEYWORD_SCHEMA = (
    "struct<keyword:string,keyword_info:struct<keyword:string,search_volume:int,cpc:double,competition:double,"
    "monthly_searches:array<string>,search_intent_info:map<string,string>>,keyword_properties:struct<keyword_difficulty:int>,"
    "search_volume:int,cpc:double,competition:double,monthly_searches:array<string>,search_intent_info:map<string,string>>"
)


def keyword_rows(raw: DataFrame) -> DataFrame:
    """``raw(…, json)`` → keyword rows; metrics sit in keyword_info or at the top."""
    r = raw.withColumn("_k", F.from_json("json", KEYWORD_SCHEMA)).withColumn("_i", F.col("_k.keyword_info"))
    pick = lambda c: F.when(F.col("_i").isNotNull(), F.col(f"_i.{c}")).otherwise(F.col(f"_k.{c}"))
    text = F.coalesce(F.nullif(F.col("_k.keyword"), F.lit("")), F.col("_i.keyword"), F.lit(""))
    flags = pick("search_intent_info")
    on = F.filter(
        F.array(*[F.lit(i) for i in API_INTENTS]),
        lambda i: ~F.coalesce(F.try_element_at(flags, i), F.lit("false")).isin("", "false", "0", "null"),
    )
    return r.select(
        *[c for c in raw.columns if c != "json"], text.alias("text"), pick("search_volume").alias("search_volume"),
        pick("cpc").cast("decimal(10,2)").alias("cpc"), pick("competition").cast("decimal(5,4)").alias("competition"),
        F.col("_k.keyword_properties.keyword_difficulty").alias("difficulty"),
        classify_intent(text, F.coalesce(on, F.array().cast("array<string>"))).alias("intent"), pick("monthly_searches").alias("trend"),
    )


# -------------------------------------------------------------- IO-7 … IO-10 sinks


def write_audit(
    path: str, runs: DataFrame, checks: DataFrame, issues: DataFrame, by: tuple[str, ...] = ("tenant_id",), hits: DataFrame | None = None
) -> None:
    """Audit run, check and issue tables laid out by tenant, and with ``hits`` the uncut table of all hits.

    Rows are clustered by site within files; partitioning by site as well
    would create one folder per site, so add it only for few sites.  Stored
    check rows keep 20 URLs as a preview; every URL and detail is in
    ``seo_audit_hits``.
    """
    stored = checks.withColumn("affected_urls", F.slice("affected_urls", 1, 20)).withColumn("passed", F.col("passed").cast("int"))
    tables = [("audit_runs", runs), ("seo_audit_checks", stored), ("seo_issues", issues)]
    for name, df in tables + ([] if hits is None else [("seo_audit_hits", hits)]):
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/{name}")


def write_bucketed(df: DataFrame, name: str, path: str, keys: list[str], buckets: int = 32) -> DataFrame:
    """A table of the session's catalog, dealt to buckets by `keys` and sorted in them; tables with the same keys and buckets join in place."""
    df.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def issue_export(issues: DataFrame) -> DataFrame:
    """The six export columns of audit issues, NULL as ''."""
    return issues.select(
        F.col("category").alias("Category"), F.coalesce("severity", F.lit("low")).alias("Severity"), F.col("title").alias("Title"),
        F.col("description").alias("Description"), F.col("url").alias("Affected URL"), F.col("fix").alias("Recommendation"),
    ).na.fill("")


def keyword_export(keywords: DataFrame, include_rankings: bool = False) -> DataFrame:
    """Keyword export columns as text, NULL as ''."""
    cols = {"Keyword": "text", "Search Volume": "search_volume", "CPC": "cpc", "Competition": "competition", "Difficulty": "difficulty", "Intent": "intent"}
    if include_rankings:
        cols |= {"Current Position": "current_position", "Is Tracked": "is_tracked"}
    return keywords.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in cols.items()])


def site_export(runs: DataFrame, keywords: DataFrame, briefs: DataFrame, audits: int = 10) -> DataFrame:
    """Full export as (site_id, section, record) JSON lines: newest audits, all
    keywords, all briefs.  A site of any size stays spread over many rows."""
    last = top_k(runs, ["site_id"], [F.col("completed_at").desc(), F.col("audit_id").desc()], audits)
    rec = lambda df, section, *cols: df.select("site_id", F.lit(section).alias("section"), F.to_json(F.struct(*cols)).alias("record"))
    return (
        rec(last, "audits", "audit_id", "score", "status")
        .unionByName(rec(keywords, "keywords", F.col("text").alias("keyword"), "search_volume", F.col("current_position").alias("position"), "is_tracked"))
        .unionByName(rec(briefs, "content_briefs", "brief_id", "target_keyword", "status"))
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*by).json(path)
