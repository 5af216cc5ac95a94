"""Link graph and crawl set."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteprism.common import first_n, materialize
from siteprism.functions import urls as U


def links(pages: DataFrame) -> DataFrame:
    """Edge list: one row per internal link, with its place on the page."""
    return pages.select(
        "site_id", "page_seq", F.col("url").alias("src"), F.posexplode("internal_links").alias("pos", "l")
    ).select(
        "site_id", "page_seq", "src", "pos",
        F.col("l.url").alias("dst"), F.col("l.text").alias("text"), F.col("l.nofollow").alias("nofollow"),
    )


def in_degree(edges: DataFrame) -> DataFrame:
    """Distinct linking pages per target.

    Duplicates go first, on (site, src, dst), so that a page everyone links to
    is reduced to partial counts before its own shuffle.
    """
    return (
        edges.select("site_id", "src", "dst").distinct()
        .groupBy("site_id", "dst").agg(F.count("*").alias("in_degree"))
    )


def out_degree(edges: DataFrame) -> DataFrame:
    """Distinct targets per page."""
    return (
        edges.select("site_id", "src", "dst").distinct()
        .groupBy("site_id", "src").agg(F.count("*").alias("out_degree"))
    )


def crawl_depth(
    edges: DataFrame, roots: DataFrame, seeds: DataFrame, max_depth: int | None = None, max_pages: int | None = None
) -> DataFrame:
    """Breadth-first depth: roots 0, seeds 1, a link target one more than its source.

    ``edges(site_id, src, dst)``, ``roots(site_id, url)``, ``seeds(site_id, url)``
    → ``(site_id, url, depth)``, all reachable pages.  Each round is a distributed
    join of the new level with the edges and ends the search when it finds
    nothing new.  Every level is written to the shared stage folder, so lineage
    stays one round long and a lost executor costs one round.  On request only
    ``max_depth`` levels are searched, and the ``max_pages`` shallowest pages of a
    site kept (within a level by URL hash).
    """
    edges = materialize(edges.select("site_id", "src", "dst").distinct())
    start = roots.select("site_id", "url", F.lit(0).alias("depth")).unionByName(
        seeds.select("site_id", "url", F.lit(1).alias("depth"))
    )
    first = materialize(start.groupBy("site_id", "url").agg(F.min("depth").alias("depth")))
    late = first.filter("depth = 1")
    visited = frontier = first.filter("depth = 0")
    for depth in itertools.count(1) if max_depth is None else range(1, max_depth + 1):
        step = (
            frontier.join(edges, (frontier.site_id == edges.site_id) & (frontier.url == edges.src))
            .select(edges.site_id, edges.dst.alias("url"))
        )
        if depth == 1:
            step = step.unionByName(late.select("site_id", "url"))
        frontier = materialize(
            step.distinct().join(visited, ["site_id", "url"], "left_anti").withColumn("depth", F.lit(depth))
        )
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    if max_pages is None:
        return visited
    bucket = F.pmod(F.xxhash64("url"), F.lit(4096))
    return first_n(visited, ["site_id"], {"depth": F.col("depth"), "_b": bucket}, [F.col("url")], max_pages)


def frontier(pages: DataFrame) -> DataFrame:
    """Internal link targets that were not crawled."""
    targets = links(pages).select("site_id", F.col("dst").alias("url")).distinct()
    return targets.join(pages.select("site_id", "url"), ["site_id", "url"], "left_anti")


def internal_urls(urls: DataFrame, sites: DataFrame) -> DataFrame:
    """URLs with the flag whether they belong to their site's domain."""
    s = sites.select("site_id", U.host(F.col("base_url")).alias("_h"))
    return urls.join(s, "site_id").withColumn(
        "is_internal", U.is_internal(U.host(F.col("url")), F.col("_h"))
    ).drop("_h")


def robots_allowed(urls: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """Apply each site's robots.txt (standard-library rules) to its URLs.

    ``urls(site_id, url)``, ``robots(site_id, content)``.  A site without
    robots content allows everything.  The text is joined once per site and
    parsed once per run of equal sites in a batch.
    """
    joined = urls.join(
        robots.select("site_id", F.col("content").alias("_robots")), "site_id", "left"
    )

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from urllib.robotparser import RobotFileParser

        parsers: dict[str, RobotFileParser] = {}

        def parser(text: str) -> RobotFileParser:
            if text not in parsers:
                if len(parsers) > 256:
                    parsers.clear()
                p = RobotFileParser()
                p.parse(text.splitlines())
                parsers[text] = p
            return parsers[text]

        for b in batches:
            ok = [
                True if not isinstance(t, str) else parser(t).can_fetch(agent, u)
                for t, u in zip(b["_robots"], b["url"])
            ]
            yield b.drop(columns="_robots").assign(allowed=ok)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema)
    return joined.select(*urls.columns, "_robots").mapInPandas(check, f"{fields}, allowed boolean")


def seed_filter(sitemap_urls: DataFrame, sites: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Sitemap URLs on the site's own hosts; on request the first max_pages in sitemap order.

    ``sitemap_urls(site_id, seq, url)``.
    """
    inside = internal_urls(sitemap_urls, sites).filter("is_internal").drop("is_internal")
    if max_pages is None:
        return inside
    bucket = {"_b": F.floor(F.col("seq") / 1000)}
    return first_n(inside, ["site_id"], bucket, [F.col("seq"), F.col("url")], max_pages)


def crawl_stats(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Pages, errors and JS-rendered pages per crawl."""
    errors: Column = F.coalesce(F.size("errors"), F.lit(0))
    return pages.groupBy(*keys).agg(
        F.count("*").alias("pages_crawled"),
        F.sum(F.greatest(errors, F.lit(0))).cast("bigint").alias("errors_count"),
        F.count_if(F.coalesce(F.col("js_rendered"), F.lit(False))).alias("js_rendered_count"),
    )
