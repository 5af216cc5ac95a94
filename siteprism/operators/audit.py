"""The 100 checks as one hit table, and what is computed on top of them.

Every unit produces *hits*: one row per affected page and check, with the
number of affected elements.  Counts are a partial aggregate; URL and detail
lists go through a group limit first, so nothing unbounded is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteprism.common import blank, materialize, ordered_list, severity_rank, top_k
from siteprism.functions import text as X
from siteprism.functions import urls as U
from siteprism.operators.links import in_degree, links
from siteprism.operators.rules import RULES, UNIT, rule_table

URL_CAP = 50

# Columns the checks read that a crawl may lack, with their type.
OPTIONAL = {
    "lcp_ms": "int", "inp_ms": "int", "cls": "double", "render_blocking_resources": "int",
    "third_party_scripts": "int", "has_unminified_resources": "boolean", "redirect_chain": "array<string>",
    "has_redirect_loop": "boolean", "has_rel_next": "boolean", "has_rel_prev": "boolean",
    "near_duplicate_of": "string", "keyword_density": "double", "readability_score": "double",
    "schema_errors": "array<string>", "has_mixed_content": "boolean",
    "accessibility_issues": "struct<low_contrast:boolean>", "forms_without_labels": "boolean",
    "has_skip_link": "boolean", "small_tap_targets": "boolean", "has_small_font": "boolean",
    "content_width_issues": "boolean", "has_intrusive_interstitial": "boolean", "has_flash": "boolean",
    "requires_plugin": "boolean", "touch_elements_too_close": "boolean", "is_custom_404": "boolean",
    "response_headers": "map<string,string>", "crawl_depth": "int", "load_time_ms": "int", "status_code": "int",
}

# Word lists and patterns of single checks.
BLOCKED_PATTERNS = ["/css", "/js", "/images", ".css", ".js"]
GENERIC_ANCHORS = ["click here", "read more", "learn more", "here", "more", "link"]
URL_STOPWORDS = ["the", "a", "an", "of", "to", "in", "for", "and", "or"]
CDN_HEADERS = ["x-cdn", "cf-ray", "x-amz-cf-id", "x-cache", "x-fastly"]

# How many detail entries a check keeps.
DETAIL_CAP = {7: 20, 10: 20, 26: 20, 42: 20, 12: 10, 13: 10, 14: 10, 16: 10, 24: 10, 39: 10, 41: 10}


def with_optional(pages: DataFrame) -> DataFrame:
    """Add the optional columns a crawl lacks as typed NULLs."""
    missing = {c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in pages.columns}
    if "images" in pages.columns:
        fields = pages.schema["images"].dataType.elementType.fieldNames()
        if "size_bytes" not in fields:
            missing["images"] = F.transform(
                "images",
                lambda i: F.struct(
                    *[i[f].alias(f) for f in fields],
                    F.lit(None).cast("bigint").alias("size_bytes"), F.lit(None).cast("int").alias("status_code"),
                ),
            )
    return pages.withColumns(missing) if missing else pages


def _true(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _num(name: str, default: float = 0) -> Column:
    return F.coalesce(F.col(name), F.lit(default))


def _n(name: str) -> Column:
    """Array length, 0 for NULL."""
    return F.greatest(F.coalesce(F.size(name), F.lit(0)), F.lit(0))


def _has_type(*types: str) -> Column:
    return F.coalesce(F.exists("structured_data", lambda s: s["type"].isin(*types)), F.lit(False))


def _header(name: str) -> Column:
    return F.coalesce(F.try_element_at("response_headers", F.lit(name)), F.lit(""))


def _count_where(array: str, keep) -> Column:
    return F.greatest(F.coalesce(F.size(F.filter(array, keep)), F.lit(0)), F.lit(0))


def keyword_words(title: Column, h1: Column, path: Column) -> Column:
    """True when title and first h1 have words and none of them is in the path."""
    important = F.array_except(
        F.array_union(X.words(F.lower(title)), X.words(F.lower(h1))), F.array(*[F.lit(w) for w in URL_STOPWORDS])
    )
    return (F.size(important) > 0) & ~F.arrays_overlap(important, X.words(F.lower(path)))


def page_counts() -> dict[int, Column]:
    """Check id → affected elements on one page (0 = fine), as page expressions."""
    url, ok = F.col("url"), F.coalesce(F.col("status_code") == 200, F.lit(False))
    path, low = U.path(url), F.lower("url")
    status = F.coalesce(F.nullif(F.col("status_code"), F.lit(0)), F.lit(200))
    headers = F.coalesce(F.size(F.map_keys("response_headers")), F.lit(0)) > 0
    title_len, desc_len = F.length("title"), F.length("meta_description")
    canonical = F.coalesce("canonical_url", F.lit(""))
    deep_url = F.size(U.segments(url)) > 1
    crumbs = _has_type("BreadcrumbList")
    og = lambda k: F.coalesce(F.try_element_at("open_graph", F.lit(k)), F.lit(""))
    viewport = F.coalesce("viewport_content", F.lit(""))
    flags = {
        5: _true("noindex") & ok & ~url.rlike(r"/tag/|/author/|/page/|\?|/search"),
        6: ok & (canonical == ""),
        7: (canonical != "") & (url != "") & (X.rstrip_slash(canonical) != X.rstrip_slash(url)),
        8: headers & F.lower(_header("x-robots-tag")).contains("noindex"),
        10: _num("crawl_depth") > 4,
        11: blank(F.col("title")) & ok,
        12: ~blank(F.col("title")) & (title_len < 30),
        13: ~blank(F.col("title")) & (title_len > 60),
        15: blank(F.col("meta_description")) & ok,
        16: ~blank(F.col("meta_description")) & ((desc_len < 70) | (desc_len > 160)),
        17: (_n("h1") == 0) & ok,
        18: _n("h1") > 1,
        19: ((_n("h1") == 0) & (_n("h2") + _n("h3") > 0)) | ((_n("h3") > 0) & (_n("h2") == 0)),
        20: F.coalesce(F.exists("images", lambda i: blank(i["alt"])), F.lit(False)),
        21: _num("lcp_ms") > 2500,
        22: _num("inp_ms") > 200,
        23: _num("cls") > 0.1,
        24: _num("load_time_ms") > 800,
        25: _num("render_blocking_resources") > 3,
        27: F.coalesce(F.exists("images", lambda i: blank(i["width"]) | blank(i["height"])), F.lit(False)),
        28: headers & ~F.lower(_header("content-encoding")).isin("gzip", "br", "deflate"),
        29: _true("has_unminified_resources"),
        30: _num("third_party_scripts") > 10,
        31: F.length(url) > 100,
        32: url.rlike(r"[^\x00-\x7F]"),
        33: path.contains("_"),
        34: path != F.lower(path),
        35: (canonical != "") & (canonical.endswith("/") != url.endswith("/")),
        36: F.size(U.segments(url)) > 4,
        37: url.contains("?"),
        38: low.rlike("sid=|session=|phpsessid=|jsessionid=|aspsessionid"),
        40: keyword_words(F.coalesce("title", F.lit("")), F.coalesce(F.try_element_at("h1", F.lit(1)), F.lit("")), path),
        43: _n("redirect_chain") > 1,
        45: F.coalesce(
            F.exists("internal_links", lambda x: X.strip(F.lower(x["text"])).isin(*GENERIC_ANCHORS)), F.lit(False)
        ),
        46: ok & (_n("internal_links") < 3),
        47: _n("internal_links") > 100,
        48: deep_url & ~crumbs,
        49: _num("crawl_depth") > 4,
        50: url.rlike(r"/page/|\?page=") & ~_true("has_rel_next") & ~_true("has_rel_prev"),
        51: ok & (_num("word_count") < 300),
        53: ~blank(F.col("near_duplicate_of")),
        54: ok & (_num("word_count") < 50),
        55: _num("keyword_density") > 3,
        58: (og("og:title") == "") | (og("og:image") == ""),
        59: F.coalesce(F.try_element_at("twitter_cards", F.lit("twitter:card")), F.lit("")) == "",
        60: _num("readability_score", 100) < 40,
        61: (_n("structured_data") == 0) & ok,
        62: _n("schema_errors") > 0,
        64: deep_url & ~crumbs,
        65: url.rlike("/blog/|/news/|/article/|/post/") & ~_has_type("Article", "NewsArticle", "BlogPosting"),
        66: url.rlike("/product/|/products/|/shop/|/store/") & ~_has_type("Product"),
        68: low.rlike("/faq|/frequently-asked|/questions") & ~_has_type("FAQPage"),
        69: low.rlike("/review|/testimonial|/rating") & ~_has_type("Review", "AggregateRating"),
        71: url.startswith("http://"),
        72: url.startswith("https://") & _true("has_mixed_content"),
        75: headers & (_header("strict-transport-security") == ""),
        76: blank(F.col("html_lang")),
        77: (_n("hreflang") > 0) & ~F.coalesce(F.exists("hreflang", lambda h: h["url"] == url), F.lit(False)),
        78: F.coalesce(F.col("accessibility_issues.low_contrast"), F.lit(False)),
        79: _true("forms_without_labels"),
        80: ~_true("has_skip_link"),
        81: ~_true("has_viewport_meta"),
        82: ~viewport.contains("width=device-width"),
        83: _true("small_tap_targets"),
        84: _true("has_small_font"),
        85: _true("content_width_issues"),
        86: _true("has_intrusive_interstitial"),
        88: _true("has_flash"),
        89: _true("requires_plugin"),
        90: _true("touch_elements_too_close"),
        91: status.between(400, 499),
        92: status.between(500, 599),
        93: _n("redirect_chain") > 2,
        94: _true("has_redirect_loop"),
        95: F.coalesce(F.col("status_code") == 302, F.lit(False)),
        97: headers & ((_header("cache-control") == "") | _header("cache-control").rlike("no-cache|no-store")),
        99: _num("load_time_ms") > 600,
    }
    counts = {i: F.coalesce(c, F.lit(False)).cast("int") for i, c in flags.items()}

    def incomplete(s: Column) -> Column:
        lacks = lambda *keys: F.size(F.array_intersect(s["keys"], F.array(*[F.lit(k) for k in keys]))) < len(keys)
        return ((s["type"] == "Article") & lacks("headline", "author", "datePublished")) | (
            (s["type"] == "Product") & lacks("name", "description")
        )

    counts[26] = _count_where("images", lambda i: i["size_bytes"] > 200000)
    counts[44] = _count_where("internal_links", lambda x: x["nofollow"])
    counts[57] = _count_where("images", lambda i: i["status_code"] == 404)
    counts[70] = _count_where("structured_data", incomplete)
    return counts


def _page_details() -> dict[int, Column]:
    """Check id → JSON detail entries of one affected page."""
    one = lambda *fields: F.array(F.to_json(F.struct(*fields)))
    url = F.col("url")
    chars = F.length("meta_description")
    return {
        7: one(url, F.col("canonical_url").alias("canonical")),
        10: one(url, F.col("crawl_depth").alias("depth")),
        12: one(url, F.length("title").alias("current"), F.lit("50-60 chars").alias("target")),
        13: one(url, F.length("title").alias("current"), F.lit("<60 chars").alias("target")),
        16: one(
            url,
            F.concat(chars.cast("string"), F.when(chars < 70, " chars (too short)").otherwise(" chars (too long)")).alias("current"),
            F.lit("150-160 chars").alias("target"),
        ),
        24: one(url, F.concat(F.col("load_time_ms").cast("string"), F.lit("ms")).alias("current"), F.lit("<800ms").alias("target")),
        26: F.transform(
            F.filter("images", lambda i: i["size_bytes"] > 200000),
            lambda i: F.to_json(F.struct(url.alias("url"), i["url"].alias("image"))),
        ),
    }


HIT = ["site_id", "check_id", "page_seq", "ord", "url", "n", "metric", "details"]


def page_hits(pages: DataFrame, only: list[int] | None = None) -> DataFrame | None:
    """Hits of all per-page checks from one pass over the pages."""
    counts = {i: c for i, c in page_counts().items() if only is None or i in only}
    if not counts:
        return None
    details = _page_details()
    none = F.lit(None).cast("array<string>")
    entries = [
        F.when(
            c > 0,
            F.struct(
                F.lit(i).alias("check_id"), c.cast("bigint").alias("n"),
                (F.col("load_time_ms") if i == 24 else F.lit(None)).cast("bigint").alias("metric"),
                details.get(i, none).alias("details"),
            ),
        )
        for i, c in counts.items()
    ]
    hits = F.array_compact(F.array(*entries))
    return pages.select("site_id", "page_seq", "url", F.explode(hits).alias("h")).select(
        "site_id", F.col("h.check_id").alias("check_id"), "page_seq", F.lit(0).cast("bigint").alias("ord"), "url",
        F.col("h.n").alias("n"), F.col("h.metric").alias("metric"), F.col("h.details").alias("details"),
    )


def duplicate_groups(pages: DataFrame, key: Column) -> DataFrame:
    """Pages (status 200) sharing a key with another page of their site.

    Group sizes come from a partial aggregate; the join back puts the one-row
    group side against the pages, which AQE can split when one group is huge.
    """
    keyed = pages.filter("status_code = 200").select("site_id", "page_seq", "url", key.alias("key")).filter("key <> ''")
    groups = keyed.groupBy("site_id", "key").agg(
        F.count("*").alias("group_size"), F.min("page_seq").alias("first_seq")
    ).filter("group_size > 1")
    return keyed.join(groups, ["site_id", "key"])


def _group_hits(pages: DataFrame, check_ids: list[int], key: Column) -> DataFrame:
    """Hits of the checks that share one duplicate key (52 repeats 39 without details)."""
    d = duplicate_groups(pages, key).withColumn("check_id", F.explode(F.array(*[F.lit(i) for i in check_ids])))
    detail = F.array(F.to_json(F.struct("key", F.col("group_size").alias("urls"), F.col("url").alias("first_url"))))
    shown = F.when((F.col("page_seq") == F.col("first_seq")) & (F.col("check_id") != 52), detail)
    return d.select(
        "site_id", "check_id", "page_seq", F.col("first_seq").cast("bigint").alias("ord"), "url",
        F.lit(1).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("metric"), shown.alias("details"),
    )


def inlinks(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """Status-200 pages other than the homepage with their count of linking pages.

    The page URL is compared without its trailing '/', the link target as it is.
    """
    edges = links(pages)
    home = sites.select("site_id", X.rstrip_slash(F.col("base_url")).alias("key")).distinct()
    targets = (
        pages.filter("status_code = 200")
        .select("site_id", "page_seq", "url", X.rstrip_slash(F.col("url")).alias("key"))
        .join(home, ["site_id", "key"], "left_anti")
    )
    degree = in_degree(edges).withColumnRenamed("dst", "key")
    return targets.join(degree, ["site_id", "key"], "left").withColumn(
        "in_degree", F.coalesce("in_degree", F.lit(0))
    )


def broken_links(pages: DataFrame) -> DataFrame:
    """Internal links whose target was not crawled, one row per occurrence."""
    crawled = pages.select("site_id", F.col("url").alias("dst")).distinct()
    return links(pages).filter("dst <> ''").join(crawled, ["site_id", "dst"], "left_anti")


def _link_hits(pages: DataFrame, sites: DataFrame, only: list[int] | None) -> list[DataFrame]:
    want = lambda i: only is None or i in only
    none_l, none_a = F.lit(None).cast("bigint"), F.lit(None).cast("array<string>")
    out = []
    if want(9) or want(41):
        counted = inlinks(pages, sites)
        base = ["page_seq", F.lit(0).cast("bigint").alias("ord"), "url", F.lit(1).cast("bigint").alias("n"), none_l.alias("metric")]
        check = F.when(F.col("in_degree") == 0, 9).when(F.col("in_degree") <= 2, 41)
        detail = F.when(
            F.col("in_degree") > 0, F.array(F.to_json(F.struct("url", F.col("in_degree").alias("incoming_links"))))
        )
        hits = counted.select("site_id", check.alias("check_id"), *base, detail.alias("details"))
        out.append(hits.filter(F.col("check_id").isNotNull() if only is None else F.col("check_id").isin(*only)))
    if want(42):
        # One row per source page; a page has at most 200 internal links.
        out.append(
            broken_links(pages)
            .groupBy("site_id", "page_seq", F.col("src").alias("url"))
            .agg(
                F.count("*").alias("n"),
                ordered_list(F.to_json(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"))), F.col("pos")).alias("details"),
            )
            .select(
                "site_id", F.lit(42).alias("check_id"), "page_seq", F.lit(0).cast("bigint").alias("ord"), "url", "n",
                none_l.alias("metric"), "details",
            )
        )
    return out


def _site_hits(
    pages: DataFrame, sites: DataFrame, robots: DataFrame | None, sitemaps: DataFrame | None, only: list[int] | None
) -> DataFrame:
    """Hits of the checks that look at a site as a whole."""
    want = lambda *ids: only is None or any(i in only for i in ids)
    s = sites.select("site_id", "base_url")
    false = F.lit(False)
    if robots is not None and want(1, 2):
        s = s.join(robots.select("site_id", F.col("exists").alias("r_exists"), F.lower("content").alias("r_text")), "site_id", "left")
    else:
        s = s.withColumns({"r_exists": false, "r_text": F.lit(None).cast("string")})
    if sitemaps is not None and want(3, 4):
        s = s.join(sitemaps.select("site_id", F.col("exists").alias("m_exists"), F.col("errors").alias("m_errors")), "site_id", "left")
    else:
        s = s.withColumns({"m_exists": false, "m_errors": F.lit(None).cast("array<string>")})
    if want(67, 96, 98):
        keys = F.map_keys("response_headers")
        cdn = F.arrays_overlap(keys, F.array(*[F.lit(h) for h in CDN_HEADERS]))
        org = ("LocalBusiness", "Organization")
        flags = pages.groupBy("site_id").agg(
            F.max(
                F.coalesce(F.exists("structured_data", lambda d: d["type"].isin(*org) & d["has_address"]), false)
                if want(67) else false
            ).alias("local"),
            F.max(_true("is_custom_404")).alias("custom404"),
            F.max(F.coalesce(cdn, false)).alias("cdn"),
        )
        s = s.join(flags, "site_id", "left")
    else:
        s = s.withColumns({c: F.lit(None).cast("boolean") for c in ("local", "custom404", "cdn")})
    if want(63):
        home = pages.select(
            "site_id", X.rstrip_slash(F.col("url")).alias("_home"),
            F.struct("page_seq", _has_type("Organization").alias("org")).alias("p"),
        )
        # Join first on the (nearly unique) homepage URL, then reduce.
        found = (
            s.select("site_id", X.rstrip_slash(F.col("base_url")).alias("_home"))
            .join(home, ["site_id", "_home"]).groupBy("site_id").agg(F.min("p").alias("p"))
        )
        s = s.join(found.select("site_id", F.col("p.org").alias("org")), "site_id", "left")
    else:
        s = s.withColumn("org", F.lit(None).cast("boolean"))

    base, no_url = F.col("base_url"), F.lit(None).cast("string")
    blocked = F.filter(
        F.array(*[F.lit(p) for p in BLOCKED_PATTERNS]),
        lambda p: F.col("r_text").contains(F.concat(F.lit("disallow: "), p))
        | F.col("r_text").contains(F.concat(F.lit("disallow: *"), p)),
    )
    n_blocked = F.greatest(F.coalesce(F.size(blocked), F.lit(0)), F.lit(0))
    errors = F.when(F.coalesce("m_exists", false), F.coalesce("m_errors", F.array().cast("array<string>"))).otherwise(
        F.array().cast("array<string>")
    )
    one = lambda bad: F.coalesce(bad, F.lit(True)).cast("int")
    rows = {
        1: (one(~F.coalesce("r_exists", false)), F.concat(base, F.lit("/robots.txt")), None),
        2: (n_blocked, no_url, blocked),
        3: (one(~F.coalesce("m_exists", false)), F.concat(base, F.lit("/sitemap.xml")), None),
        4: (F.size(errors), no_url, errors),
        63: (one(~F.coalesce("org", false)), base, None),
        67: (one(~F.coalesce("local", false)), base, None),
        73: (one(~base.startswith("https://")), no_url, None),
        96: (one(~F.coalesce("custom404", false)), no_url, None),
        98: (one(~F.coalesce("cdn", false)), no_url, None),
    }
    entries = [
        F.when(
            n > 0,
            F.struct(
                F.lit(i).alias("check_id"), n.cast("bigint").alias("n"), u.alias("url"),
                (F.lit(None).cast("array<string>") if d is None else d).alias("details"),
            ),
        )
        for i, (n, u, d) in rows.items()
        if want(i)
    ]
    hits = F.array_compact(F.array(*entries))
    return s.select("site_id", F.explode(hits).alias("h")).select(
        "site_id", F.col("h.check_id").alias("check_id"), F.lit(0).cast("bigint").alias("page_seq"),
        F.lit(0).cast("bigint").alias("ord"), F.col("h.url").alias("url"), F.col("h.n").alias("n"),
        F.lit(None).cast("bigint").alias("metric"), F.col("h.details").alias("details"),
    )


def audit_hits(
    pages: DataFrame, sites: DataFrame, robots: DataFrame | None = None, sitemaps: DataFrame | None = None,
    only: list[int] | None = None,
) -> DataFrame:
    """All hits of the requested checks (default: all 100)."""
    pages = with_optional(pages).withColumn("page_seq", F.col("page_seq").cast("bigint"))
    want = lambda *ids: only is None or any(i in only for i in ids)
    parts = []
    p = page_hits(pages, only)
    if p is not None:
        parts.append(p)
    if want(14):
        parts.append(_group_hits(pages, [14], X.strip(F.lower("title"))))
    if want(39, 52):
        parts.append(_group_hits(pages, [i for i in (39, 52) if want(i)], F.col("text_content_hash")))
    parts += _link_hits(pages, sites, only)
    if want(*[i for i, u in UNIT.items() if u == "S"]):
        parts.append(_site_hits(pages, sites, robots, sitemaps, only))
    if not parts:  # only constant checks: no hit can exist
        return page_hits(pages, [99]).filter(F.lit(False))
    out = parts[0].select(*HIT)
    for q in parts[1:]:
        out = out.unionByName(q.select(*HIT))
    return out


def audit_details(hits: DataFrame) -> DataFrame:
    """Every detail entry behind the checks: site_id, check_id, ord, page_seq, pos, detail (JSON); rows, so no list grows with a site."""
    return hits.filter("details IS NOT NULL").select("site_id", "check_id", "ord", "page_seq", F.posexplode("details").alias("pos", "detail"))


def audit_counts(pages: DataFrame, sites: DataFrame, robots: DataFrame | None = None, sitemaps: DataFrame | None = None) -> DataFrame:
    """All 100 checks per site with what a score needs: category, severity, passed, affected_count; no hit is made or stored.

    Checks of single pages are columns of one partial aggregate per site; checks of groups add up group sizes, those of
    links count linked and unlinked pages.
    """
    pages = with_optional(pages).withColumn("page_seq", F.col("page_seq").cast("bigint"))
    per_page = page_counts()
    sums = pages.groupBy("site_id").agg(*[F.sum(F.when(c > 0, c)).alias(f"c{i}") for i, c in per_page.items()])
    entries = F.array(*[F.struct(F.lit(i).alias("check_id"), F.col(f"c{i}").cast("bigint").alias("n")) for i in per_page])
    parts = [sums.select("site_id", F.inline(entries))]
    for ids, key in (([14], X.strip(F.lower("title"))), ([39, 52], F.col("text_content_hash"))):
        keyed = pages.filter("status_code = 200").select("site_id", key.alias("key")).filter("key <> ''")
        sizes = keyed.groupBy("site_id", "key").agg(F.count("*").alias("n")).filter("n > 1")
        parts.append(sizes.groupBy("site_id").agg(F.sum("n").alias("n")).select("site_id", F.explode(F.array(*[F.lit(i) for i in ids])).alias("check_id"), "n"))
    few = F.when(F.col("in_degree") == 0, 9).when(F.col("in_degree") <= 2, 41)
    parts.append(inlinks(pages, sites).groupBy("site_id", few.alias("check_id")).agg(F.count("*").alias("n")).filter("check_id IS NOT NULL"))
    parts.append(broken_links(pages).groupBy("site_id").agg(F.count("*").alias("n")).select("site_id", F.lit(42).alias("check_id"), "n"))
    parts.append(_site_hits(pages, sites, robots, sitemaps, None).select("site_id", "check_id", "n"))
    counts = reduce(DataFrame.unionByName, parts).groupBy("site_id", "check_id").agg(F.sum("n").alias("affected_count"))
    grid = sites.select("site_id").distinct().withColumn("check_id", F.explode(F.array(*[F.lit(r[0]) for r in RULES])))
    n = F.coalesce("affected_count", F.lit(0)).cast("bigint")
    return (
        grid.join(rule_table(sites.sparkSession, None), "check_id").join(counts, ["site_id", "check_id"], "left")
        .select("site_id", "check_id", "category", "check_name", "severity", (n == 0).alias("passed"), n.alias("affected_count"))
    )


def audit(
    pages: DataFrame, sites: DataFrame, robots: DataFrame | None = None, sitemaps: DataFrame | None = None,
    only: list[int] | None = None, with_details: bool = True, hits: DataFrame | None = None,
) -> DataFrame:
    """One row per (site, check): exactly 100 per site, or the `only` ones.

    For a full audit hand in materialised page features (see
    :func:`audit_features`).  Its hits are written once as narrow rows and read
    for the counts and for the bounded lists, each with only its own columns.
    ``hits``: those of :func:`audit_hits`, where a caller has written them.
    """
    if hits is None:
        hits = audit_hits(pages, sites, robots, sitemaps, only)
        if only is None:  # counts and lists would each repeat the link and group joins
            hits = materialize(hits)
    order = [F.col("ord"), F.col("page_seq"), F.col("url")]
    counts = hits.groupBy("site_id", "check_id").agg(
        F.sum("n").alias("affected_count"), F.sum("metric").alias("_sum"), F.count("*").alias("_pages")
    )
    listed = (
        top_k(hits.filter("url is not null").select("site_id", "check_id", "ord", "page_seq", "url"), ["site_id", "check_id"], order, URL_CAP)
        .groupBy("site_id", "check_id").agg(ordered_list(F.col("url"), F.col("_rn")).alias("affected_urls"))
    )
    ids = [r[0] for r in RULES if only is None or r[0] in only]
    grid = sites.select("site_id").distinct().withColumn("check_id", F.explode(F.array(*[F.lit(i) for i in ids])))
    out = (
        grid.join(rule_table(sites.sparkSession, only), "check_id")
        .join(counts, ["site_id", "check_id"], "left")
        .join(listed, ["site_id", "check_id"], "left")
    )
    if with_details:
        entries = hits.filter("details is not null").select(
            "site_id", "check_id", "ord", "page_seq", F.posexplode("details").alias("pos", "d")
        )
        cap = F.coalesce(F.create_map(*[F.lit(x) for kv in DETAIL_CAP.items() for x in kv])[F.col("check_id")], F.lit(20))
        kept = top_k(entries, ["site_id", "check_id"], [F.col("ord"), F.col("page_seq"), F.col("pos")], 20)
        details = kept.filter(F.col("_rn") <= cap).groupBy("site_id", "check_id").agg(
            ordered_list(F.col("d"), F.col("_rn")).alias("details")
        )
        out = out.join(details, ["site_id", "check_id"], "left")
    else:
        out = out.withColumn("details", F.lit(None).cast("array<string>"))
    average = F.floor(F.col("_sum") / F.col("_pages")).cast("bigint")
    n = F.coalesce("affected_count", F.lit(0))
    return out.select(
        "site_id", "check_id", "category", "check_name", (n == 0).alias("passed"), "severity",
        n.alias("affected_count"),
        F.coalesce("affected_urls", F.array().cast("array<string>")).alias("affected_urls"),
        F.coalesce("details", F.array().cast("array<string>")).alias("details"),
        F.when((F.col("check_id") == 24) & average.isNotNull(),
               F.concat("recommendation", F.lit(" Current average: "), average.cast("string"), F.lit("ms.")))
        .otherwise(F.col("recommendation")).alias("recommendation"),
        F.when(F.col("check_id") == 24, average).alias("average_ttfb_ms"),
    )


def audit_features(page: DataFrame) -> DataFrame:
    """Page features without the page text, written once for all audit branches."""
    return materialize(page.drop("text_content", "html"))


# ---------------------------------------------------------------- on the checks

# Weight of a check in the score, by severity.
WEIGHTS = {"critical": 4.0, "high": 2.5, "medium": 1.5, "low": 1.0}


def _weight(c: Column) -> Column:
    out = F.lit(1.0)
    for s, w in WEIGHTS.items():
        out = F.when(c == s, F.lit(w)).otherwise(out)
    return out


def score_columns() -> tuple[Column, Column, Column]:
    """Aggregates (Σ weight, Σ weight passed, Σ penalty) over check rows."""
    w = _weight(F.col("severity"))
    penalty = F.when(~F.col("passed") & (F.col("affected_count") > 5), F.least(F.lit(1.0), F.col("affected_count") / 20.0))
    return F.sum(w), F.sum(F.when(F.col("passed"), w).otherwise(0.0)), F.sum(F.coalesce(penalty, F.lit(0.0)))


def score_of(total: Column, good: Column, penalty: Column) -> Column:
    raw = F.bround(good / total * 100 - F.least(F.lit(10.0), penalty))
    return F.when(total > 0, F.greatest(F.lit(0), F.least(F.lit(100), raw.cast("int")))).otherwise(0)


def audit_score(checks: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """Weighted score 0..100 per site; 0 for a listed site without check rows."""
    t, g, p = score_columns()
    out = checks.groupBy("site_id").agg(t.alias("t"), g.alias("g"), p.alias("p"))
    if sites is not None:
        out = sites.select("site_id").distinct().join(out, "site_id", "left")
    return out.select("site_id", score_of(F.col("t"), F.col("g"), F.col("p")).alias("score"))


def audit_summary(checks: DataFrame) -> DataFrame:
    """Totals, score and failed checks per severity and per category (as maps)."""
    from siteprism.operators.rules import CATEGORIES

    failed = ~F.col("passed")
    t, g, p = score_columns()
    out = checks.groupBy("site_id").agg(
        F.count("*").alias("total_checks"), F.count_if("passed").alias("passed_checks"), F.count_if(failed).alias("failed_checks"),
        t.alias("t"), g.alias("g"), p.alias("p"),
        *[F.count_if(failed & (F.col("severity") == s)).alias(f"s_{s}") for s in WEIGHTS],
        *[F.count_if(failed & (F.col("category") == c)).alias(f"c_{i}") for i, c in enumerate(CATEGORIES)],
    )

    def counted(pairs: list[tuple[str, str]]) -> Column:
        full = F.create_map(*[x for label, c in pairs for x in (F.lit(label), F.col(c))])
        return F.map_filter(full, lambda _, v: v > 0)

    return out.select(
        "site_id", "total_checks", "passed_checks", "failed_checks",
        score_of(F.col("t"), F.col("g"), F.col("p")).alias("score"),
        counted([(s, f"s_{s}") for s in WEIGHTS]).alias("issues_by_severity"),
        counted([(c, f"c_{i}") for i, c in enumerate(CATEGORIES)]).alias("issues_by_category"),
    )


def category_scores(checks: DataFrame) -> DataFrame:
    """Per category: share passed, truncated, and its band."""
    return with_category_score(
        checks.groupBy("site_id", "category").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed_checks"))
    )


def with_category_score(categories: DataFrame) -> DataFrame:
    """Add score and band to rows with ``total`` and ``passed_checks``."""
    return categories.withColumn("score", F.floor(F.col("passed_checks") / F.col("total") * 100).cast("int")).withColumn(
        "status",
        F.when(F.col("score") < 70, "needs attention").when(F.col("score") < 90, "good").otherwise("excellent"),
    )


def grade(score: Column) -> Column:
    out = F.lit("F")
    # Lowest score of each grade.
    for floor, g in [(60, "D"), (70, "C"), (75, "C+"), (80, "B"), (85, "B+"), (90, "A"), (95, "A+")]:
        out = F.when(score >= floor, F.lit(g)).otherwise(out)
    return out


def score_label(score: Column) -> Column:
    return F.when(score >= 80, "good").when(score >= 60, "fair").otherwise("poor")


def score_band(score: Column) -> Column:
    """Bands of the written report."""
    return (
        F.when(score >= 80, "good").when(score >= 60, "fair").when(score >= 40, "needs work").otherwise("poor")
    )


def to_issues(checks: DataFrame) -> DataFrame:
    """Failed checks as issues: typed by check id, first 10 URLs."""
    return checks.filter(~F.col("passed")).select(
        "site_id", F.concat(F.lit("check_"), F.col("check_id").cast("string")).alias("type"), "category",
        F.col("check_name").alias("title"), "severity", "affected_count",
        F.slice("affected_urls", 1, 10).alias("affected_urls"), F.col("recommendation").alias("fix"), "details", "check_id",
    )


def severity_counts(issues: DataFrame) -> DataFrame:
    s = F.col("severity")
    return issues.groupBy("site_id").agg(*[F.count_if(s == x).alias(x) for x in WEIGHTS])


def prioritized_issues(issues: DataFrame) -> DataFrame:
    """Rank by severity, then affected pages; ≤ 100 issues per site by construction."""
    w = Window.partitionBy("site_id").orderBy(
        F.coalesce(severity_rank(F.col("severity")), F.lit(0)).desc(), F.col("affected_count").desc(), F.col("check_id")
    )
    return issues.withColumn("priority", F.row_number().over(w))


# Phrases in a title that mark a quick fix.
QUICK_WIN_PHRASES = [
    "missing", "empty", "duplicate", "too short", "too long",
    "alt text", "meta description", "title tag", "canonical",
]


def quick_wins(issues: DataFrame, phrases: list[str] = QUICK_WIN_PHRASES, limit: int = 10) -> DataFrame:
    """Severe issues whose title names an easy fix, first ten per site in issue order."""
    easy = F.col("severity").isin("critical", "high") & F.lower("title").rlike("|".join(phrases))
    return top_k(issues.filter(easy), ["site_id"], [F.col("check_id")], limit, "pick")


def traffic_impact(critical: Column, high: Column, medium: Column, score: Column) -> Column:
    """Expected effect of fixing everything, from severity counts and score."""
    t = critical * 5 + high * 2 + medium * 0.5
    return F.struct(
        F.least(F.lit(95), score + t.cast("int")).alias("potential_score"),
        F.concat(F.least(F.lit(50), (t * 2).cast("int")).cast("string"), F.lit("%")).alias("potential_traffic_increase"),
        F.when(critical > 0, "medium").otherwise("low").alias("confidence"),
    )
