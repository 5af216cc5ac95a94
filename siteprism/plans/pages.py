"""Site pages derived from the ``pages`` table, in Spark and in SQL.

The raw pages have a title, one h1, six navigation links and text.  To reach
every feature and check, markup and crawl facts are added to each page from
its ``page_id``; the page's own HTML stays in place.  The SQL twin below
follows the same description.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteprism.common import spread
from siteprism.functions import html as H
from siteprism.functions import text as X
from siteprism.functions import urls as U


def _s(x: str) -> Column:
    return F.lit(x)


def raw_pages(spark: SparkSession, sf: str) -> DataFrame:
    """pages with site_id (= host) and page_seq (= page_id)."""
    p = spread(spark.read.parquet(f"{sf}/pages.parquet"), 4)
    return p.withColumns({"site_id": U.host(F.col("url")), "page_seq": F.col("page_id")})


def hubs(spark: SparkSession, sf: str) -> DataFrame:
    """First and last URL of each host."""
    p = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", U.host(F.col("url")).alias("site_id"))
    return p.groupBy("site_id").agg(
        F.min_by("url", "page_id").alias("hub_url"), F.min("page_id").alias("hub_id"),
        F.max_by("url", "page_id").alias("tail_url"),
    )


def _mod(k: int) -> Column:
    return F.col("page_id") % k


def rich_html() -> Column:
    """The page's HTML with added head and body markup."""
    t = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    url = F.col("url")
    none = _s("")

    def cases(k: int, *branches: Column) -> Column:
        out = none
        for i, b in enumerate(branches):
            out = F.when(_mod(k) == i, b).otherwise(out)
        return out

    head = F.concat(
        cases(
            4, none,
            F.concat(_s('<meta name="description" content="'), F.left(t, _s(40)), _s('">')),
            F.concat(_s('<meta name="description" content="'), t, _s(" "), t, _s(" "), t, _s('">')),
            F.concat(_s("<meta content='"), t, _s(" / &#x2014; &eacute; &#1114112; &#55296; &#0; &#38;lt; &nosuch; &notin; &NotEqualTilde; &copy2024 "), t, _s("' name='description'/>")),
        ),
        cases(9, _s('<meta name="robots" content="NoIndex, nofollow">')),
        cases(
            10, _s('<meta name="viewport" content="width=600">'), none,
            *[_s('<meta name="viewport" content="width=device-width, initial-scale=1">')] * 6,
        ),
        cases(
            6, none, *[F.concat(_s('<link rel="canonical" href="'), url, _s('">'))] * 3,
            F.concat(_s('<link rel="canonical" href="'), url, _s('/">')),
            F.concat(_s('<link href="https://'), F.col("site_id"), _s('/canon" rel="canonical">')),
        ),
        cases(
            3, F.concat(_s('<meta property="og:title" content="'), t, _s('"><meta property="og:image" content="/o.png">')),
            F.concat(_s('<meta property="og:title" content="'), t, _s('">')),
        ),
        cases(2, _s('<meta name="twitter:card" content="summary"><meta name="twitter:site" content="@x">')),
        cases(
            8, F.concat(_s('<link rel="alternate" hreflang="en" href="'), url, _s('"><link rel="alternate" hreflang="de" href="/de">')),
            _s('<link rel="alternate" hreflang="fr" href="/fr">'),
        ),
        F.repeat(_s('<link rel="stylesheet" href="/s.css">'), _mod(4).cast("int")),
        F.repeat(_s('<script src="https://cdn.third.test/react.js"></script>'), _mod(13).cast("int")),
        cases(
            5, _s('<script type="application/ld+json">{"@type":"Organization","name":"N","address":"A 1"}</script>'),
            _s('<script type="application/ld+json">{"@type":"Article","headline":"H","datePublished":"2024-01-01"}</script>'),
            _s('<script type="application/ld+json">[{"@type":"BreadcrumbList"},{"@type":"Product","name":"P","description":"D"}]</script>'),
            _s('<script type="application/ld+json">{bad json</script>'),
        ),
        cases(7, _s('<link rel="next" href="?p=2">'), _s('<link rel="prev" href="?p=1">')),
    )
    body = F.concat(
        cases(3, _s('<a href="sub/page">sub</a>'), _s('<a href="?p=2"><b>next</b> page</a>'), _s('<a href="//ext.test/x">ext</a>')),
        _s('<a href="#top">top</a><a href="mailto:a@b.c">mail</a><a href="tel:1">call</a>'),
        cases(5, _s('<a href="#main">Skip to content</a>')),
        cases(
            4, _s('<img src="/i/a.png" alt="Logo" width="10" height="20">'),
            _s('<img data-src="b.png" alt="" width="10"><img src="/c.png" alt="C" width="1" height="1">'),
            _s('<img src="http://img.test/d.png" alt="D" width="5" height="5">'),
        ),
        cases(3, F.concat(_s("<h2>Part "), t, _s("</h2><h3>x</h3>")), _s("<h3>alone <i>three</i></h3>")),
        cases(11, _s("<h1>Second &amp; last &copy2024 &notin; &notit; &NotEqualTilde;</h1>")),
        cases(6, _s('<form><label>Q</label><input type="text"><input type="hidden"></form>'), _s('<form><input type="text"></form>')),
        cases(16, _s('<object data="m.swf"></object>'), _s('<embed src="/p.bin">')),
        cases(12, _s('<div id="root"></div>'), _s('<div id="app">ok</div>'), _s('<div id="__next" class="is-loading"></div>')),
    )
    out = F.replace("html", _s("</head>"), F.concat(head, _s("</head>")))
    return F.replace(out, _s("</nav>"), F.concat(_s("</nav>"), body))


def rich_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with rich HTML plus the crawl facts derived from page_id."""
    p = raw_pages(spark, sf)
    status = (
        F.when(_mod(17) == 0, 404).when(_mod(23) == 0, 301).when(_mod(29) == 0, 500)
        .when(_mod(31) == 0, 0).when(_mod(37) == 0, 302).otherwise(200)
    )
    def entry(k: str, v: Column) -> Column:
        return F.struct(F.lit(k).alias("key"), v.alias("value"))

    pairs = F.array(
        entry("content-encoding", F.when(_mod(4) == 0, "").otherwise("GZIP")),
        entry("x-robots-tag", F.when(_mod(19) == 0, "noindex").otherwise("all")),
        entry("strict-transport-security", F.when(_mod(2) == 0, "max-age=1").otherwise("")),
        entry("cache-control", F.when(_mod(5) == 0, "no-store").otherwise("max-age=60")),
        entry("cf-ray", F.when(_mod(11) == 0, "r")),
    )
    headers = F.when(_mod(3) != 0, F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull())))
    yes = lambda k: _mod(k) == 0
    return p.withColumn("html", rich_html()).withColumns(
        {
            "status_code": status,
            "load_time_ms": (F.col("page_id") * 37 % 1500).cast("int"),
            "crawl_depth": _mod(7).cast("int"),
            "response_headers": headers,
            "lcp_ms": (F.col("page_id") * 53 % 5000).cast("int"),
            "inp_ms": (F.col("page_id") * 13 % 400).cast("int"),
            "cls": (F.col("page_id") * 7 % 30) / 100.0,
            "redirect_chain": F.array_repeat(F.col("url"), _mod(5).cast("int")),
            "has_redirect_loop": yes(41),
            "has_unminified_resources": yes(6),
            "near_duplicate_of": F.when(yes(14), F.concat(_s("https://"), F.col("site_id"), _s("/original"))),
            "accessibility_issues": F.struct(yes(10).alias("low_contrast")),
            "small_tap_targets": yes(12),
            "has_small_font": yes(13),
            "content_width_issues": yes(15),
            "has_intrusive_interstitial": yes(18),
            "touch_elements_too_close": yes(21),
            "is_custom_404": yes(34),
        }
    )


def features(spark: SparkSession, sf: str, columns: list[str] | None = None) -> DataFrame:
    """rich_pages after extraction; links to the host's first and last page are
    added, images get a size and a status."""
    derived = {"keyword_density": ["title", "text_content"]}
    wanted = None if columns is None else list({x for c in columns for x in derived.get(c, [c])})
    f = H.extract_page(rich_pages(spark, sf), wanted)
    if "images" in f.columns:
        sized = F.transform(
            "images",
            lambda i: F.struct(
                i["url"].alias("url"), i["alt"].alias("alt"), i["width"].alias("width"), i["height"].alias("height"),
                (F.col("page_id") * 7919 % 400000).cast("bigint").alias("size_bytes"),
                F.when(_mod(20) == 1, 404).otherwise(200).alias("status_code"),
            ),
        )
        f = f.withColumn("images", sized)
    if columns is None or "keyword_density" in columns:
        first_word = F.coalesce(F.try_element_at(X.words("title"), F.lit(1)), F.lit(""))
        f = f.withColumn("keyword_density", X.keyword_density(F.col("text_content"), first_word))
    if "internal_links" in f.columns:
        link = lambda c, t, n: F.struct(F.col(c).alias("url"), F.lit(t).alias("text"), F.lit(n).alias("nofollow"))
        extra = F.array(link("hub_url", "Home", False), link("tail_url", "Read More", True))
        f = f.join(hubs(spark, sf).select("site_id", "hub_url", "tail_url"), "site_id")
        f = f.withColumn("internal_links", F.concat("internal_links", extra)).drop("hub_url", "tail_url")
    return f


def sites(spark: SparkSession, sf: str) -> DataFrame:
    """One row per host with its base URL (a crawled page for every other site)."""
    h = F.col("hub_id")
    scheme = F.when(h % 3 == 0, "http://").otherwise("https://")
    return hubs(spark, sf).select(
        "site_id", "hub_id", F.when(h % 2 == 0, F.col("hub_url")).otherwise(F.concat(scheme, "site_id")).alias("base_url")
    )


def robots(spark: SparkSession, sf: str) -> DataFrame:
    h = F.col("hub_id")
    content = F.concat(
        _s("User-agent: *\nDisallow: /en/\n"),
        F.when(h % 3 == 0, "Disallow: /CSS\nDisallow: *.js\n").otherwise(""),
        _s("Crawl-delay: 3\nUser-agent: SitePrism\nCrawl-delay: "), F.when(h % 5 == 0, "soon").otherwise((h % 7).cast("string")),
        _s("\nDisallow: /de/\n\nSitemap: https://"), F.col("site_id"), _s("/sitemap.xml\n"),
    )
    return sites(spark, sf).select(
        "site_id", (h % 4 != 0).alias("exists"), F.when(h % 4 != 0, content).alias("content")
    )


def sitemaps(spark: SparkSession, sf: str) -> DataFrame:
    h = F.col("hub_id")
    errors = F.when(h % 5 == 0, F.array(_s("no root"), _s("bad date"))).otherwise(F.array().cast("array<string>"))
    return sites(spark, sf).select("site_id", (h % 3 != 0).alias("exists"), errors.alias("errors"))
