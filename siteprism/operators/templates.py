"""Page templates: URL/content signatures, groups, names, recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteprism.common import blank, intdiv, let, materialize, ordered_list, top_k
from siteprism.functions import text as X
from siteprism.functions import urls as U

# Path segments of each page type, tested in this order.
BLOG = ["blog", "news", "article", "articles", "posts", "noticias"]
PRODUCT = ["product", "products", "item", "shop", "store", "producto", "productos"]
CATEGORY = ["category", "categories", "cat", "collection", "categoria"]
INFO = ["contact", "contacto", "about", "sobre", "about-us", "sobre-nosotros"]
FAQ = ["faq", "faqs", "help", "ayuda", "preguntas"]
LEGAL = ["privacy", "terms", "legal", "policy", "privacidad", "cookies"]

# Display name and description of a signature, in match order.
TEMPLATE_INFO = [
    ("homepage", "Homepage", "Main landing page of the website"),
    ("blog_post", "Blog Article", "Individual blog posts or news articles"),
    ("blog_index", "Blog Index", "Blog listing page showing multiple posts"),
    ("product_page", "Product Page", "Individual product detail pages"),
    ("product_listing", "Product Listing", "Category or collection pages showing multiple products"),
    ("category_page", "Category Page", "Pages organizing content into categories"),
    ("info_page", "Information Page", "About, contact, and general information pages"),
    ("faq_page", "FAQ Page", "Frequently asked questions pages"),
    ("legal_page", "Legal Page", "Privacy policy, terms, and legal content"),
    ("_other_", "Miscellaneous", "Pages that don't match common patterns"),
    ("content_page", "Content Page", "Standard content pages"),
    ("file_html", "Static Page", "Static HTML pages"),
    ("gallery", "Gallery Page", "Image-heavy gallery or portfolio pages"),
    ("minimal", "Utility Page", "Pages with minimal content (redirects, confirmations)"),
    ("long_form", "Long-Form Content", "Detailed guides or comprehensive articles"),
]
LANG_SUFFIXES = ["_en", "_es", "_de", "_fr", "_it", "_pt"]
CONTENT_SUFFIXES = ["_long_form", "_gallery", "_minimal"]

# Words that are no theme.
THEME_STOPWORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "must", "shall", "can", "need", "de", "la", "el", "los", "las", "un", "una", "en", "y",
    "que", "del", "por", "con", "para", "es", "son", "o7", "hotels", "hotel", "-", "|",
]


def _any_of(parts: Column, names: list[str]) -> Column:
    return F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names]))


def content_type(words: Column, h2_count: Column, images: Column) -> Column:
    return (
        F.when((words > 1000) & (h2_count >= 3), "long_form")
        .when((images > 5) & (words < 300), "gallery")
        .when(words < 100, "minimal")
    )


def url_pattern(parts: Column) -> Column:
    """Generalised name of a path from its segments (language removed)."""
    last, first, n = F.element_at(parts, -1), F.element_at(parts, 1), F.size(parts)
    ext = F.lower(F.substring_index(last, ".", -1))
    name = F.regexp_extract(last, r"^(.*)\.[^.]*$", 1)
    slug_like = (ext == "html") & (name.contains("-") | (F.length(name) > 10))
    return (
        F.when(n == 0, "root")
        .when(last.contains(".") & slug_like, F.when(n > 1, F.concat(F.lit("content_"), first)).otherwise("content_page"))
        .when(last.contains("."), F.concat(F.lit("file_"), ext))
        .when(n == 1, F.concat(F.lit("section_"), F.left(first, F.lit(20))))
        .when(n == 2, F.concat(F.lit("subsection_"), F.left(first, F.lit(15))))
        .otherwise(F.concat(F.lit("deep_content_d"), n.cast("string")))
    )


def with_signature(pages: DataFrame) -> DataFrame:
    """Add ``signature``: page type from the path, else pattern + language + content.

    Reads ``url, word_count, h2, images``.  Pages without a URL are left out.
    """
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    staged = pages.filter(~blank(F.col("url"))).withColumn("_segs", U.segments(F.col("url")))
    first = F.coalesce(F.try_element_at("_segs", F.lit(1)), F.lit(""))
    lang = F.when((F.length(first) == 2) & first.rlike(r"^\p{L}+$"), first)
    staged = staged.withColumn("_lang", lang).withColumn(
        "_parts", F.when(F.col("_lang").isNotNull(), F.slice("_segs", F.lit(2), F.size("_segs"))).otherwise(F.col("_segs"))
    )
    parts, depth = F.col("_parts"), F.size("_parts")
    suffixed = lambda c: F.concat_ws("_", c, F.col("_lang"))
    deep = depth >= 2
    kind = content_type(F.coalesce("word_count", F.lit(0)), n("h2"), n("images"))
    signature = (
        F.when(F.size("_segs") == 0, F.lit("homepage"))
        .when(depth == 0, suffixed(F.lit("homepage")))
        .when(_any_of(parts, BLOG), suffixed(F.when(deep, "blog_post").otherwise("blog_index")))
        .when(_any_of(parts, PRODUCT), suffixed(F.when(deep, "product_page").otherwise("product_listing")))
        .when(_any_of(parts, CATEGORY), suffixed(F.lit("category_page")))
        .when(_any_of(parts, INFO), suffixed(F.lit("info_page")))
        .when(_any_of(parts, FAQ), suffixed(F.lit("faq_page")))
        .when(_any_of(parts, LEGAL), suffixed(F.lit("legal_page")))
        .otherwise(F.concat_ws("_", url_pattern(parts), F.col("_lang"), kind))
    )
    return staged.withColumn("signature", signature).drop("_segs", "_lang", "_parts")


def with_template(signed: DataFrame) -> DataFrame:
    """Add ``template_id``: the signature, or ``_other_`` for single pages.

    The group size is a partial aggregate joined back (few rows per site),
    rather than a window that would sort a whole template in one task.
    """
    sizes = signed.groupBy("site_id", "signature").agg(F.count("*").alias("_n"))
    return signed.join(sizes, ["site_id", "signature"]).withColumn(
        "template_id", F.when(F.col("_n") >= 2, F.col("signature")).otherwise("_other_")
    ).drop("_n")


def template_groups(pages: DataFrame) -> DataFrame:
    """Pages with their template; signed pages are written once, as sizes, themes, counts and examples each read them."""
    return with_template(materialize(with_signature(pages).drop("html", "text_content")))


def template_counts(grouped: DataFrame) -> DataFrame:
    """Sizes and recommendation counts per template."""
    h1 = F.greatest(F.coalesce(F.size("h1"), F.lit(0)), F.lit(0))
    words = F.coalesce("word_count", F.lit(0))
    return grouped.groupBy("site_id", "template_id").agg(
        F.count("*").alias("page_count"),
        F.sum(words.cast("bigint")).alias("_words"),
        F.count_if(blank(F.col("meta_description"))).alias("no_meta"),
        F.count_if(h1 == 0).alias("no_h1"),
        F.count_if(h1 > 1).alias("multi_h1"),
        F.count_if(words < 300).alias("thin"),
        F.count_if(~blank(F.col("title"))).alias("titled"),
    ).withColumn("avg_words", intdiv(F.col("_words"), F.col("page_count"))).drop("_words")


def recommendations() -> Column:
    """Template recommendations from the columns of :func:`template_counts`."""
    n = F.col("page_count")
    fmt = F.format_string
    share = lambda c: F.col(c) / n
    # Message formats.
    return F.array_compact(
        F.array(
            F.when(share("no_meta") > 0.3, fmt("Add meta descriptions: %d/%d pages missing meta descriptions", F.col("no_meta"), n)),
            F.when(share("no_h1") > 0.2, fmt("Add H1 headings: %d/%d pages missing H1 tags", F.col("no_h1"), n)),
            F.when(share("multi_h1") > 0.3, fmt("Fix multiple H1s: %d/%d pages have more than one H1", F.col("multi_h1"), n)),
            F.when(
                (share("thin") > 0.5) & (F.col("avg_words") < 300),
                fmt("Expand thin content: Average word count is only %d. Consider adding more content.", F.col("avg_words")),
            ),
        )
    )


def title_themes(grouped: DataFrame, limit: int = 3) -> DataFrame:
    """Most common title words per template: count ≥ 2, ties by first appearance."""
    order = "page_seq"
    words = grouped.filter(~blank(F.col("title"))).select(
        "site_id", "template_id", order, F.posexplode(X.split_words(F.lower("title"))).alias("pos", "w")
    )
    clean = words.withColumn("word", F.regexp_replace("w", r"^[.,!?()\[\]{}:;\"']+|[.,!?()\[\]{}:;\"']+$", ""))
    clean = clean.filter((F.length("word") > 2) & ~F.col("word").isin(*THEME_STOPWORDS))
    counted = clean.groupBy("site_id", "template_id", "word").agg(
        F.count("*").alias("n"), F.min(F.struct(order, "pos")).alias("first")
    )
    return top_k(
        counted.filter("n >= 2"), ["site_id", "template_id"], [F.col("n").desc(), F.col("first")], limit, "rank"
    ).select("site_id", "template_id", "word", "n", "rank")


def _display(sig: Column) -> Column:
    """{name, desc} of a signature: exact entry, first contained entry, or title case."""
    base = sig
    for s in LANG_SUFFIXES:
        base = F.when(sig.endswith(s), F.left(sig, F.length(sig) - 3)).otherwise(base)

    def without_content(base: Column) -> Column:
        bare = base
        for s in reversed(CONTENT_SUFFIXES):
            bare = F.when(base.endswith(s), F.replace(base, F.lit(s), F.lit(""))).otherwise(bare)
        return bare

    def named(bare: Column) -> Column:
        words = F.replace(bare, F.lit("_"), F.lit(" "))
        name, desc = title_case(words), F.concat(F.lit("Pages with "), words, F.lit(" structure"))
        for key, n, d in reversed(TEMPLATE_INFO):
            name = F.when(bare.contains(key), F.lit(n)).otherwise(name)
            desc = F.when(bare.contains(key), F.lit(d)).otherwise(desc)
        for key, n, d in TEMPLATE_INFO:
            name = F.when(bare == key, F.lit(n)).otherwise(name)
            desc = F.when(bare == key, F.lit(d)).otherwise(desc)
        return F.struct(name.alias("name"), desc.alias("desc"))

    return let(let(base, without_content), named)


def title_case(c: Column) -> Column:
    """Every run of letters starts upper case (also after a digit or '-')."""
    pieces = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(pieces, F.initcap), "")


def template_profiles(grouped: DataFrame) -> DataFrame:
    """One row per template: name, description, counts, examples, recommendations."""
    sig = F.col("template_id")
    name, desc = F.col("_shown.name"), F.col("_shown.desc")
    last = F.substring_index(sig, "_", -1)
    lang = F.when((F.length(last) == 2) & last.rlike(r"^\p{L}+$"), F.upper(last))
    tagged = F.when(lang.isNotNull() & ~name.endswith(F.concat(F.lit("("), lang, F.lit(")"))), F.concat(name, F.lit(" ("), lang, F.lit(")"))).otherwise(name)
    themes = title_themes(grouped).groupBy("site_id", "template_id").agg(
        F.array_join(ordered_list(F.col("word"), F.col("rank")), ", ").alias("themes")
    )
    with_words = F.when(
        F.col("avg_words") > 0,
        F.concat(desc, F.lit(". Average "), F.format_number("avg_words", 0), F.lit(" words per page.")),
    ).otherwise(desc)
    with_themes = F.when(
        F.col("themes").isNotNull(), F.concat(with_words, F.lit(" Common themes: "), F.col("themes"), F.lit("."))
    ).otherwise(with_words)
    return (
        template_counts(grouped).withColumn("_shown", _display(sig))
        .join(themes, ["site_id", "template_id"], "left")
        .join(example_urls(grouped), ["site_id", "template_id"], "left")
        .select(
            "site_id", "template_id", tagged.alias("name"), with_themes.alias("description"), "page_count", "avg_words",
            "example_urls", recommendations().alias("recommendations"),
        )
    )


def example_urls(grouped: DataFrame, n: int = 10) -> DataFrame:
    return top_k(grouped.select("site_id", "template_id", "page_seq", "url"), ["site_id", "template_id"], [F.col("page_seq")], n).groupBy(
        "site_id", "template_id"
    ).agg(ordered_list(F.col("url"), F.col("_rn")).alias("example_urls"))


def url_wildcards(grouped: DataFrame) -> DataFrame:
    """The first five distinct wildcard patterns (in text order) of all pages of a template."""
    first = grouped.select("site_id", "template_id", "url")
    p = U.path(F.col("url"))
    p = F.regexp_replace(p, r"/\d+", "/{id}")
    p = F.regexp_replace(p, r"/[a-f0-9-]{36}", "/{uuid}")
    p = F.regexp_replace(p, r"/[a-z]{2}/", "/{lang}/")
    patterns = first.select("site_id", "template_id", p.alias("p")).distinct()
    return top_k(patterns, ["site_id", "template_id"], [F.col("p")], 5).groupBy("site_id", "template_id").agg(ordered_list(F.col("p"), F.col("_rn")).alias("url_patterns"))


def unclassified(pages: DataFrame, profiles: DataFrame, n: int | None = None) -> DataFrame:
    """Pages that are no template's example; on request the first n per site with their rank."""
    examples = profiles.select("site_id", F.explode("example_urls").alias("url")).distinct()
    rest = pages.select("site_id", "page_seq", "url").join(examples, ["site_id", "url"], "left_anti")
    return rest if n is None else top_k(rest, ["site_id"], [F.col("page_seq")], n, "rank")


def top_pages_per_template(pages: DataFrame, n: int = 3) -> DataFrame:
    """Longest pages of each template; needs ``template_type``."""
    typed = pages.withColumn("template_type", F.coalesce("template_type", F.lit("unknown")))
    return top_k(
        typed.select("site_id", "template_type", "url", "word_count", "page_seq"), ["site_id", "template_type"],
        [F.coalesce("word_count", F.lit(0)).desc(), F.col("page_seq")], n, "rank",
    )


def template_report(profiles: DataFrame, width: int = 60) -> DataFrame:
    """Report rows with the description cut at `width` characters."""
    d = F.col("description")
    cut = F.when(F.length(d) > width, F.concat(F.left(d, F.lit(width)), F.lit("..."))).otherwise(d)
    return profiles.select("site_id", "template_id", "name", "page_count", cut.alias("description"))
