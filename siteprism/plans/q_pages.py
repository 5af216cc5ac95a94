"""Page feature queries (HTML → columns)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteprism.functions import html as H
from siteprism.functions import text as X
from siteprism.functions import urls as U
from siteprism.plans import pages as P
from siteprism.plans import sql_pages as S
from siteprism.plans.registry import query, table



def _joined(array: str, expr) -> F.Column:
    return F.array_join(F.transform(array, expr), "\n")


def _feat(select: str) -> str:
    return f"WITH {S.FEATURES} SELECT page_id, {select} FROM feat"


@query("f01_title", _feat("title, length(title)::INT AS title_length"))
def f01(spark: SparkSession, sf: str) -> DataFrame:
    return P.features(spark, sf, ["title"]).select("page_id", "title", F.length("title").alias("title_length"))


@query(
    "f02_meta",
    _feat(
        f"""meta_description, meta_robots, has_viewport_meta, viewport_content,
    coalesce(([{S.attr('x', 'content')} for x in metas if {S.attr('x', 'property')} = 'og:title'])[-1], '') AS og_title,
    coalesce(([{S.attr('x', 'content')} for x in metas if {S.attr('x', 'property')} = 'og:image'])[-1], '') AS og_image,
    coalesce(([{S.attr('x', 'content')} for x in metas if {S.attr('x', 'name')} = 'twitter:card'])[-1], '') AS twitter_card,
    len([1 for x in metas if starts_with({S.attr('x', 'name')}, 'twitter:')])::INT AS n_twitter"""
    ),
)
def f02(spark: SparkSession, sf: str) -> DataFrame:
    og = lambda m, k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(""))
    return P.features(spark, sf, ["meta_description", "meta_robots", "has_viewport_meta", "viewport_content", "open_graph", "twitter_cards"]).select(
        "page_id", "meta_description", "meta_robots", "has_viewport_meta", "viewport_content",
        og("open_graph", "og:title").alias("og_title"), og("open_graph", "og:image").alias("og_image"),
        og("twitter_cards", "twitter:card").alias("twitter_card"), F.size("twitter_cards").alias("n_twitter"),
    )


@query(
    "f03_canonical_hreflang",
    _feat("canonical_url, array_to_string([x.lang || '=' || x.url for x in hreflang], chr(10)) AS hreflang, stylesheets_count::INT AS stylesheets_count"),
)
def f03(spark: SparkSession, sf: str) -> DataFrame:
    return P.features(spark, sf, ["canonical_url", "hreflang", "stylesheets_count"]).select(
        "page_id", "canonical_url", _joined("hreflang", lambda h: F.concat(h["lang"], F.lit("="), h["url"])).alias("hreflang"),
        "stylesheets_count",
    )


@query("f04_headings", _feat("array_to_string(h1, chr(10)) AS h1, array_to_string(h2, chr(10)) AS h2, array_to_string(h3, chr(10)) AS h3"))
def f04(spark: SparkSession, sf: str) -> DataFrame:
    return P.features(spark, sf, ["h1", "h2", "h3"]).select("page_id", *[F.array_join(h, "\n").alias(h) for h in ("h1", "h2", "h3")])


_LINK = "array_to_string([x.url || ' ' || x.text || ' ' || x.nofollow::VARCHAR for x in {l}], chr(10)) AS {l}"


@query("f05_links", _feat(_LINK.format(l="internal_links") + ", " + _LINK.format(l="external_links")))
def f05(spark: SparkSession, sf: str) -> DataFrame:
    show = lambda x: F.concat_ws(" ", x["url"], x["text"], x["nofollow"].cast("string"))
    return P.features(spark, sf, ["internal_links", "external_links"]).select(
        "page_id", _joined("internal_links", show).alias("internal_links"), _joined("external_links", show).alias("external_links")
    )


@query(
    "f06_images",
    _feat("array_to_string([x.url || '|' || x.alt || '|' || coalesce(x.width, '-') || '|' || coalesce(x.height, '-') for x in images[1:100]], chr(10)) AS images"),
)
def f06(spark: SparkSession, sf: str) -> DataFrame:
    show = lambda x: F.concat_ws("|", x["url"], x["alt"], F.coalesce(x["width"], F.lit("-")), F.coalesce(x["height"], F.lit("-")))
    return P.features(spark, sf, ["images"]).select("page_id", _joined("images", show).alias("images"))


@query("f07_text", _feat("word_count::INT AS word_count, text_content_hash, length(text_content)::INT AS text_length"))
def f07(spark: SparkSession, sf: str) -> DataFrame:
    return P.features(spark, sf, ["word_count", "text_content_hash", "text_content"]).select("page_id", "word_count", "text_content_hash", F.length("text_content").alias("text_length"))


@query(
    "f07b_page_flags",
    f"""WITH {S.FEATURES} SELECT page_id, html_lang, noindex, nofollow, scripts_count::INT AS scripts_count,
    CASE WHEN page_id % 3 = 0 THEN '' WHEN page_id % 11 = 0 THEN 'cache-control,cf-ray,content-encoding,strict-transport-security,x-robots-tag'
    ELSE 'cache-control,content-encoding,strict-transport-security,x-robots-tag' END AS header_keys FROM feat""",
)
def f07b(spark: SparkSession, sf: str) -> DataFrame:
    raw = P.rich_pages(spark, sf).withColumn("response_headers", F.transform_keys("response_headers", lambda k, _: F.lower(k)))
    return H.extract_page(raw, ["html_lang", "noindex", "nofollow", "scripts_count"]).select(
        "page_id", "html_lang", "noindex", "nofollow", "scripts_count",
        F.coalesce(F.array_join(F.array_sort(F.map_keys("response_headers")), ","), F.lit("")).alias("header_keys"),
    )


@query(
    "f08_structured_data",
    _feat("""array_to_string(types, ',') AS types,
    array_to_string([array_to_string(json_keys(x), '+') for x in objs], ',') AS keys,
    len([1 for x in objs if coalesce(x->>'$.address', '') <> ''])::INT AS with_address"""),
)
def f08(spark: SparkSession, sf: str) -> DataFrame:
    return P.features(spark, sf, ["structured_data"]).select(
        "page_id", F.array_join(F.transform("structured_data", lambda s: s["type"]), ",").alias("types"),
        F.array_join(F.transform("structured_data", lambda s: F.array_join(s["keys"], "+")), ",").alias("keys"),
        F.size(F.filter("structured_data", lambda s: s["has_address"])).alias("with_address"),
    )


@query("f09_schema_errors", _feat("ld_bad::INT AS schema_errors"))
def f09(spark: SparkSession, sf: str) -> DataFrame:
    return P.features(spark, sf, ["schema_errors"]).select("page_id", F.size("schema_errors").alias("schema_errors"))


_F10 = ["has_mixed_content", "render_blocking_resources", "third_party_scripts", "forms_without_labels", "has_skip_link",
        "has_rel_next", "has_rel_prev", "has_flash", "requires_plugin"]


@query("f10_html_flags", _feat(", ".join(f"{c}::INT AS {c}" for c in _F10)))
def f10(spark: SparkSession, sf: str) -> DataFrame:
    return P.features(spark, sf, _F10).select("page_id", *[F.col(c).cast("int").alias(c) for c in _F10])


_SHORT = "lower(regexp_extract(text, '([\\p{L}\\p{N}_]+)', 1))"


@query(
    "f11_keyword_density",
    f"""SELECT doc_id, {_SHORT} AS keyword,
    round(CASE WHEN {S.n_words('text')} > 0 AND {_SHORT} <> ''
      THEN ((length(lower(text)) - length(replace(lower(text), {_SHORT}, ''))) // length({_SHORT})) * 100.0::DOUBLE / {S.n_words('text')}
      ELSE 0 END, 6) AS density FROM documents""",
)
def f11(spark: SparkSession, sf: str) -> DataFrame:
    kw = F.lower(F.coalesce(F.try_element_at(X.words(F.col("text")), F.lit(1)), F.lit("")))
    d = table(spark, sf, "documents").select("doc_id", "text", kw.alias("keyword"))
    return d.select("doc_id", "keyword", F.round(X.keyword_density(F.col("text"), F.col("keyword")), 6).alias("density"))


@query(
    "f12_readability",
    f"""SELECT doc_id, round(CASE WHEN w > 0 THEN 206.835::DOUBLE - 1.015::DOUBLE * w / s - 84.6::DOUBLE * v / w ELSE 100 END, 4) AS score FROM (
    SELECT doc_id, {S.n_words('text')} AS w, greatest(len(regexp_extract_all(text, '[.!?]+')), 1) AS s,
      len(regexp_extract_all(lower(text), '[aeiouyàâäáãéèêëíìîïóòôöõúùûüœæ]+')) AS v FROM documents)""",
)
def f12(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.round(X.readability(F.col("text")), 4).alias("score"))


_INNER = S.inner("regexp_replace(regexp_extract(html, '(?is)<body(?:\\s[^>]*)?>(.*)$', 1), '" + S._BLOCKS + "', ' ', 'g')")
_SPA = f"""spa AS (SELECT *, array_to_string([r for r in [
    CASE WHEN page_id % 12 = 1 THEN 'Vue.js markers detected' END,
    CASE WHEN page_id % 12 = 2 THEN 'Next.js root element detected' END,
    CASE WHEN length({_INNER}) < 300 AND scripts_count > 5 THEN
      'Minimal body content (' || length({_INNER}) || ' chars) with ' || scripts_count || ' external scripts' END,
    CASE WHEN page_id % 12 < 2 THEN 'Empty or minimal root container element' END,
    CASE WHEN page_id % 12 = 2 THEN 'Loading indicators found in HTML' END] if r IS NOT NULL], '; ') AS reasons,
    CASE page_id % 12 WHEN 1 THEN 'vue' WHEN 2 THEN 'nextjs' ELSE '' END AS framework FROM feat)"""


@query("f14_spa_detection", f"WITH {S.FEATURES}, {_SPA} SELECT page_id, reasons <> '' AS needs_js, framework, reasons FROM spa")
def f14(spark: SparkSession, sf: str) -> DataFrame:
    p = P.rich_pages(spark, sf).select("page_id", H.spa(F.col("html")).alias("s"))
    return p.select("page_id", "s.needs_js", "s.framework", F.array_join("s.reasons", "; ").alias("reasons"))


@query(
    "f15_js_decision",
    f"""WITH {S.FEATURES}, {_SPA} SELECT page_id,
    (word_count < 50 OR reasons <> '') AS needs_js,
    CASE WHEN word_count < 50 THEN 'Low word count (' || word_count || ')'
         WHEN reasons <> '' THEN 'SPA detected (' || framework || '): ' || string_split(reasons, '; ')[1] ELSE '' END AS needs_js_reason,
    (reasons <> '' OR word_count < 50 OR scripts_count > 0) AS should_render,
    CASE WHEN reasons <> '' THEN 'SPA detected (' || CASE framework WHEN '' THEN 'unknown' ELSE framework END || '): ' || array_to_string(string_split(reasons, '; ')[1:2], ', ')
         WHEN word_count < 50 THEN 'Very low word count (' || word_count || '), may need JS rendering'
         WHEN scripts_count > 0 THEN 'JavaScript framework detected in script: react'
         ELSE 'No JS rendering needed' END AS should_render_reason FROM spa""",
)
def f15(spark: SparkSession, sf: str) -> DataFrame:
    p = P.rich_pages(spark, sf).select("page_id", "html", X.word_count(H.visible_text(F.col("html"))).alias("word_count"))
    return H.js_decision(p).select("page_id", "needs_js", "needs_js_reason", "should_render", "should_render_reason")


@query(
    "f16_light_facts",
    f"""WITH {S.RICH}, l AS (SELECT *, regexp_extract_all(html, 'href=["'']([^"'']+)["'']', 1) AS refs,
      regexp_extract_all(lower(html), '<img[^>]+>') AS imgs FROM rich),
    h AS (SELECT *, [{S.host(S.resolve('url', 'x'))} for x in refs if NOT starts_with(x, '#') AND NOT starts_with(x, 'javascript:')] AS hosts FROM l)
    SELECT page_id, {S.strip("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title,
      CASE WHEN contains(html, 'name="description"') AND regexp_matches(html, '(?s)name="description".*content="')
           THEN regexp_extract(html, '(?s)name="description".*?content="([^"]*)"', 1) END AS meta_description,
      len(regexp_extract_all(lower(html), '<h1'))::INT AS h1_count, len(regexp_extract_all(lower(html), '<h2'))::INT AS h2_count,
      length(html)::INT AS content_length, len([1 for x in hosts if x = site_id])::INT AS internal_links,
      len([1 for x in hosts if x <> '' AND x <> site_id])::INT AS external_links, len(imgs)::INT AS images_total,
      len([1 for x in imgs if NOT contains(x, 'alt=') OR contains(x, 'alt=""')])::INT AS images_without_alt,
      {S.n_words("regexp_replace(html, '<[^>]+>', ' ', 'g')")}::INT AS word_count,
      contains(lower(html), 'rel="canonical"') AS has_canonical, contains(lower(html), 'name="robots"') AS has_robots_meta FROM h""",
)
def f16(spark: SparkSession, sf: str) -> DataFrame:
    return H.light_facts(P.rich_pages(spark, sf).select("page_id", "url", "html")).drop("url")


@query(
    "f17_status_summary",
    f"""WITH {S.RICH} SELECT site_id, count(*) AS total, count_if(status_code = 200) AS ok, count_if(status_code IN (301, 302)) AS redirects,
    count_if(status_code = 404) AS not_found, count_if(status_code = 0) AS errors FROM rich GROUP BY site_id""",
)
def f17(spark: SparkSession, sf: str) -> DataFrame:
    return H.status_summary(P.rich_pages(spark, sf), ["site_id"])


@query(
    "f18_storage_row",
    _feat("""nullif(title, '') AS title, nullif(meta_description, '') AS meta_description, nullif(canonical_url, '') AS canonical_url,
    nullif(meta_robots, '') AS meta_robots, nullif(h1[1], '') AS h1, nullif(html_lang, '') AS html_lang, word_count::INT AS word_count"""),
)
def f18(spark: SparkSession, sf: str) -> DataFrame:
    return H.to_storage_row(P.features(spark, sf, ["title", "meta_description", "canonical_url", "meta_robots", "h1", "html_lang", "word_count"])).select(
        "page_id", "title", "meta_description", "canonical_url", "meta_robots", "h1", "html_lang", "word_count"
    )


@query(
    "m01_scalar_functions",
    f"""SELECT page_id, {S.host('url')} AS host, {S.path('url')} AS path, left(md5(url), 12) AS storage_key,
    regexp_extract(regexp_replace(url, '^https?://', ''), '^([^/]*)', 1) AS domain,
    CASE WHEN length(url) > 40 THEN left(url, 37) || '...' ELSE url END AS short_url,
    array_to_string([CASE WHEN (length(s) = 36 AND contains(s, '-')) OR regexp_full_match(s, '[0-9]+') THEN '{{id}}' ELSE s END for s in string_split({S.path('url')}, '/')], '/') AS normal_path,
    left(regexp_replace(regexp_replace(lower(url), '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), '[-\\s]+', '-', 'g'), 50) AS slug FROM pages""",
)
def scalars(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", U.host(u).alias("host"), U.path(u).alias("path"), U.storage_key(u).alias("storage_key"),
        U.domain_of(u).alias("domain"), X.truncate(u, 40).alias("short_url"),
        U.normalize_path(U.path(u)).alias("normal_path"), X.slug(u).alias("slug"),
    )
