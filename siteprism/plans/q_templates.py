"""Page template queries (T-1 … T-12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteprism.operators import templates as T
from siteprism.plans import pages as P
from siteprism.plans import sql_pages as S
from siteprism.plans.registry import query

_COLS = ["title", "meta_description", "h1", "h2", "images", "word_count"]
_KINDS = ["blog", "products", "about", "faq", "legal", "category", "x", "a/b", "", "item"]


def typed_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Features with a page-type segment put into the URL, so all types occur."""
    f = P.features(spark, sf, _COLS).select("page_id", "page_seq", "site_id", "url", *_COLS)
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("page_id") % 10 + 1).cast("int"))
    url = F.regexp_replace("url", r"/([a-z]{2})/(\d)", F.concat(F.lit("/$1/"), kind, F.lit("/$2")))
    return f.withColumn("url", F.when(F.col("page_id") % 25 == 0, F.concat(F.lit("https://"), "site_id", F.lit("/"))).otherwise(url))


_SEGS = f"[x for x in string_split({S.path('url')}, '/') if x <> '']"
_HAS = lambda words: "list_has_any(parts, [" + ", ".join(f"'{w}'" for w in words) + "])"
_L = "|| coalesce('_' || lang, '')"
_N = "len(parts)"
BASE = f"""{S.FEATURES},
tp0 AS (SELECT * EXCLUDE url, CASE WHEN page_id % 25 = 0 THEN 'https://' || site_id || '/' ELSE regexp_replace(url, '/([a-z]{{2}})/(\\d)',
   '/\\1/' || (['{"', '".join(_KINDS)}'])[page_id % 10 + 1] || '/\\2') END AS url FROM feat),
tp1 AS (SELECT *, {_SEGS} AS segs FROM tp0),
tp2 AS (SELECT *, CASE WHEN length(segs[1]) = 2 AND regexp_full_match(segs[1], '\\p{{L}}+') THEN segs[1] END AS lang,
   CASE WHEN length(segs[1]) = 2 AND regexp_full_match(segs[1], '\\p{{L}}+') THEN segs[2:] ELSE segs END AS parts FROM tp1),
signed AS (SELECT *, CASE WHEN len(segs) = 0 THEN 'homepage' WHEN {_N} = 0 THEN 'homepage' {_L}
   WHEN {_HAS(T.BLOG)} THEN CASE WHEN {_N} >= 2 THEN 'blog_post' ELSE 'blog_index' END {_L}
   WHEN {_HAS(T.PRODUCT)} THEN CASE WHEN {_N} >= 2 THEN 'product_page' ELSE 'product_listing' END {_L}
   WHEN {_HAS(T.CATEGORY)} THEN 'category_page' {_L} WHEN {_HAS(T.INFO)} THEN 'info_page' {_L}
   WHEN {_HAS(T.FAQ)} THEN 'faq_page' {_L} WHEN {_HAS(T.LEGAL)} THEN 'legal_page' {_L}
   ELSE (CASE WHEN contains(parts[-1], '.') THEN
           CASE WHEN lower(string_split(parts[-1], '.')[-1]) = 'html' AND (contains(regexp_extract(parts[-1], '^(.*)\\.[^.]*$', 1), '-') OR length(regexp_extract(parts[-1], '^(.*)\\.[^.]*$', 1)) > 10)
                THEN CASE WHEN {_N} > 1 THEN 'content_' || parts[1] ELSE 'content_page' END
                ELSE 'file_' || lower(string_split(parts[-1], '.')[-1]) END
         WHEN {_N} = 1 THEN 'section_' || left(parts[1], 20) WHEN {_N} = 2 THEN 'subsection_' || left(parts[1], 15)
         ELSE 'deep_content_d' || {_N} END) {_L}
      || CASE WHEN word_count > 1000 AND len(h2) >= 3 THEN '_long_form' WHEN len(images) > 5 AND word_count < 300 THEN '_gallery'
              WHEN word_count < 100 THEN '_minimal' ELSE '' END END AS signature FROM tp2),
grouped AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY site_id, signature) >= 2 THEN signature ELSE '_other_' END AS template_id FROM signed),
counts AS (SELECT site_id, template_id, count(*) AS page_count, (sum(word_count) // count(*))::BIGINT AS avg_words,
   count_if(meta_description = '') AS no_meta, count_if(len(h1) = 0) AS no_h1, count_if(len(h1) > 1) AS multi_h1,
   count_if(word_count < 300) AS thin FROM grouped GROUP BY ALL)"""


@query("t01_page_signature", f"WITH {BASE} SELECT page_id, url, signature FROM signed")
def t01(spark: SparkSession, sf: str) -> DataFrame:
    return T.with_signature(typed_pages(spark, sf)).select("page_id", "url", "signature")


_DOCS = """d AS (SELECT doc_id, 'https://docs.test/' || source || '/' || CASE doc_id % 6 WHEN 0 THEN 'a-b.html' WHEN 1 THEN 'x.html' WHEN 2 THEN 'index.PHP'
   WHEN 3 THEN 'deep/er/page' WHEN 4 THEN 'averylongfilename.html' ELSE '' END AS url, (doc_id % 8)::INT AS h2_count, (doc_id % 9)::INT AS images, n_chars // 6 AS words FROM documents)"""


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    tail = F.when(i % 6 == 0, "a-b.html").when(i % 6 == 1, "x.html").when(i % 6 == 2, "index.PHP").when(i % 6 == 3, "deep/er/page").when(
        i % 6 == 4, "averylongfilename.html").otherwise("")
    return spark.read.parquet(f"{sf}/documents.parquet").select(
        "doc_id", F.concat(F.lit("https://docs.test/"), "source", F.lit("/"), tail).alias("url"),
        (i % 8).cast("int").alias("h2_count"), (i % 9).cast("int").alias("images"), F.floor(F.col("n_chars") / 6).alias("words"),
    )


@query(
    "t02_content_type",
    f"""WITH {_DOCS} SELECT doc_id, CASE WHEN words > 1000 AND h2_count >= 3 THEN 'long_form' WHEN images > 5 AND words < 300 THEN 'gallery'
    WHEN words < 100 THEN 'minimal' END AS content_type FROM d""",
)
def t02(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", T.content_type(F.col("words"), F.col("h2_count"), F.col("images")).alias("content_type"))


@query(
    "t03_url_pattern",
    f"""WITH {_DOCS}, p AS (SELECT doc_id, {_SEGS} AS parts FROM d) SELECT doc_id, CASE WHEN contains(parts[-1], '.') THEN
      CASE WHEN regexp_matches(parts[-1], '(-.*|.{{11,}})\\.html$') THEN CASE WHEN len(parts) > 1 THEN 'content_' || parts[1] ELSE 'content_page' END
      ELSE 'file_' || lower(string_split(parts[-1], '.')[-1]) END
      WHEN len(parts) = 1 THEN 'section_' || left(parts[1], 20) WHEN len(parts) = 2 THEN 'subsection_' || left(parts[1], 15)
      ELSE 'deep_content_d' || len(parts) END AS pattern FROM p""",
)
def t03(spark: SparkSession, sf: str) -> DataFrame:
    from siteprism.functions import urls as U

    return _docs(spark, sf).select("doc_id", T.url_pattern(U.segments(F.col("url"))).alias("pattern"))


@query("t04_template_groups", f"WITH {BASE} SELECT page_id, site_id, template_id FROM grouped")
def t04(spark: SparkSession, sf: str) -> DataFrame:
    return T.template_groups(typed_pages(spark, sf)).select("page_id", "site_id", "template_id")


@query(
    "t05_template_profile",
    f"""WITH {BASE}, e AS (SELECT site_id, template_id, array_to_string((list(url ORDER BY page_seq))[1:10], chr(10)) AS example_urls FROM grouped GROUP BY ALL)
    SELECT site_id, template_id, page_count, avg_words, example_urls FROM counts JOIN e USING (site_id, template_id)""",
)
def t05(spark: SparkSession, sf: str) -> DataFrame:
    return T.template_profiles(T.template_groups(typed_pages(spark, sf))).select(
        "site_id", "template_id", "page_count", "avg_words", F.array_join("example_urls", "\n").alias("example_urls")
    )


_STOP = ", ".join(f"'{w}'" for w in T.THEME_STOPWORDS)
_PUNCT = "[.,!?()\\[\\]{}:;\"'']+"
_THEMES = f"""tw AS (SELECT site_id, template_id, page_seq, unnest({S.word_list('lower(title)')}) AS w0, generate_subscripts({S.word_list('lower(title)')}, 1) AS pos FROM grouped WHERE title <> ''),
tc AS (SELECT *, regexp_replace(w0, '^{_PUNCT}|{_PUNCT}$', '', 'g') AS word FROM tw),
tn AS (SELECT site_id, template_id, word, count(*) AS n, min((page_seq, pos)) AS first FROM tc WHERE length(word) > 2 AND word NOT IN ({_STOP}) GROUP BY ALL HAVING count(*) >= 2),
themes AS (SELECT *, row_number() OVER (PARTITION BY site_id, template_id ORDER BY n DESC, first)::INT AS rank FROM tn QUALIFY rank <= 3)"""
_EXACT = " ".join(f"WHEN bare = '{k}' THEN '{{}}'".format(n.replace("'", "''")) for k, n, _ in T.TEMPLATE_INFO)
_PART = " ".join(f"WHEN contains(bare, '{k}') THEN '{{}}'".format(n.replace("'", "''")) for k, n, _ in T.TEMPLATE_INFO)
_EXACT_D = " ".join(f"WHEN bare = '{k}' THEN '{{}}'".format(d.replace("'", "''")) for k, _, d in T.TEMPLATE_INFO)
_PART_D = " ".join(f"WHEN contains(bare, '{k}') THEN '{{}}'".format(d.replace("'", "''")) for k, _, d in T.TEMPLATE_INFO)
_INITCAP = (
    "array_to_string([upper(left(p, 1)) || lower(substr(p, 2)) for p in regexp_extract_all(replace(bare, '_', ' '), '[\\p{L}]+|[^\\p{L}]+')], '')"
)
_NAMED = f"""nm0 AS (SELECT c.*, regexp_replace(template_id, '_(en|es|de|fr|it|pt)$', '') AS base FROM counts c),
nm1 AS (SELECT *, CASE WHEN ends_with(base, '_long_form') THEN replace(base, '_long_form', '') WHEN ends_with(base, '_gallery') THEN replace(base, '_gallery', '')
   WHEN ends_with(base, '_minimal') THEN replace(base, '_minimal', '') ELSE base END AS bare,
   CASE WHEN length(string_split(template_id, '_')[-1]) = 2 AND regexp_full_match(string_split(template_id, '_')[-1], '\\p{{L}}+') THEN upper(string_split(template_id, '_')[-1]) END AS code FROM nm0),
nm2 AS (SELECT *, CASE {_EXACT} {_PART} ELSE {_INITCAP} END AS plain, CASE {_EXACT_D} {_PART_D} ELSE 'Pages with ' || replace(bare, '_', ' ') || ' structure' END AS dsc FROM nm1),
th AS (SELECT site_id, template_id, string_agg(word, ', ' ORDER BY rank) AS t FROM themes GROUP BY ALL),
named AS (SELECT n.site_id, n.template_id, n.page_count, CASE WHEN code IS NOT NULL AND NOT ends_with(plain, '(' || code || ')') THEN plain || ' (' || code || ')' ELSE plain END AS name,
   dsc || CASE WHEN avg_words > 0 THEN '. Average ' || format('{{:,}}', avg_words) || ' words per page.' ELSE '' END
   || CASE WHEN t IS NOT NULL THEN ' Common themes: ' || t || '.' ELSE '' END AS description
   FROM nm2 n LEFT JOIN th USING (site_id, template_id))"""


@query("t06_template_names", f"WITH {BASE}, {_THEMES}, {_NAMED} SELECT site_id, template_id, name, description FROM named")
def t06(spark: SparkSession, sf: str) -> DataFrame:
    return T.template_profiles(T.template_groups(typed_pages(spark, sf))).select("site_id", "template_id", "name", "description")


@query("t07_title_themes", f"WITH {BASE}, {_THEMES} SELECT site_id, template_id, word, n, rank FROM themes")
def t07(spark: SparkSession, sf: str) -> DataFrame:
    return T.title_themes(T.template_groups(typed_pages(spark, sf)))


@query(
    "t08_template_recommendations",
    f"""WITH {BASE} SELECT site_id, template_id, array_to_string([r for r in [
      CASE WHEN no_meta / page_count > 0.3 THEN 'Add meta descriptions: ' || no_meta || '/' || page_count || ' pages missing meta descriptions' END,
      CASE WHEN no_h1 / page_count > 0.2 THEN 'Add H1 headings: ' || no_h1 || '/' || page_count || ' pages missing H1 tags' END,
      CASE WHEN multi_h1 / page_count > 0.3 THEN 'Fix multiple H1s: ' || multi_h1 || '/' || page_count || ' pages have more than one H1' END,
      CASE WHEN thin / page_count > 0.5 AND avg_words < 300 THEN 'Expand thin content: Average word count is only ' || avg_words || '. Consider adding more content.' END]
      if r IS NOT NULL], chr(10)) AS recommendations FROM counts""",
)
def t08(spark: SparkSession, sf: str) -> DataFrame:
    c = T.template_counts(T.template_groups(typed_pages(spark, sf)))
    return c.select("site_id", "template_id", F.array_join(T.recommendations(), "\n").alias("recommendations"))


@query(
    "t09_url_wildcards",
    f"""WITH {BASE}, f AS (SELECT site_id, template_id, regexp_replace(regexp_replace(regexp_replace({S.path('url')}, '/\\d+', '/{{id}}', 'g'),
      '/[a-f0-9-]{{36}}', '/{{uuid}}', 'g'), '/[a-z]{{2}}/', '/{{lang}}/', 'g') AS p
      FROM grouped)
    SELECT site_id, template_id, array_to_string(list_sort(list(DISTINCT p))[1:5], chr(10)) AS url_patterns FROM f GROUP BY ALL""",
)
def t09(spark: SparkSession, sf: str) -> DataFrame:
    return T.url_wildcards(T.template_groups(typed_pages(spark, sf))).select(
        "site_id", "template_id", F.array_join("url_patterns", "\n").alias("url_patterns")
    )


@query(
    "t10_unclassified_pages",
    f"""WITH {BASE}, e AS (SELECT site_id, url FROM grouped QUALIFY row_number() OVER (PARTITION BY site_id, template_id ORDER BY page_seq) <= 10)
    SELECT site_id, url FROM grouped g
    WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.site_id = g.site_id AND e.url = g.url)""",
)
def t10(spark: SparkSession, sf: str) -> DataFrame:
    g = T.template_groups(typed_pages(spark, sf))
    return T.unclassified(g, T.example_urls(g)).select("site_id", "url")


@query(
    "t11_top_pages_per_template",
    f"""WITH {BASE} SELECT site_id, template_type, url, word_count, row_number() OVER (PARTITION BY site_id, template_type ORDER BY word_count DESC, page_seq)::INT AS rank
    FROM (SELECT *, CASE WHEN page_id % 6 = 0 THEN 'unknown' ELSE template_id END AS template_type FROM grouped) QUALIFY rank <= 3""",
)
def t11(spark: SparkSession, sf: str) -> DataFrame:
    g = T.template_groups(typed_pages(spark, sf)).withColumn("template_type", F.when(F.col("page_id") % 6 != 0, F.col("template_id")))
    return T.top_pages_per_template(g).select("site_id", "template_type", "url", "word_count", "rank")


@query(
    "t12_template_report",
    f"""WITH {BASE}, {_THEMES}, {_NAMED} SELECT site_id, template_id, name, page_count,
    CASE WHEN length(description) > 60 THEN left(description, 60) || '...' ELSE description END AS description FROM named""",
)
def t12(spark: SparkSession, sf: str) -> DataFrame:
    return T.template_report(T.template_profiles(T.template_groups(typed_pages(spark, sf))))
