"""SQL twin of the audit: hits per check, then the site × rule grid (DuckDB)."""

from __future__ import annotations

from siteprism.operators.rules import RULES, category
from siteprism.plans import sql_pages as S

_URLPATH = S.path("url")
_SEGS = f"[x for x in string_split({_URLPATH}, '/') if x <> '']"
_W = "[\\p{L}\\p{N}_]+"
_IMPORTANT = (
    f"[w for w in list_distinct(regexp_extract_all(lower(title), '{_W}') || regexp_extract_all(lower(coalesce(h1[1], '')), '{_W}')) "
    "if w NOT IN ('the','a','an','of','to','in','for','and','or')]"
)
_BAD_LD = (
    "len([1 for x in objs if (x->>'$.\"@type\"' = 'Article' AND NOT (list_contains(json_keys(x), 'headline') AND list_contains(json_keys(x), 'author') AND list_contains(json_keys(x), 'datePublished'))) "
    "OR (x->>'$.\"@type\"' = 'Product' AND NOT (list_contains(json_keys(x), 'name') AND list_contains(json_keys(x), 'description')))])"
)
_STEM = "rtrim({c}, '/')"
_READ = (
    f"206.835::DOUBLE - 1.015::DOUBLE * word_count / greatest(len(regexp_extract_all(text_content, '[.!?]+')), 1) "
    "- 84.6::DOUBLE * len(regexp_extract_all(lower(text_content), '[aeiouyàâäáãéèêëíìîïóòôöõúùûüœæ]+')) / word_count"
)
_KW = f"regexp_extract(title, '({_W})', 1)"

# Affected elements of one page, by check id.
PAGE = {
    5: "noindex AND status_code = 200 AND NOT regexp_matches(url, '/tag/|/author/|/page/|\\?|/search')",
    6: "status_code = 200 AND canonical_url = ''",
    7: f"canonical_url <> '' AND canonical_url <> url AND {_STEM.format(c='canonical_url')} <> {_STEM.format(c='url')}",
    8: "page_id % 3 <> 0 AND page_id % 19 = 0",
    10: "crawl_depth > 4",
    11: "title = '' AND status_code = 200",
    12: "title <> '' AND length(title) < 30",
    13: "length(title) > 60",
    15: "meta_description = '' AND status_code = 200",
    16: "meta_description <> '' AND length(meta_description) NOT BETWEEN 70 AND 160",
    17: "len(h1) = 0 AND status_code = 200",
    18: "len(h1) > 1",
    19: "(len(h1) = 0 AND len(h2) + len(h3) > 0) OR (len(h3) > 0 AND len(h2) = 0)",
    20: "len([1 for x in images if x.alt = '']) > 0",
    21: "page_id * 53 % 5000 > 2500",
    22: "page_id * 13 % 400 > 200",
    23: "(page_id * 7 % 30) / 100.0::DOUBLE > 0.1::DOUBLE",
    24: "load_time_ms > 800",
    25: "render_blocking_resources > 3",
    27: "len([1 for x in images if coalesce(x.width, '') = '' OR coalesce(x.height, '') = '']) > 0",
    28: "page_id % 3 <> 0 AND page_id % 4 = 0",
    29: "page_id % 6 = 0",
    30: "third_party_scripts > 10",
    31: "length(url) > 100",
    32: "regexp_matches(url, '[^\\x00-\\x7F]')",
    33: f"contains({_URLPATH}, '_')",
    34: f"{_URLPATH} <> lower({_URLPATH})",
    35: "canonical_url <> '' AND ends_with(canonical_url, '/') <> ends_with(url, '/')",
    36: f"len({_SEGS}) > 4",
    37: "contains(url, '?')",
    38: "regexp_matches(lower(url), 'sid=|session=|phpsessid=|jsessionid=|aspsessionid')",
    40: f"len({_IMPORTANT}) > 0 AND NOT list_has_any({_IMPORTANT}, regexp_extract_all(lower({_URLPATH}), '{_W}'))",
    43: "page_id % 5 > 1",
    45: f"len([1 for x in internal_links if {S.strip('lower(x.text)')} IN ('click here','read more','learn more','here','more','link')]) > 0",
    46: "status_code = 200 AND len(internal_links) < 3",
    47: "len(internal_links) > 100",
    48: f"len({_SEGS}) > 1 AND NOT list_contains(types, 'BreadcrumbList')",
    49: "crawl_depth > 4",
    50: "regexp_matches(url, '/page/|\\?page=') AND NOT has_rel_next AND NOT has_rel_prev",
    51: "status_code = 200 AND word_count < 300",
    53: "page_id % 14 = 0",
    54: "status_code = 200 AND word_count < 50",
    55: f"{_KW} <> '' AND ((length(lower(text_content)) - length(replace(lower(text_content), lower({_KW}), ''))) // length({_KW})) * 100.0::DOUBLE / word_count > 3",
    58: "page_id % 3 <> 0 OR title = ''",
    59: "page_id % 2 <> 0",
    60: f"({_READ}) < 40",
    61: "len(types) = 0 AND status_code = 200",
    62: "ld_bad > 0",
    64: f"len({_SEGS}) > 1 AND NOT list_contains(types, 'BreadcrumbList')",
    65: "regexp_matches(url, '/blog/|/news/|/article/|/post/') AND NOT list_has_any(types, ['Article','NewsArticle','BlogPosting'])",
    66: "regexp_matches(url, '/product/|/products/|/shop/|/store/') AND NOT list_contains(types, 'Product')",
    68: "regexp_matches(lower(url), '/faq|/frequently-asked|/questions') AND NOT list_contains(types, 'FAQPage')",
    69: "regexp_matches(lower(url), '/review|/testimonial|/rating') AND NOT list_has_any(types, ['Review','AggregateRating'])",
    71: "starts_with(url, 'http://')",
    72: "has_mixed_content",
    75: "page_id % 3 <> 0 AND page_id % 2 <> 0",
    76: "html_lang = ''",
    77: "len(hreflang) > 0 AND len([1 for h in hreflang if h.url = url]) = 0",
    78: "page_id % 10 = 0",
    79: "forms_without_labels",
    80: "NOT has_skip_link",
    81: "NOT has_viewport_meta",
    82: "NOT contains(viewport_content, 'width=device-width')",
    83: "page_id % 12 = 0",
    84: "page_id % 13 = 0",
    85: "page_id % 15 = 0",
    86: "page_id % 18 = 0",
    88: "has_flash",
    89: "requires_plugin",
    90: "page_id % 21 = 0",
    91: "status_code BETWEEN 400 AND 499",
    92: "status_code BETWEEN 500 AND 599",
    93: "page_id % 5 > 2",
    94: "page_id % 41 = 0",
    95: "status_code = 302",
    97: "page_id % 3 <> 0 AND page_id % 5 = 0",
    99: "load_time_ms > 600",
}
ELEMENTS = {
    26: "CASE WHEN page_id * 7919 % 400000 > 200000 THEN len(images) ELSE 0 END",
    44: "len([1 for x in internal_links if x.nofollow])",
    57: "CASE WHEN page_id % 20 = 1 THEN len(images) ELSE 0 END",
    70: _BAD_LD,
}
_NOPS = "NULL::BIGINT AS metric"

LINKS = """
edges AS (SELECT site_id, page_seq, url AS src, unnest(internal_links).url AS dst FROM feat),
indeg AS (SELECT site_id, dst, count(DISTINCT src) AS n FROM edges GROUP BY ALL),
inl AS (SELECT f.site_id, f.page_seq, f.url, coalesce(i.n, 0) AS n FROM feat f
  LEFT JOIN indeg i ON i.site_id = f.site_id AND i.dst = rtrim(f.url, '/')
  WHERE f.status_code = 200 AND rtrim(f.url, '/') NOT IN (SELECT rtrim(base_url, '/') FROM site s WHERE s.site_id = f.site_id))"""


def _dup(check_id: int, key: str) -> str:
    return (
        f"SELECT site_id, {check_id} AS check_id, page_seq, first_seq AS ord, url, 1 AS n, {_NOPS} FROM ("
        f"SELECT *, count(*) OVER g AS c, min(page_seq) OVER g AS first_seq FROM "
        f"(SELECT *, {key} AS k FROM feat WHERE status_code = 200) WHERE k <> '' WINDOW g AS (PARTITION BY site_id, k)) WHERE c > 1"
    )


def _site(check_id: int, n: str, url: str, source: str = "site s") -> str:
    return f"SELECT s.site_id, {check_id}, 0, 0, {url}, {n}, {_NOPS} FROM {source} WHERE {n} > 0"


def hits(check_id: int) -> str | None:
    """SELECT of the hits of one check; None for constant checks."""
    i = check_id
    if i in PAGE:
        metric = "load_time_ms AS metric" if i == 24 else _NOPS
        return f"SELECT site_id, {i} AS check_id, page_seq, 0 AS ord, url, 1 AS n, {metric} FROM feat WHERE {PAGE[i]}"
    if i in ELEMENTS:
        return f"SELECT site_id, {i} AS check_id, page_seq, 0 AS ord, url, {ELEMENTS[i]} AS n, {_NOPS} FROM feat WHERE {ELEMENTS[i]} > 0"
    if i == 14:
        return _dup(14, S.strip("lower(title)"))
    if i in (39, 52):
        return _dup(i, "text_content_hash")
    if i == 9:
        return f"SELECT site_id, 9 AS check_id, page_seq, 0 AS ord, url, 1 AS n, {_NOPS} FROM inl WHERE n = 0"
    if i == 41:
        return f"SELECT site_id, 41 AS check_id, page_seq, 0 AS ord, url, 1 AS n, {_NOPS} FROM inl WHERE n BETWEEN 1 AND 2"
    if i == 42:
        return (
            f"SELECT site_id, 42 AS check_id, page_seq, 0 AS ord, src AS url, count(*) AS n, {_NOPS} FROM edges e "
            "WHERE NOT EXISTS (SELECT 1 FROM feat f WHERE f.site_id = e.site_id AND f.url = e.dst) GROUP BY site_id, page_seq, src"
        )
    site = {
        1: ("(hub_id % 4 = 0)::INT", "base_url || '/robots.txt'"),
        # content holds "Disallow: /CSS" and "Disallow: *.js": /css and .js are hit
        2: ("CASE WHEN hub_id % 4 <> 0 AND hub_id % 3 = 0 THEN 2 ELSE 0 END", "NULL"),
        3: ("(hub_id % 3 = 0)::INT", "base_url || '/sitemap.xml'"),
        4: ("CASE WHEN hub_id % 3 <> 0 AND hub_id % 5 = 0 THEN 2 ELSE 0 END", "NULL"),
        63: ("(NOT coalesce((SELECT arg_min(list_contains(f.types, 'Organization'), f.page_seq) FROM feat f WHERE f.site_id = s.site_id AND rtrim(f.url, '/') = rtrim(s.base_url, '/')), false))::INT", "base_url"),
        67: ("(NOT coalesce((SELECT bool_or(len([1 for x in f.objs if x->>'$.\"@type\"' IN ('Organization', 'LocalBusiness') AND coalesce(x->>'$.address', '') <> '']) > 0) FROM feat f WHERE f.site_id = s.site_id), false))::INT", "base_url"),
        73: ("(NOT starts_with(base_url, 'https://'))::INT", "NULL"),
        96: ("(NOT (SELECT bool_or(f.page_id % 34 = 0) FROM feat f WHERE f.site_id = s.site_id))::INT", "NULL"),
        98: ("(NOT (SELECT bool_or(f.page_id % 3 <> 0 AND f.page_id % 11 = 0) FROM feat f WHERE f.site_id = s.site_id))::INT", "NULL"),
    }
    if i in site:
        n, url = site[i]
        return (
            f"SELECT site_id, {i} AS check_id, 0 AS page_seq, 0 AS ord, {url} AS url, n, {_NOPS} "
            f"FROM (SELECT s.*, {n} AS n FROM site s) WHERE n > 0"
        )
    return None


def _literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def ctes(only: list[int] | None = None) -> str:
    """CTE prefix ending in `checks`, the twin of operators.audit.audit."""
    rules = [r for r in RULES if only is None or r[0] in only]
    selects = [h for h in (hits(r[0]) for r in rules) if h]
    if not selects:
        selects = [f"SELECT site_id, 0 AS check_id, 0 AS page_seq, 0 AS ord, '' AS url, 0 AS n, {_NOPS} FROM site WHERE false"]
    values = ", ".join(
        f"({i}, {_literal(category(i))}, {_literal(n)}, {_literal(s)}, {_literal(rec)})" for i, n, s, _, rec in rules
    )
    return f"""{S.FEATURES},{LINKS},
rules(check_id, category, check_name, severity, recommendation) AS (VALUES {values}),
hits AS ({' UNION ALL BY NAME '.join(selects)}),
agg AS (SELECT site_id, check_id, sum(n)::BIGINT AS affected_count, (sum(metric) // count(*))::BIGINT AS average_ttfb_ms,
  array_to_string((list(url ORDER BY ord, page_seq, url) FILTER (url IS NOT NULL))[1:50], chr(10)) AS urls FROM hits GROUP BY ALL),
checks AS (SELECT site_id, check_id, category, check_name, coalesce(affected_count, 0) = 0 AS passed, severity,
  coalesce(affected_count, 0) AS affected_count, coalesce(urls, '') AS urls, average_ttfb_ms,
  recommendation || CASE WHEN average_ttfb_ms IS NULL THEN '' ELSE ' Current average: ' || average_ttfb_ms || 'ms.' END AS recommendation
  FROM site CROSS JOIN rules LEFT JOIN agg USING (site_id, check_id))"""


SCORE = """greatest(0, least(100, round_even(
  sum(CASE WHEN passed THEN w ELSE 0 END) / sum(w) * 100
  - least(10, sum(CASE WHEN NOT passed AND affected_count > 5 THEN least(1.0::DOUBLE, affected_count / 20.0::DOUBLE) ELSE 0 END)), 0)))::INT"""
WEIGHTED = "(SELECT *, (CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 2.5 WHEN 'medium' THEN 1.5 ELSE 1 END)::DOUBLE AS w FROM checks)"
