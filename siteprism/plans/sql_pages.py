"""SQL twin of :mod:`siteprism.plans.pages` and of the page extraction (DuckDB).

Written from the descriptions of the features, with list comprehensions where
the Spark side uses higher-order functions.  Everything is a CTE prefix.
"""

from __future__ import annotations

WS = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
HOST = "regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)"
ORIGIN = "regexp_extract({u}, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1)"
PATH = "regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def host(u: str) -> str:
    return HOST.format(u=u)


def path(u: str) -> str:
    return PATH.format(u=u)


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def word_list(c: str) -> str:
    return f"[w for w in regexp_split_to_array({c}, '{WS}+') if w <> '']"


def n_words(c: str) -> str:
    return f"len({word_list(c)})"


def unescape(c: str, attribute: bool = False) -> str:
    """Numeric references and the names that the driver tables hold, each piece once from left to right."""
    names = [("&amp;", "&"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&eacute;", "é"), ("&lt;", "<"), ("&notin;", "∉"), ("&NotEqualTilde;", "\u2242\u0338")]
    names += [] if attribute else [("&copy2024", "©2024"), ("&notit;", "¬it;")]
    named = " ".join(f"WHEN '{n}' THEN '{v}'" for n, v in names)
    digits = "ltrim(regexp_extract(r, '([0-9]+)', 1), '0')"
    code = f"CASE WHEN lower(r) = '&#x2014;' THEN 8212 WHEN len({digits}) BETWEEN 1 AND 7 THEN {digits}::BIGINT ELSE 0 END"
    char = f"[chr(CASE WHEN n BETWEEN 1 AND 55295 OR n BETWEEN 57344 AND 1114111 THEN n ELSE 65533 END::INT) for n in [{code}]][1]"
    return (
        f"array_to_string([CASE r {named} ELSE CASE WHEN regexp_matches(r, '^&#([0-9]+|[xX][0-9a-fA-F]+);$') THEN {char} ELSE r END END "
        f"for r in regexp_extract_all({c}, '(&#[0-9]+;|&#[xX][0-9a-fA-F]+;|&[A-Za-z][A-Za-z0-9]*;?=?|[^&]+|&)', 1)], '')"
    )


def attr(tag: str, name: str) -> str:
    raw = f"regexp_extract({tag}, '(?i)\\s{name}\\s*=\\s*(\"[^\"]*\"|''[^'']*''|[^\\s\"''>]+)', 1)"
    return unescape(f"regexp_replace({raw}, '^[\"'']|[\"'']$', '', 'g')", True)


def tags(html: str, name: str) -> str:
    return f"regexp_extract_all({html}, '(?i)(<{name}(?:\\s[^>]*)?>)', 1)"


def inner(c: str) -> str:
    return unescape(strip(f"regexp_replace({c}, '\\s*<[^>]*>\\s*', '', 'g')"))


def headings(level: str) -> str:
    return f"[{inner('x')} for x in regexp_extract_all(html, '(?is)<{level}(?:\\s[^>]*)?>(.*?)</{level}\\s*>', 1)]"


def meta(name: str) -> str:
    return f"coalesce(([{attr('x', 'content')} for x in metas if {attr('x', 'name')} = '{name}'])[1], '')"


def resolve(base: str, ref: str) -> str:
    page = f"regexp_extract({base}, '^([^?#]*)', 1)"
    base_dir = (
        f"CASE WHEN {path(base)} = '' THEN {ORIGIN.format(u=base)} || '/' "
        f"ELSE regexp_extract({page}, '^(.*/)[^/]*$', 1) END"
    )
    return (
        f"CASE WHEN regexp_matches({ref}, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN {ref} "
        f"WHEN starts_with({ref}, '//') THEN regexp_extract({base}, '^([a-zA-Z]+:)', 1) || {ref} "
        f"WHEN starts_with({ref}, '/') THEN {ORIGIN.format(u=base)} || {ref} "
        f"WHEN starts_with({ref}, '?') THEN {page} || {ref} "
        f"ELSE ({base_dir}) || {ref} END"
    )


def is_internal(h: str, site: str) -> str:
    base = f"replace({site}, 'www.', '')"
    return (
        f"({h} <> '' AND ({h} = {base} OR {h} = 'www.' || {base} OR {h} = {site} OR ends_with({h}, '.' || {base})))"
    )


def rel(tag: str) -> str:
    return f"string_split_regex(lower({strip(attr(tag, 'rel'))}), '\\s+')"


def _cases(k: int, *branches: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {b}" for i, b in enumerate(branches))
    return f"CASE page_id % {k} {whens} ELSE '' END"


_VIEW = "'<meta name=\"viewport\" content=\"width=device-width, initial-scale=1\">'"
_LD = "<script type=\"application/ld+json\">"
_HEAD = " || ".join(
    [
        _cases(
            4, "''",
            "'<meta name=\"description\" content=\"' || left(t, 40) || '\">'",
            "'<meta name=\"description\" content=\"' || t || ' ' || t || ' ' || t || '\">'",
            "'<meta content=''' || t || ' / &#x2014; &eacute; &#1114112; &#55296; &#0; &#38;lt; &nosuch; &notin; &NotEqualTilde; &copy2024 ' || t || ''' name=''description''/>'",
        ),
        _cases(9, "'<meta name=\"robots\" content=\"NoIndex, nofollow\">'"),
        _cases(10, "'<meta name=\"viewport\" content=\"width=600\">'", "''", *[_VIEW] * 6),
        _cases(
            6, "''", *["'<link rel=\"canonical\" href=\"' || url || '\">'"] * 3,
            "'<link rel=\"canonical\" href=\"' || url || '/\">'",
            "'<link href=\"https://' || site_id || '/canon\" rel=\"canonical\">'",
        ),
        _cases(
            3, "'<meta property=\"og:title\" content=\"' || t || '\"><meta property=\"og:image\" content=\"/o.png\">'",
            "'<meta property=\"og:title\" content=\"' || t || '\">'",
        ),
        _cases(2, "'<meta name=\"twitter:card\" content=\"summary\"><meta name=\"twitter:site\" content=\"@x\">'"),
        _cases(
            8,
            "'<link rel=\"alternate\" hreflang=\"en\" href=\"' || url || '\"><link rel=\"alternate\" hreflang=\"de\" href=\"/de\">'",
            "'<link rel=\"alternate\" hreflang=\"fr\" href=\"/fr\">'",
        ),
        "repeat('<link rel=\"stylesheet\" href=\"/s.css\">', (page_id % 4)::INT)",
        "repeat('<script src=\"https://cdn.third.test/react.js\"></script>', (page_id % 13)::INT)",
        _cases(
            5, f"'{_LD}{{\"@type\":\"Organization\",\"name\":\"N\",\"address\":\"A 1\"}}</script>'",
            f"'{_LD}{{\"@type\":\"Article\",\"headline\":\"H\",\"datePublished\":\"2024-01-01\"}}</script>'",
            f"'{_LD}[{{\"@type\":\"BreadcrumbList\"}},{{\"@type\":\"Product\",\"name\":\"P\",\"description\":\"D\"}}]</script>'",
            f"'{_LD}{{bad json</script>'",
        ),
        _cases(7, "'<link rel=\"next\" href=\"?p=2\">'", "'<link rel=\"prev\" href=\"?p=1\">'"),
    ]
)
_BODY = " || ".join(
    [
        _cases(3, "'<a href=\"sub/page\">sub</a>'", "'<a href=\"?p=2\"><b>next</b> page</a>'", "'<a href=\"//ext.test/x\">ext</a>'"),
        "'<a href=\"#top\">top</a><a href=\"mailto:a@b.c\">mail</a><a href=\"tel:1\">call</a>'",
        _cases(5, "'<a href=\"#main\">Skip to content</a>'"),
        _cases(
            4, "'<img src=\"/i/a.png\" alt=\"Logo\" width=\"10\" height=\"20\">'",
            "'<img data-src=\"b.png\" alt=\"\" width=\"10\"><img src=\"/c.png\" alt=\"C\" width=\"1\" height=\"1\">'",
            "'<img src=\"http://img.test/d.png\" alt=\"D\" width=\"5\" height=\"5\">'",
        ),
        _cases(3, "'<h2>Part ' || t || '</h2><h3>x</h3>'", "'<h3>alone <i>three</i></h3>'"),
        _cases(11, "'<h1>Second &amp; last &copy2024 &notin; &notit; &NotEqualTilde;</h1>'"),
        _cases(6, "'<form><label>Q</label><input type=\"text\"><input type=\"hidden\"></form>'", "'<form><input type=\"text\"></form>'"),
        _cases(16, "'<object data=\"m.swf\"></object>'", "'<embed src=\"/p.bin\">'"),
        _cases(12, "'<div id=\"root\"></div>'", "'<div id=\"app\">ok</div>'", "'<div id=\"__next\" class=\"is-loading\"></div>'"),
    ]
)

RICH = f"""
raw AS (SELECT *, {host('url')} AS site_id FROM pages),
hubs AS (SELECT site_id, arg_min(url, page_id) AS hub_url, min(page_id) AS hub_id, arg_max(url, page_id) AS tail_url
         FROM raw GROUP BY site_id),
rich0 AS (SELECT raw.*, hub_url, hub_id, tail_url, page_id AS page_seq,
                 regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS t FROM raw JOIN hubs USING (site_id)),
rich AS MATERIALIZED (SELECT * EXCLUDE (html, t),
  replace(replace(html, '</head>', ({_HEAD}) || '</head>'), '</nav>', '</nav>' || ({_BODY})) AS html,
  CASE WHEN page_id % 17 = 0 THEN 404 WHEN page_id % 23 = 0 THEN 301 WHEN page_id % 29 = 0 THEN 500
       WHEN page_id % 31 = 0 THEN 0 WHEN page_id % 37 = 0 THEN 302 ELSE 200 END AS status_code,
  page_id * 37 % 1500 AS load_time_ms, page_id % 7 AS crawl_depth
  FROM rich0),
site AS (SELECT site_id, hub_id, hub_url,
  CASE WHEN hub_id % 2 = 0 THEN hub_url WHEN hub_id % 3 = 0 THEN 'http://' || site_id ELSE 'https://' || site_id END AS base_url
  FROM hubs),
robots AS (SELECT site_id, hub_id % 4 <> 0 AS r_exists, CASE WHEN hub_id % 4 <> 0 THEN
  'User-agent: *' || chr(10) || 'Disallow: /en/' || chr(10) ||
  CASE WHEN hub_id % 3 = 0 THEN 'Disallow: /CSS' || chr(10) || 'Disallow: *.js' || chr(10) ELSE '' END ||
  'Crawl-delay: 3' || chr(10) || 'User-agent: SitePrism' || chr(10) || 'Crawl-delay: ' ||
  CASE WHEN hub_id % 5 = 0 THEN 'soon' ELSE (hub_id % 7)::VARCHAR END || chr(10) || 'Disallow: /de/' || chr(10) || chr(10) ||
  'Sitemap: https://' || site_id || '/sitemap.xml' || chr(10) END AS content FROM site)"""

_ANCHORS = (
    f"[{{'href': {attr('tg', 'href')}, 'text': {inner('x')}, "
    f"'nofollow': list_contains({rel('tg')}, 'nofollow')}} "
    "for x in regexp_extract_all(html, '(?is)(<a\\s[^>]*>.*?</a\\s*>)', 1)]"
).replace("tg", "regexp_extract(x, '(?is)^(<a\\s[^>]*>)', 1)")
_ABS = (
    f"[{{'url': {resolve('url', 'x.href')}, 'text': x.text, 'nofollow': x.nofollow}} "
    "for x in anchors if x.href <> '' AND NOT regexp_matches(x.href, '^(#|mailto:|tel:)')]"
)
_IMGS = (
    f"[{{'src': CASE WHEN {attr('x', 'src')} <> '' THEN {attr('x', 'src')} ELSE {attr('x', 'data-src')} END, "
    f"'alt': {attr('x', 'alt')}, "
    f"'width': CASE WHEN regexp_matches(x, '(?i)\\swidth(\\s|=|>|/)') THEN {attr('x', 'width')} END, "
    f"'height': CASE WHEN regexp_matches(x, '(?i)\\sheight(\\s|=|>|/)') THEN {attr('x', 'height')} END}} "
    f"for x in {tags('html', 'img')}]"
)
_BLOCKS = r"(?is)<(?:script\b[^>]*>.*?</script|style\b[^>]*>.*?</style|template\b[^>]*>.*?</template)\s*>|<!--.*?-->"
_LDJSON = "regexp_extract_all(html, '(?is)<script\\s[^>]*application/ld\\+json[^>]*>(.*?)</script\\s*>', 1)"

FEATURES = RICH + f""",
f1 AS (SELECT *, {tags('html', 'meta')} AS metas, {tags('html', 'link')} AS linktags, {_ANCHORS} AS anchors,
  {_IMGS} AS imgs0, {_LDJSON} AS ld, regexp_extract(html, '(?is)<head(?:\\s[^>]*)?>(.*?)</head\\s*>', 1) AS headhtml,
  [{attr('x', 'src')} for x in {tags('html', 'script')} if {attr('x', 'src')} <> ''] AS srcs FROM rich),
f2 AS (SELECT *, {_ABS} AS abslinks,
  [{{'url': {resolve('url', 'x.src')}, 'alt': x.alt, 'width': x.width, 'height': x.height}} for x in imgs0 if x.src <> ''] AS images,
  {unescape(strip(f"regexp_replace(regexp_replace(html, '{_BLOCKS}', ' ', 'g'), '{chr(92)}s*(?:<[^>]*>{chr(92)}s*)+', ' ', 'g')"))} AS text_content,
  {inner("regexp_extract(html, '(?is)<title(?:" + chr(92) + "s[^>]*)?>(.*?)</title" + chr(92) + "s*>', 1)")} AS title,
  {headings('h1')} AS h1, {headings('h2')} AS h2, {headings('h3')} AS h3,
  {meta('description')} AS meta_description, {meta('robots')} AS meta_robots, {meta('viewport')} AS viewport_content,
  coalesce(([{attr('x', 'href')} for x in linktags if list_contains({rel('x')}, 'canonical')])[1], '') AS canonical_url,
  [{{'lang': {attr('x', 'hreflang')}, 'url': {attr('x', 'href')}}} for x in linktags
    if list_contains({rel('x')}, 'alternate') AND regexp_matches(x, '(?i)\\shreflang=')] AS hreflang,
  coalesce({attr(f"({tags('html', 'html')})[1]", 'lang')}, '') AS html_lang,
  len([1 for x in linktags if list_contains({rel('x')}, 'stylesheet')]) AS stylesheets_count,
  len([1 for x in metas if {attr('x', 'name')} = 'viewport']) > 0 AS has_viewport_meta,
  len(srcs) AS scripts_count,
  len([1 for x in ld if json_valid(x)]) AS ld_good, len([1 for x in ld if NOT json_valid(x)]) AS ld_bad,
  flatten([CASE WHEN starts_with(x, '[') THEN json_extract(x, '$[*]') ELSE [x::JSON] END for x in ld if json_valid(x)]) AS objs
  FROM f1),
feat AS MATERIALIZED (SELECT *,
  [x for x in abslinks if regexp_matches(x.url, '^https?:') AND {is_internal(host('x.url'), 'site_id')}]
    || [{{'url': hub_url, 'text': 'Home', 'nofollow': false}}, {{'url': tail_url, 'text': 'Read More', 'nofollow': true}}] AS internal_links,
  [x for x in abslinks if regexp_matches(x.url, '^https?:') AND NOT {is_internal(host('x.url'), 'site_id')}] AS external_links,
  {n_words('text_content')} AS word_count, md5(text_content) AS text_content_hash,
  contains(lower(meta_robots), 'noindex') AS noindex, contains(lower(meta_robots), 'nofollow') AS nofollow,
  [x->>'$."@type"' for x in objs] AS types,
  stylesheets_count + scripts_count AS render_blocking_resources,
  len([1 for x in srcs if regexp_matches(x, '^(https?:)?//') AND NOT {is_internal(host('x'), 'site_id')}]) AS third_party_scripts,
  starts_with(url, 'https://') AND contains(html, '<img src="http://') AS has_mixed_content,
  contains(html, '<form><input type="text"></form>') AS forms_without_labels,
  contains(html, '>Skip to content</a>') AS has_skip_link,
  contains(html, 'rel="next"') AS has_rel_next, contains(html, 'rel="prev"') AS has_rel_prev,
  contains(html, '.swf') AS has_flash, regexp_matches(html, '<object|<embed') AS requires_plugin
  FROM f2)"""
