"""HTML → page columns with built-in regex expressions.

The tag grammar lives here and nowhere else.  Patterns stay in the subset that
Java and RE2 read the same way.  Known limit: an attribute value with a raw
'>' ends the tag early.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteprism.common import let
from siteprism.functions import text as X
from siteprism.functions import urls as U

# Character references by name, from the standard library's list of the HTML standard; some count without their ';' too.
ENTITIES = {n[:-1]: v for n, v in sorted(html5.items()) if n.endswith(";")}
BARE = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))

BLOCKS = r"(?is)<(?:script\b[^>]*>.*?</script|style\b[^>]*>.*?</style|template\b[^>]*>.*?</template)\s*>|<!--.*?-->"

_REFERENCES = r"(&#[0-9]+;|&#[xX][0-9a-fA-F]+;|&[A-Za-z][A-Za-z0-9]*;?=?|[^&]+|&)"
_NAMED = json.dumps(ENTITIES, ensure_ascii=True)


def _code_point(digits: Column, base: int) -> Column:
    """The character of a numeric reference; U+FFFD for 0, surrogates and whatever lies beyond U+10FFFF."""
    bare = F.regexp_replace(digits, "^0+", "")
    code = F.when(F.length(bare).between(1, 7), F.conv(bare, base, 10).cast("bigint")).otherwise(0)
    good = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    safe = F.when(good, code).otherwise(0xFFFD)
    return F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")


def _reference(piece: Column, attribute: bool) -> Column:
    """One piece of a text: a reference becomes its character, anything else (unknown names too) stays.

    A name without its ';' counts where it may: the longest one that the piece begins with, inside attributes only the
    whole piece, and not before '='.
    """
    name = F.regexp_extract(piece, r"^&([A-Za-z][A-Za-z0-9]*);", 1)
    named = F.from_json(F.lit(_NAMED), "map<string,string>")
    bare = F.regexp_extract(piece, rf"^&({'|'.join(BARE)}){'$' if attribute else ''}", 1)
    return (
        F.when(~piece.startswith("&"), piece)
        .when(piece == "&amp;", "&")
        .when(piece.rlike("^&#[0-9]+;$"), _code_point(F.regexp_extract(piece, "([0-9]+)", 1), 10))
        .when(piece.rlike("^&#[xX]"), _code_point(F.regexp_extract(piece, "[xX]([0-9a-fA-F]+)", 1), 16))
        .when(name != "", F.coalesce(
            F.concat(F.try_element_at(named, name), F.when(piece.endswith("="), "=").otherwise("")),
            *([] if attribute else [_bare_end(piece, bare, named)]), piece,
        ))
        .otherwise(F.coalesce(_bare_end(piece, bare, named), piece))
    )


def _bare_end(piece: Column, bare: Column, named: Column) -> Column:
    """The character of the name without ';' that a piece begins with, and the rest of the piece; NULL where there is none."""
    return F.when(bare != "", F.concat(F.try_element_at(named, bare), F.substring(piece, F.length(bare) + 2, F.length(piece))))


def unescape(c: Column, attribute: bool = False) -> Column:
    """Character references to characters, each once, from left to right; the work is skipped where there is no '&'."""
    pieces = lambda x: F.array_join(F.transform(F.regexp_extract_all(x, F.lit(_REFERENCES), 1), lambda p: _reference(p, attribute)), "")
    return let(c, lambda x: F.when(x.contains("&"), pieces(x)).otherwise(x))


def attr(tag: Column, name: str) -> Column:
    """Value of an attribute of one opening tag; '' when absent."""
    raw = F.regexp_extract(tag, rf"(?i)\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
    return unescape(F.regexp_replace(raw, r"^[\"']|[\"']$", ""), True)


def has_attr(tag: Column, name: str) -> Column:
    return tag.rlike(rf"(?i)\s{name}(\s|=|>|/)")


def tags(html: Column, name: str) -> Column:
    """All opening tags of one element."""
    return F.regexp_extract_all(html, F.lit(rf"(?i)(<{name}(?:\s[^>]*)?>)"), 1)


def inner_text(markup: Column) -> Column:
    """Text of a fragment, every text node stripped, joined without a gap."""
    return unescape(X.strip(F.regexp_replace(markup, r"\s*<[^>]*>\s*", "")))


def headings(html: Column, level: str) -> Column:
    return F.transform(
        F.regexp_extract_all(html, F.lit(rf"(?is)<{level}(?:\s[^>]*)?>(.*?)</{level}\s*>"), 1), inner_text
    )


def title(html: Column) -> Column:
    return inner_text(F.regexp_extract(html, r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>", 1))


def _first(tag_array: Column, keep: Callable[[Column], Column]) -> Column:
    return F.try_element_at(F.filter(tag_array, keep), F.lit(1))


def meta_tags(html: Column) -> Column:
    """All <meta> tags as {name, property, content}, in page order."""
    return F.transform(tags(html, "meta"), lambda t: F.struct(*[attr(t, a).alias(a) for a in ("name", "property", "content")]))


def meta_content(html: Column, name: str, metas: Column | None = None) -> Column:
    """content of the first <meta name=…>, '' when there is none; `metas` are the page's :func:`meta_tags` where they are at hand."""
    first = _first(meta_tags(html) if metas is None else metas, lambda m: m["name"] == name)
    return F.coalesce(first["content"], F.lit(""))


def meta_map(html: Column, key_attr: str, prefix: str, metas: Column | None = None) -> Column:
    """{key: content} over <meta> tags whose key starts with prefix; last one wins."""
    found = F.filter(meta_tags(html) if metas is None else metas, lambda m: m[key_attr].startswith(prefix))
    empty = F.create_map().cast("map<string,string>")
    return F.aggregate(
        found,
        empty,
        lambda acc, m: F.map_concat(F.map_filter(acc, lambda k, _: k != m[key_attr]), F.create_map(m[key_attr], m["content"])),
    )


def rel_tokens(tag: Column) -> Column:
    return F.split(F.lower(X.strip(attr(tag, "rel"))), r"\s+")


def link_tags(html: Column) -> Column:
    """All <link> tags as {rel (tokens), href, lang (NULL without hreflang)}, in page order."""
    return F.transform(
        tags(html, "link"),
        lambda t: F.struct(rel_tokens(t).alias("rel"), attr(t, "href").alias("href"), F.when(has_attr(t, "hreflang"), attr(t, "hreflang")).alias("lang")),
    )


def _with_rel(html: Column, links: Column | None, rel: str) -> Column:
    return F.filter(link_tags(html) if links is None else links, lambda x: F.array_contains(x["rel"], rel))


def canonical(html: Column, links: Column | None = None) -> Column:
    """href of the first canonical link, '' without one; `links` are the page's :func:`link_tags` where they are at hand."""
    return F.coalesce(F.try_element_at(_with_rel(html, links, "canonical"), F.lit(1))["href"], F.lit(""))


def hreflang(html: Column, links: Column | None = None) -> Column:
    found = F.filter(_with_rel(html, links, "alternate"), lambda x: x["lang"].isNotNull())
    return F.transform(found, lambda x: F.struct(x["lang"].alias("lang"), x["href"].alias("url")))


def stylesheets_count(html: Column, links: Column | None = None) -> Column:
    return F.size(_with_rel(html, links, "stylesheet"))


def all_links(html: Column, base: Column, site_host: Column) -> Column:
    """Every usable <a href> as {url, text, nofollow, internal}, in page order."""
    anchors = F.regexp_extract_all(html, F.lit(r"(?is)(<a\s[^>]*>.*?</a\s*>)"), 1)

    def parts(a: Column) -> Column:
        tag = F.regexp_extract(a, r"(?is)^(<a\s[^>]*>)", 1)
        return F.struct(
            attr(tag, "href").alias("href"),
            inner_text(a).alias("text"),
            F.array_contains(rel_tokens(tag), "nofollow").alias("nofollow"),
        )

    usable = F.filter(
        F.transform(anchors, parts),
        lambda x: (x["href"] != "") & ~x["href"].rlike(r"^(#|mailto:|tel:)"),
    )
    absolute = F.transform(
        usable,
        lambda x: F.struct(U.resolve(base, x["href"]).alias("url"), x["text"].alias("text"), x["nofollow"].alias("nofollow")),
    )
    web = F.filter(absolute, lambda x: U.scheme(x["url"]).isin("http", "https"))
    return F.transform(
        web,
        lambda x: F.struct(
            x["url"].alias("url"), x["text"].alias("text"), x["nofollow"].alias("nofollow"),
            U.is_internal(U.host(x["url"]), site_host).alias("internal"),
        ),
    )


def split_links(links: Column, internal: bool) -> Column:
    keep = F.filter(links, lambda x: x["internal"] if internal else ~x["internal"])
    bare = F.transform(
        keep, lambda x: F.struct(x["url"].alias("url"), x["text"].alias("text"), x["nofollow"].alias("nofollow"))
    )
    return bare


def images(html: Column, base: Column) -> Column:
    """<img> with a src or data-src: absolute URL, alt, width, height (NULL if absent)."""
    def parts(t: Column) -> Column:
        src = attr(t, "src")
        return F.struct(
            let(src, lambda x: F.when(x != "", x).otherwise(attr(t, "data-src"))).alias("src"),
            attr(t, "alt").alias("alt"),
            F.when(has_attr(t, "width"), attr(t, "width")).alias("width"),
            F.when(has_attr(t, "height"), attr(t, "height")).alias("height"),
        )

    found = F.filter(F.transform(tags(html, "img"), parts), lambda x: x["src"] != "")
    return F.transform(
        found,
        lambda x: F.struct(
            U.resolve(base, x["src"]).alias("url"), x["alt"].alias("alt"),
            x["width"].alias("width"), x["height"].alias("height"),
        ),
    )


def visible_text(html: Column) -> Column:
    """Text nodes stripped and joined with one space; scripts, styles, comments out."""
    shown = F.regexp_replace(html, BLOCKS, " ")
    return unescape(X.strip(F.regexp_replace(shown, r"\s*(?:<[^>]*>\s*)+", " ")))


def json_ld_blocks(html: Column) -> Column:
    return F.regexp_extract_all(
        html, F.lit(r"(?is)<script\s[^>]*application/ld\+json[^>]*>(.*?)</script\s*>"), 1
    )


def _is_json(c: Column) -> Column:
    return F.try_parse_json(c).isNotNull()


def structured_data(html: Column) -> Column:
    """JSON-LD objects as {type, keys, has_address, json}; lists flattened, bad JSON skipped."""
    good = F.filter(json_ld_blocks(html), lambda b: (X.strip(b) != "") & _is_json(b))
    objects = F.flatten(
        F.transform(
            good,
            lambda b: F.when(
                X.strip(b).startswith("["),
                F.coalesce(F.from_json(b, "array<string>"), F.array().cast("array<string>")),
            ).otherwise(F.array(X.strip(b))),
        )
    )

    def describe(o: Column) -> Column:
        address = F.get_json_object(o, "$.address")
        return F.struct(
            F.get_json_object(o, "$['@type']").alias("type"),
            F.coalesce(F.json_object_keys(o), F.array().cast("array<string>")).alias("keys"),
            F.coalesce(~address.isin("", "null", "{}", "[]", "false", "0"), F.lit(False)).alias("has_address"),
            o.alias("json"),
        )

    return F.transform(objects, describe)


def schema_errors(html: Column) -> Column:
    """JSON-LD blocks that do not parse."""
    return F.filter(json_ld_blocks(html), lambda b: (X.strip(b) == "") | ~_is_json(b))


def html_lang(html: Column) -> Column:
    return F.coalesce(attr(F.try_element_at(tags(html, "html"), F.lit(1)), "lang"), F.lit(""))


def script_sources(html: Column) -> Column:
    return F.filter(F.transform(tags(html, "script"), lambda t: attr(t, "src")), lambda s: s != "")


def third_party_scripts(html: Column, site_host: Column, sources: Column | None = None) -> Column:
    """External scripts from a host that is not the site's own."""
    return F.size(
        F.filter(
            script_sources(html) if sources is None else sources,
            lambda s: s.rlike(r"^(https?:)?//")
            & ~U.is_internal(U.host(F.regexp_replace(s, "^//", "http://")), site_host),
        )
    )


def render_blocking(html: Column) -> Column:
    """Stylesheets plus external scripts without async/defer inside <head>."""
    head = F.regexp_extract(html, r"(?is)<head(?:\s[^>]*)?>(.*?)</head\s*>", 1)
    scripts = F.filter(
        tags(head, "script"), lambda t: (attr(t, "src") != "") & ~has_attr(t, "async") & ~has_attr(t, "defer")
    )
    return stylesheets_count(head) + F.size(scripts)


def has_mixed_content(html: Column, url: Column, links: Column | None = None) -> Column:
    """An https page loading a resource over http:// (links to pages do not count)."""
    src = html.rlike(r"(?i)<(?:img|script|iframe|source|video|audio|embed)\s[^>]*\ssrc\s*=\s*[\"']?http://") | html.rlike(
        r"(?i)<(?:img|script|iframe|source|video|audio|embed)\ssrc\s*=\s*[\"']?http://"
    )
    sheet = F.exists(_with_rel(html, links, "stylesheet"), lambda x: x["href"].startswith("http://"))
    return url.startswith("https://") & (src | sheet)


def forms_without_labels(html: Column) -> Column:
    """More visible inputs than <label> or aria-label(ledby) attributes."""
    inputs = F.filter(
        F.concat(tags(html, "input"), tags(html, "select"), tags(html, "textarea")),
        lambda t: ~F.lower(attr(t, "type")).isin("hidden", "submit", "button", "image", "reset"),
    )
    unlabelled = F.filter(inputs, lambda t: ~t.rlike(r"(?i)\saria-label(ledby)?\s*="))
    return F.size(unlabelled) > F.size(tags(html, "label"))


def has_skip_link(html: Column) -> Column:
    return html.rlike(r"(?is)<a\s[^>]*href\s*=\s*[\"']?#[^>]*>[^<]*skip\s+(?:to|navigation)")


def has_rel(html: Column, rel: str, rels: Column | None = None) -> Column:
    return F.exists(link_rels(html) if rels is None else rels, lambda r: F.array_contains(r, rel))


def link_rels(html: Column, links: Column | None = None) -> Column:
    """The rel tokens of all <link> and <a> tags."""
    own = F.transform(link_tags(html) if links is None else links, lambda x: x["rel"])
    return F.concat(own, F.transform(F.filter(tags(html, "a"), lambda t: has_attr(t, "rel")), rel_tokens))


def has_flash(html: Column) -> Column:
    return html.rlike(r"(?i)application/x-shockwave-flash|\.swf\b")


def requires_plugin(html: Column) -> Column:
    return html.rlike(r"(?i)<(?:object|embed|applet)\b")


# ----------------------------------------------------------------- SPA markers


@F.pandas_udf(T.IntegerType())
def _root_text_length(html: pd.Series) -> pd.Series:
    """Stripped text length under the first id=root (else id=app) element."""
    from html.parser import HTMLParser

    void = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    class Root(HTMLParser):
        def __init__(self, wanted: str) -> None:
            super().__init__()
            self.wanted, self.depth, self.size, self.seen, self.skip = wanted, 0, 0, False, False

        def handle_starttag(self, tag, attrs):
            self.skip = tag in ("script", "style", "template")
            if self.depth:
                self.depth += tag not in void
            elif not self.seen and dict(attrs).get("id") == self.wanted:
                self.seen, self.depth = True, int(tag not in void)

        def handle_endtag(self, tag):
            self.skip = False
            if self.depth and tag not in void:
                self.depth -= 1

        def handle_data(self, data):
            if self.depth and not self.skip:
                self.size += len(data.strip())

    def measure(doc: str | None) -> int | None:
        for wanted in ("root", "app") if doc else ():
            p = Root(wanted)
            p.feed(doc)
            if p.seen:
                return p.size
        return None

    return html.map(measure, na_action="ignore")


def _id(html: Column, value: str) -> Column:
    return html.rlike(rf"(?i)<[a-z][^>]*\sid\s*=\s*[\"']?{value}[\"'\s>]")


def spa(html: Column) -> Column:
    """{needs_js, framework, reasons[]} from markers in the raw HTML."""
    body = F.regexp_replace(F.regexp_extract(html, r"(?is)<body(?:\s[^>]*)?>(.*)$", 1), BLOCKS, " ")
    body_len = F.length(inner_text(body))
    n_scripts = F.size(script_sources(html))
    react = html.rlike(r"(?i)<[a-z][^>]*\sdata-react(root|id)\b")
    vue = _id(html, "app") | html.rlike(r"(?i)<[a-z][^>]*\sdata-v-[\s=>]")
    angular = html.rlike(r"(?i)<[a-z][^>]*\s(ng-version|_ngcontent-)[\s=>]")
    nextjs, nuxt = _id(html, "__next"), _id(html, "__nuxt")
    root_len = _root_text_length(F.when(_id(html, "root") | _id(html, "app"), html))
    noscript = F.lower(inner_text(F.regexp_extract(html, r"(?is)<noscript(?:\s[^>]*)?>(.*?)</noscript\s*>", 1)))
    loading = html.rlike(r"(?i)<[a-z][^>]*\sclass\s*=\s*(?:\"[^\"]*loading|'[^']*loading|[^\s\"'>]*loading)")
    framework = (
        F.when(nuxt, "nuxt").when(nextjs, "nextjs").when(angular, "angular")
        .when(react, "react").when(vue, "vue").otherwise("")
    )
    # Reason texts, in the order they are reported.
    reasons = F.array_compact(
        F.array(
            F.when(react, "React root element detected"),
            F.when(vue, "Vue.js markers detected"),
            F.when(angular, "Angular markers detected"),
            F.when(nextjs, "Next.js root element detected"),
            F.when(nuxt, "Nuxt.js root element detected"),
            F.when(
                (body_len < 300) & (n_scripts > 5),
                F.format_string("Minimal body content (%d chars) with %d external scripts", body_len, n_scripts),
            ),
            F.when(root_len < 100, "Empty or minimal root container element"),
            F.when(loading, "Loading indicators found in HTML"),
            F.when(noscript.contains("javascript") | noscript.contains("enable"), "Noscript tag suggests JS requirement"),
        )
    )
    return F.struct((F.size(reasons) > 0).alias("needs_js"), framework.alias("framework"), reasons.alias("reasons"))


def js_decision(pages: DataFrame, min_words: int = 50) -> DataFrame:
    """Both needs-JS rules: word count first, and SPA first with script names.

    Reads columns ``html`` and ``word_count``.
    """
    p = pages.withColumn("_spa", spa(F.col("html")))
    s, n = F.col("_spa"), F.col("word_count")
    srcs = F.transform(script_sources(F.col("html")), F.lower)
    names = F.array(*[F.lit(x) for x in ("react", "vue", "angular", "next", "nuxt", "gatsby", "svelte")])
    hit = F.try_element_at(
        F.flatten(F.transform(srcs, lambda u: F.filter(names, lambda f: u.contains(f)))), F.lit(1)
    )
    first = F.try_element_at(s["reasons"], F.lit(1))
    rule_a = F.when(n < min_words, F.format_string("Low word count (%d)", n)).when(
        s["needs_js"], F.concat(F.lit("SPA detected ("), s["framework"], F.lit("): "), F.coalesce(first, F.lit("unknown")))
    )
    rule_b = (
        F.when(
            s["needs_js"],
            F.concat(
                F.lit("SPA detected ("),
                F.when(s["framework"] == "", "unknown").otherwise(s["framework"]),
                F.lit("): "), F.array_join(F.slice(s["reasons"], 1, 2), ", "),
            ),
        )
        .when(n < min_words, F.format_string("Very low word count (%d), may need JS rendering", n))
        .when(hit.isNotNull(), F.concat(F.lit("JavaScript framework detected in script: "), hit))
    )
    return p.select(
        "*",
        rule_a.isNotNull().alias("needs_js"), F.coalesce(rule_a, F.lit("")).alias("needs_js_reason"),
        rule_b.isNotNull().alias("should_render"),
        F.coalesce(rule_b, F.lit("No JS rendering needed")).alias("should_render_reason"),
    ).drop("_spa")


# ------------------------------------------------------------------ whole page


# Intermediate columns several features are cut from, in two layers: the second reads the first.
_STEPS: list[dict[str, Callable[[Column, Column, Column], Column]]] = [
    {
        "_links": lambda html, url, host: all_links(html, url, host),
        "_metas": lambda html, url, host: meta_tags(html),
        "_link_tags": lambda html, url, host: link_tags(html),
        "_scripts": lambda html, url, host: script_sources(html),
        "text_content": lambda html, url, host: visible_text(html),
    },
    {
        "meta_robots": lambda html, url, host: meta_content(html, "robots", F.col("_metas")),
        "_rels": lambda html, url, host: link_rels(html, F.col("_link_tags")),
    },
]

# Feature → (steps it needs, expression).
_FEATURES: dict[str, tuple[list[str], Callable[[Column, Column, Column], Column]]] = {
    "title": ([], lambda html, url, host: title(html)),
    "meta_description": (["_metas"], lambda html, url, host: meta_content(html, "description", F.col("_metas"))),
    "meta_robots": (["_metas", "meta_robots"], lambda html, url, host: F.col("meta_robots")),
    "canonical_url": (["_link_tags"], lambda html, url, host: canonical(html, F.col("_link_tags"))),
    "h1": ([], lambda html, url, host: headings(html, "h1")),
    "h2": ([], lambda html, url, host: headings(html, "h2")),
    "h3": ([], lambda html, url, host: headings(html, "h3")),
    "internal_links": (["_links"], lambda html, url, host: split_links(F.col("_links"), True)),
    "external_links": (["_links"], lambda html, url, host: split_links(F.col("_links"), False)),
    "images": ([], lambda html, url, host: images(html, url)),
    "text_content": (["text_content"], lambda html, url, host: F.col("text_content")),
    "word_count": (["text_content"], lambda html, url, host: X.word_count(F.col("text_content"))),
    "text_content_hash": (["text_content"], lambda html, url, host: F.md5("text_content")),
    "structured_data": ([], lambda html, url, host: structured_data(html)),
    "schema_errors": ([], lambda html, url, host: schema_errors(html)),
    "open_graph": (["_metas"], lambda html, url, host: meta_map(html, "property", "og:", F.col("_metas"))),
    "twitter_cards": (["_metas"], lambda html, url, host: meta_map(html, "name", "twitter:", F.col("_metas"))),
    "hreflang": (["_link_tags"], lambda html, url, host: hreflang(html, F.col("_link_tags"))),
    "html_lang": ([], lambda html, url, host: html_lang(html)),
    "has_viewport_meta": (["_metas"], lambda html, url, host: F.exists("_metas", lambda m: m["name"] == "viewport")),
    "viewport_content": (["_metas"], lambda html, url, host: meta_content(html, "viewport", F.col("_metas"))),
    "noindex": (["_metas", "meta_robots"], lambda html, url, host: F.lower("meta_robots").contains("noindex")),
    "nofollow": (["_metas", "meta_robots"], lambda html, url, host: F.lower("meta_robots").contains("nofollow")),
    "scripts_count": (["_scripts"], lambda html, url, host: F.size("_scripts")),
    "stylesheets_count": (["_link_tags"], lambda html, url, host: stylesheets_count(html, F.col("_link_tags"))),
    "render_blocking_resources": ([], lambda html, url, host: render_blocking(html)),
    "third_party_scripts": (["_scripts"], lambda html, url, host: third_party_scripts(html, host, F.col("_scripts"))),
    "has_mixed_content": (["_link_tags"], lambda html, url, host: has_mixed_content(html, url, F.col("_link_tags"))),
    "forms_without_labels": ([], lambda html, url, host: forms_without_labels(html)),
    "has_skip_link": ([], lambda html, url, host: has_skip_link(html)),
    "has_rel_next": (["_link_tags", "_rels"], lambda html, url, host: has_rel(html, "next", F.col("_rels"))),
    "has_rel_prev": (["_link_tags", "_rels"], lambda html, url, host: has_rel(html, "prev", F.col("_rels"))),
    "has_flash": ([], lambda html, url, host: has_flash(html)),
    "requires_plugin": ([], lambda html, url, host: requires_plugin(html)),
    "readability_score": (["text_content"], lambda html, url, host: X.readability(F.col("text_content"))),
}


def extract_page(pages: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Raw pages (``url``, ``html``, optional ``site_host``) → page feature columns.

    A projection over the scan: no shuffle.  ``columns`` limits the features
    that are planned at all.
    """
    html, url = F.col("html"), F.col("url")
    host = F.col("site_host") if "site_host" in pages.columns else U.host(url)
    wanted = [c for c in _FEATURES if columns is None or c in columns]
    needed = {s for c in wanted for s in _FEATURES[c][0]}
    keep = [c for c in pages.columns if c != "html"]
    step = pages
    for layer in _STEPS:
        step = step.select("*", *[make(html, url, host).alias(name) for name, make in layer.items() if name in needed])
    return step.select(*keep, *[_FEATURES[c][1](html, url, host).alias(c) for c in wanted])


def to_storage_row(page: DataFrame) -> DataFrame:
    """Page features as stored rows: h1 is the first heading, '' becomes NULL."""
    texts = [c for c in ("title", "meta_description", "canonical_url", "meta_robots", "html_lang") if c in page.columns]
    out = page.withColumn("h1", F.try_element_at("h1", F.lit(1)))
    return out.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in [*texts, "h1"]})


def light_facts(pages: DataFrame) -> DataFrame:
    """Quick facts of a page by substring tests and tag stripping, no parsing."""
    html, low, url = F.col("html"), F.lower("html"), F.col("url")
    refs = F.filter(
        F.regexp_extract_all(html, F.lit(r"href=[\"']([^\"']+)[\"']"), 1),
        lambda h: ~h.rlike(r"^(#|javascript:)"),
    )
    hosts = F.transform(refs, lambda h: U.host(U.resolve(url, h)))
    imgs = F.regexp_extract_all(low, F.lit(r"(<img[^>]+>)"), 1)
    return pages.select(
        *[c for c in pages.columns if c != "html"],
        F.when(
            html.contains("<title>") & html.contains("</title>"),
            X.strip(F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)),
        ).alias("title"),
        F.when(
            html.rlike(r'(?s)name="description".*?content="'),
            F.regexp_extract(html, r'(?s)name="description".*?content="([^"]*)"', 1),
        ).alias("meta_description"),
        F.regexp_count(low, F.lit("<h1")).alias("h1_count"),
        F.regexp_count(low, F.lit("<h2")).alias("h2_count"),
        F.length(html).alias("content_length"),
        F.size(F.filter(hosts, lambda h: h == U.host(url))).alias("internal_links"),
        F.size(F.filter(hosts, lambda h: (h != "") & (h != U.host(url)))).alias("external_links"),
        F.size(imgs).alias("images_total"),
        F.size(F.filter(imgs, lambda t: ~t.contains("alt=") | t.contains('alt=""'))).alias("images_without_alt"),
        X.word_count(F.regexp_replace(html, r"<[^>]+>", " ")).alias("word_count"),
        low.contains('rel="canonical"').alias("has_canonical"),
        low.contains('name="robots"').alias("has_robots_meta"),
    )


def status_summary(pages: DataFrame, keys: list[str]) -> DataFrame:
    s = F.col("status_code")
    return pages.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(s == 200).alias("ok"),
        F.count_if(s.isin(301, 302)).alias("redirects"),
        F.count_if(s == 404).alias("not_found"),
        F.count_if(F.coalesce(s, F.lit(0)) == 0).alias("errors"),
    )
