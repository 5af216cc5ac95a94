"""HTML extraction and URL resolution on hand-made input."""

from __future__ import annotations

from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from siteprism.functions import html as H
from siteprism.functions import text as X
from siteprism.functions import urls as U

PAGE = """<!doctype html><html lang="en"><head><title> Oak &amp; Ash &#233; </title>
<meta name="description" content="All about wood"><meta name='robots' content='NOINDEX'>
<meta property="og:title" content="first"><meta property="og:title" content="last">
<link rel="canonical" href="/home"><link rel="alternate" hreflang="de" href="/de">
<script>var a = "<p>no</p>";</script><script type="application/ld+json">[{"@type":"Organization","address":"x"},{"@type":"Article","headline":"h"}]</script>
<script type="application/ld+json">{oops</script></head>
<body><h1>Main <em>title</em></h1><h2>a</h2><!-- <p>hidden</p> -->
<a href="sub/x">sub</a><a href="#no">no</a><a href="//other.org/y" rel="nofollow noopener"> out </a><a href="mailto:x@y.z">m</a>
<img src="i.png" alt=""><img data-src="/j.png" width="3"><p>two words</p></body></html>"""


@pytest.fixture(scope="module")
def row(spark):
    df = spark.createDataFrame([("https://www.wood.com/dir/page?q=1", PAGE)], "url string, html string")
    return H.extract_page(df).first()


def test_head(row):
    assert row.title == "Oak & Ash é"
    assert (row.meta_description, row.canonical_url, row.html_lang) == ("All about wood", "/home", "en")
    assert row.noindex and not row.nofollow
    assert row.open_graph == {"og:title": "last"}
    assert [(h.lang, h.url) for h in row.hreflang] == [("de", "/de")]


def test_body(row):
    assert row.h1 == ["Maintitle"]
    assert [x.url for x in row.internal_links] == ["https://www.wood.com/dir/sub/x"]
    assert [(x.url, x.text, x.nofollow) for x in row.external_links] == [("https://other.org/y", "out", True)]
    assert [(i.url, i.alt, i.width) for i in row.images] == [("https://www.wood.com/dir/i.png", "", None), ("https://www.wood.com/j.png", "", "3")]
    assert row.text_content == "Oak & Ash é Main title a sub no out m two words"
    assert row.word_count == 13


def test_json_ld(row):
    assert [(s.type, s.has_address) for s in row.structured_data] == [("Organization", True), ("Article", False)]
    assert len(row.schema_errors) == 1


@pytest.mark.parametrize(
    "ref", ["x", "./x", "../x", "../../../x", "/a/../b/./c", "?p=2", "//h.org/z", "https://q.org", "/", "a/", "..", ".", "x#f", "/%20?x=/../y"]
)
def test_resolve(spark, ref):
    base = "https://s.org/one/two/three.html?q=1#frag"
    got = spark.createDataFrame([(base, ref)], "b string, r string").select(U.resolve(F.col("b"), F.col("r"))).first()[0]
    assert got == urljoin(base, ref)


def test_spa(spark):
    docs = [
        ('<html><body><div id="root"><div>x</div></div></body></html>', "", ["Empty or minimal root container element"]),
        ('<html><body><div data-reactroot id="root"><p>' + "y" * 200 + "</p></div></body></html>", "react", ["React root element detected"]),
        ('<html><body><div id="app"><div></div>' + "z" * 150 + "</div></body></html>", "vue", ["Vue.js markers detected"]),
    ]
    df = spark.createDataFrame([(d,) for d, *_ in docs], "html string").select(H.spa(F.col("html")).alias("s"))
    assert [(r.s.framework, r.s.reasons) for r in df.collect()] == [(f, r) for _, f, r in docs]


def test_text(spark):
    df = spark.createDataFrame([("Hello  World — Déjà vu! x",)], "t string")
    r = df.select(X.word_count(F.col("t")).alias("n"), X.slug(F.col("t")).alias("s"), X.truncate(F.col("t"), 8).alias("c")).first()
    assert (r.n, r.s, r.c) == (6, "hello-world-déjà-vu-x", "Hello...")
