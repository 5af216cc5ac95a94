"""Nothing of a page is cut, references are decoded once, near copies are all found, folders are shared."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from siteprism import common
from siteprism.functions import html as H
from siteprism.operators import duplicates as N
from siteprism.sources.io import sitemap_urls


@pytest.mark.parametrize(
    "raw, text",
    [
        ("a &#1114112; b", "a � b"), ("&#55296;|&#xDFFF;|&#0;", "�|�|�"), ("&#38;lt;", "&lt;"), ("&amp;amp;", "&amp;"),
        ("&#x2014;&#X2014;", "——"), ("&eacute;&Eacute;&apos;&nbsp;", "éÉ'\xa0"), ("&nosuch; & &;", "&nosuch; & &;"), ("&#128512;", "😀"),
        ("&#000000000065;", "A"), ("&#99999999999999999999;", "�"), ("plain", "plain"), ("", ""), (None, None),
    ],
)
def test_references(spark, raw, text):
    assert spark.createDataFrame([(raw,)], "x string").select(H.unescape(F.col("x"))).first()[0] == text


def test_a_bad_reference_leaves_the_job_alive(spark):
    page = spark.createDataFrame([("<title>a &#1114112; b</title><body>&#55296;</body>",)], "html string")
    assert page.select(H.title(F.col("html")), H.visible_text(F.col("html"))).first() is not None


def test_large_page(spark):
    body = "".join(f'<a href="/p{i}">{"x" * 150}{i}</a><a href="https://other.test/{i}">o</a><img src="/i{i}.png">' for i in range(250))
    body += "".join(f"<h2>h{i}</h2><h3>k{i}</h3>" for i in range(40))
    rows = spark.createDataFrame([("https://site.test/", "site.test", f"<html><body>{body}</body></html>")], "url string, site_id string, html string")
    links = H.all_links(F.col("html"), F.col("url"), F.col("site_id"))
    got = rows.select(
        F.size(H.split_links(links, True)), F.size(H.split_links(links, False)), F.size(H.images(F.col("html"), F.col("url"))),
        F.size(H.headings(F.col("html"), "h2")), F.length(H.split_links(links, True)[0]["text"]),
    ).first()
    assert tuple(got) == (250, 250, 250, 40, 151)


def test_planted_near_copies_behind_look_alikes(spark):
    """40 pages that share navigation come first; 40 near copies of 40 others stand behind them."""
    rng = random.Random(3)
    nav = " ".join(f"nav{i}" for i in range(60))
    pages = []
    for i in range(40):
        pages.append((i, nav + " " + " ".join(f"u{i}x{rng.randint(0, 10**6)}" for _ in range(40))))
    for i in range(40):
        base = [f"t{i}x{j}" for j in range(120)]
        pages.append((100 + 2 * i, nav + " " + " ".join(base)))
        base[rng.randrange(120)] = "changed"
        pages.append((101 + 2 * i, nav + " " + " ".join(base)))
    rows = spark.createDataFrame([("s", i, str(i), t) for i, t in pages], "site_id string, page_seq long, url string, text_content string")
    got = {r.page_seq: int(r.near_duplicate_of) for r in N.near_duplicates(rows).collect()}
    assert got == {101 + 2 * i: 100 + 2 * i for i in range(40)}


def test_copies_name_the_earliest(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = spark.createDataFrame([("s", i, str(i), t) for i, t in [(5, text), (3, text + " x"), (9, text), (7, "other words here"), (8, None)]], "site_id string, page_seq long, url string, text_content string")
    assert {r.page_seq: r.near_duplicate_of for r in N.near_duplicates(rows).collect()} == {5: "3", 9: "3"}


def test_a_cluster_needs_a_shared_folder(monkeypatch, spark):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError):
        common.stage_dir(Session())


def test_sitemaps_of_six_levels_and_cycles(spark):
    loc = lambda *urls: "".join(f"<url><loc>{u}</loc></url>" for u in urls)
    docs = [(f"https://x/{i}.xml", loc(f"https://x/{i + 1}.xml", f"https://x/p{i}", "https://x/0.xml")) for i in range(6)]
    documents = spark.createDataFrame([*docs, ("https://x/6.xml", loc("https://x/p6", "https://x/3.xml"))], "url string, xml string")
    roots = spark.createDataFrame([("s", "https://x/0.xml"), ("t", "https://x/5.xml")], "site_id string, url string")
    found = lambda **kw: sorted(tuple(r) for r in sitemap_urls(documents, roots, **kw).collect())
    expected = [("s", f"https://x/p{i}", i) for i in range(7)]
    expected += [("t", f"https://x/p{i}", {5: 0, 6: 1, 0: 1, 3: 2, 1: 2, 4: 3, 2: 3}[i]) for i in range(7)]
    assert found() == sorted(expected)
    assert found(max_depth=1) == sorted(x for x in expected if x[2] <= 1)


def test_stored_objects(spark, tmp_path):
    from siteprism.sources import io as IO

    html = {"https://x.test/a": "<p>one\n\ntwo\n", "https://x.test/b": "", "https://x.test/ü": "<p>日本 & é</p>"}
    pages = spark.createDataFrame([*html.items(), ("https://x.test/none", None)], "url string, html string")
    IO.write_html(pages, f"{tmp_path}/objects")
    (tmp_path / "objects" / "plain.html").write_text("<b>line\n</b>\n")
    got = {r.storage_key: r.html for r in IO.read_html(spark, f"{tmp_path}/objects").collect()}
    keys = {r.url: r.k for r in pages.select("url", IO.storage_key(F.col("url")).alias("k")).collect()}
    assert got == {keys[u]: h for u, h in html.items()} | {"plain": "<b>line\n</b>\n"}


def test_every_reference_by_name(spark):
    """All names of the standard, with and without ';', as the standard library decodes texts; attributes are stricter."""
    import html
    from html.entities import html5

    texts = [f"a &{n} b &{n}x &{n}=1" for n in html5] + ["&copy2024", "&notit;", "&unknown; & &", "&#65;&#x42;&amp;lt;"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", H.unescape(F.col("t")).alias("d"), H.unescape(F.col("t"), True).alias("a"))
    for r in rows.collect():
        assert r.d == html.unescape(r.t), r.t
    strict = {r.t: r.a for r in rows.collect()}
    assert (strict["&copy2024"], strict["&notit;"]) == ("&copy2024", "&notit;")
    assert strict["a &copy b &copyx &copy=1"] == "a © b &copyx &copy=1" and strict["a &copy; b &copy;x &copy;=1"] == "a © b ©x ©=1"
