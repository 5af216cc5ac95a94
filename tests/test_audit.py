"""Checks, score and lists on the three-page site of FIXTURES.md."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siteprism.operators import audit as A
from siteprism.operators import issues as I
from siteprism.operators import reports as R
from siteprism.sources.io import write_audit

PAGE = """site_id string, page_seq bigint, url string, status_code int, title string, meta_description string, canonical_url string,
h1 array<string>, h2 array<string>, h3 array<string>, internal_links array<struct<url:string,text:string,nofollow:boolean>>,
images array<struct<url:string,alt:string,width:string,height:string>>, word_count int, text_content_hash string,
structured_data array<struct<type:string,keys:array<string>,has_address:boolean,json:string>>, open_graph map<string,string>,
twitter_cards map<string,string>, hreflang array<struct<lang:string,url:string>>, html_lang string, has_viewport_meta boolean,
viewport_content string, noindex boolean, load_time_ms int, response_headers map<string,string>"""
DEFAULT = dict(
    site_id="s", page_seq=0, url="https://example.com", status_code=200, title="Example Website - Home, a good title", meta_description="d" * 100,
    canonical_url="https://example.com", h1=["x"], h2=[], h3=[], internal_links=[], images=[], word_count=500, text_content_hash="h0",
    structured_data=[], open_graph={}, twitter_cards={}, hreflang=[], html_lang="en", has_viewport_meta=True,
    viewport_content="width=device-width", noindex=False, load_time_ms=100, response_headers=None,
)


def run(spark, *overrides, **kw):
    names = [c.split()[0] for c in PAGE.replace("\n", " ").split(", ")]
    rows = [{**DEFAULT, "page_seq": i, **o} for i, o in enumerate(overrides)]
    pages = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], PAGE)
    sites = spark.createDataFrame([("s", "https://example.com")], "site_id string, base_url string")
    return {r.check_id: r for r in A.audit(pages, sites, **kw).collect()}


def test_hundred_rows(spark):
    got = run(spark, {})
    assert sorted(got) == list(range(1, 101))
    assert all(r.passed == (r.affected_count == 0) for r in got.values())


@pytest.mark.parametrize(
    ("check", "page", "severity"),
    [
        (5, {"noindex": True}, "critical"), (11, {"title": ""}, "high"), (11, {"title": None}, "high"), (12, {"title": "Short"}, "medium"),
        (13, {"title": "x" * 61}, "low"), (15, {"meta_description": None}, "high"), (17, {"h1": []}, "high"), (18, {"h1": ["a", "b"]}, "medium"),
        (24, {"load_time_ms": 1500}, "medium"), (28, {"response_headers": {"content-encoding": ""}}, "medium"), (32, {"url": "https://example.com/ü"}, "medium"),
        (51, {"word_count": 150}, "high"), (76, {"html_lang": ""}, "medium"), (81, {"has_viewport_meta": None}, "high"), (91, {"status_code": 404}, "high"),
        (92, {"status_code": 503}, "critical"), (95, {"status_code": 302}, "medium"), (97, {"response_headers": {"x": "y"}}, "low"),
    ],
)
def test_page_check(spark, check, page, severity):
    bad, good = run(spark, page, only=[check])[check], run(spark, {"response_headers": {"content-encoding": "br", "cache-control": "max-age=1"}}, only=[check])[check]
    assert (bad.passed, bad.severity, bad.affected_count) == (False, severity, 1)
    assert good.passed


def test_timeouts_are_no_errors(spark):
    got = run(spark, {"status_code": 0}, {"status_code": None}, only=[91, 92])
    assert got[91].passed and got[92].passed


def test_duplicates_in_group_order(spark):
    got = run(spark, {"url": "a", "title": "T1"}, {"url": "b", "title": "T2"}, {"url": "c", "title": " t1 "}, {"url": "d", "title": "t2"}, {"url": "e", "title": "u"}, only=[14])
    assert got[14].affected_urls == ["a", "c", "b", "d"]


def test_links(spark):
    link = lambda u: (u, "t", False)
    got = run(
        spark, {"internal_links": [link("https://example.com/a"), link("https://example.com/b/"), link("https://example.com/gone")]},
        {"url": "https://example.com/a"}, {"url": "https://example.com/b/"}, only=[9, 41, 42],
    )
    # b is linked with its slash, but the page URL is compared without it
    assert got[9].affected_urls == ["https://example.com/b/"]
    assert got[41].affected_urls == ["https://example.com/a"]
    assert (got[42].affected_count, got[42].affected_urls) == (1, ["https://example.com"])


def test_url_cap(spark):
    got = run(spark, *[{"url": f"http://x/{i}"} for i in range(70)], only=[71])
    assert got[71].affected_count == 70 and got[71].affected_urls == [f"http://x/{i}" for i in range(50)]


def score(spark, rows):
    df = spark.createDataFrame(rows, "site_id string, severity string, passed boolean, affected_count int")
    return A.audit_score(df).first().score


def test_score(spark):
    ok, bad = lambda s: ("s", s, True, 0), lambda s, n=1: ("s", s, False, n)
    assert score(spark, [ok("medium")] * 10) == 100
    assert score(spark, [bad("medium")] * 10) == 0
    assert score(spark, [bad("critical")] + [ok("low")] * 9) == 69
    assert score(spark, [bad("low")] + [ok("low")] * 9) == 90
    assert score(spark, [bad("low", 50)] + [ok("low")] * 9) == 89
    assert 0 <= score(spark, [bad("critical", 100)] * 50) <= 100
    sites = spark.createDataFrame([("s",)], "site_id string")
    empty = spark.createDataFrame([], "site_id string, severity string, passed boolean, affected_count int")
    assert A.audit_score(empty, sites).first().score == 0


def test_deduction_variants(spark):
    df = spark.createDataFrame([("s", "high"), ("s", "odd")], "site_id string, severity string")
    assert [I.deduction_score(df, ["site_id"], u).first().score for u in (0, 1, 2)] == [90, 89, 88]


def test_grade(spark):
    df = spark.createDataFrame([(s,) for s in (95, 94, 85, 80, 75, 70, 60, 59)], "s int")
    assert [r[0] for r in df.select(A.grade(F.col("s"))).collect()] == ["A+", "A", "B+", "B", "C+", "C", "D", "F"]


def test_page_fixes_hold_every_page(spark):
    """A check that hits more pages than an issue lists."""
    names = [c.split()[0] for c in PAGE.replace("\n", " ").split(", ")]
    rows = [{**DEFAULT, "page_seq": i, "url": f"https://example.com/{i}", "title": "Short", "word_count": 150} for i in range(60)]
    pages = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], PAGE)
    sites = spark.createDataFrame([("s", "https://example.com")], "site_id string, base_url string")
    hits = A.audit_hits(pages, sites)
    checks = A.audit(pages, sites, hits=hits)
    fixes, counts = R.page_fixes(A.to_issues(checks), sites, hits)
    found = {(r["url"], r["title"]): r for r in fixes.collect()}
    titles = {r["check_id"]: r["check_name"] for r in checks.collect()}
    for i in range(60):
        assert ("https://example.com/%d" % i, titles[51]) in found
        short = found["https://example.com/%d" % i, titles[12]]
        assert (short["current"], short["target"]) == ("5", "50-60 chars")
    assert {r["url"] for r in counts.collect()} >= {f"https://example.com/{i}" for i in range(60)}
    failed_without_urls = {r["check_name"] for r in checks.collect() if not r["passed"] and not r["affected_urls"]}
    assert {t for u, t in found if u == "https://example.com" and t in failed_without_urls} == failed_without_urls


def test_stored_audit_keeps_every_hit(spark, tmp_path):
    """A check that hits more pages than a stored check row lists."""
    names = [c.split()[0] for c in PAGE.replace("\n", " ").split(", ")]
    rows = [{**DEFAULT, "page_seq": i, "url": f"https://example.com/{i}", "word_count": 150} for i in range(60)]
    pages = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], PAGE)
    sites = spark.createDataFrame([("s", "https://example.com")], "site_id string, base_url string")
    hits = A.audit_hits(pages, sites, only=[51]).withColumn("tenant_id", F.lit("t"))
    checks = A.audit(pages, sites, only=[51], hits=hits).withColumn("tenant_id", F.lit("t"))
    write_audit(str(tmp_path), A.audit_score(checks).withColumn("tenant_id", F.lit("t")), checks, A.to_issues(checks).withColumn("tenant_id", F.lit("t")), hits=hits)
    stored = spark.read.parquet(f"{tmp_path}/seo_audit_hits")
    assert {r["url"] for r in stored.collect()} == {f"https://example.com/{i}" for i in range(60)}


def test_counts_without_hits_equal_the_audit(spark):
    from siteprism.plans import q_audit

    columns = ["site_id", "check_id", "category", "severity", "passed", "affected_count"]
    sf = "/root/testdata/sf0.001"
    counts = q_audit.counts(spark, sf)
    assert sorted(map(tuple, counts.select(*columns).collect())) == sorted(map(tuple, q_audit.checks(spark, sf).select(*columns).collect()))
    assert "affected_urls" not in counts._jdf.queryExecution().executedPlan().toString()


def test_bucketed_audits_join_in_place(spark):
    from siteprism.plans import catalog

    out = catalog.QUERIES["a12_compare_stored_audits"](spark, "/root/testdata/sf0.001")
    assert out.count() > 0
    plan = out._jdf.queryExecution().sparkPlan().toString().split("SortMergeJoin")
    executed = out._jdf.queryExecution().executedPlan().toString()
    below = executed[executed.index("SortMergeJoin"):].split("== Initial Plan")[0]
    assert len(plan) == 2 and "Exchange" not in below
