"""Feedback operators against plain restatements; near copies."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteprism.operators import duplicates as N
from siteprism.operators import limits as L
from siteprism.operators import links as G
from siteprism.operators import monitor as M

T0 = dt.datetime(2024, 1, 1)


def naive_limit(times, limit, window):
    kept, out = [], []
    for t in sorted(times):
        kept = [k for k in kept if k > t - dt.timedelta(seconds=window)]
        out.append((t, len(kept) < limit, len(kept)))
        if len(kept) < limit:
            kept.append(t)
    return out


@pytest.mark.parametrize(("spread_s", "limit"), [(300, 5), (3000, 5), (30000, 3), (600, 1)])
def test_sliding_limit(spark, spread_s, limit):
    rnd = random.Random(spread_s)
    rows = {(k, T0 + dt.timedelta(microseconds=rnd.randrange(spread_s * 10**6))) for k in ("hot", "b") for _ in range(400 if k == "hot" else 30)}
    rows |= {("edge", T0 + dt.timedelta(seconds=60 * i)) for i in range(5)}
    df = spark.createDataFrame(list(rows), "tenant string, ts timestamp")
    got = {(r.tenant, r.ts.replace(tzinfo=None)): (r.allowed, r.current) for r in L.sliding_rate_limit(df, ["tenant"], limit, bucket=4).collect()}
    assert len(got) == len(rows)
    for key in ("hot", "b", "edge"):
        for t, ok, n in naive_limit([t for k, t in rows if k == key], limit, 60):
            assert got[key, t] == (ok, n)


def test_quota_amounts(spark):
    rnd = random.Random(3)
    rows = [("t", "audits", T0 + dt.timedelta(hours=i), i, rnd.randrange(1, 5)) for i in range(60)]
    usage = spark.createDataFrame(rows, "tenant_id string, usage_type string, ts timestamp, event_id int, amount int")
    quota = spark.createDataFrame([("t", 0, 0, 0, 20, 0, 0)], "tenant_id string, " + ", ".join(f"{c} int" for c in L.USAGE_TYPES))
    got = {r.event_id: r.allowed for r in L.quota_check(usage, quota).collect()}
    used = 0
    for *_, i, amount in rows:
        ok = used + amount <= 20
        used += amount if ok else 0
        assert got[i] == ok


def test_limit_of_a_key_without_a_pause(spark):
    """One key holds nine tenths of all rows and never drops below the limit; no task gets more than a few shards of it."""
    rnd = random.Random(9)
    times = sorted(rnd.sample(range(0, 2400 * 10**6, 1000), 18_000))
    rows = [("hot", T0 + dt.timedelta(microseconds=t)) for t in times] + [(f"k{i}", T0 + dt.timedelta(seconds=j)) for i in range(20) for j in range(100)]
    df = spark.createDataFrame(rows, "tenant string, ts timestamp")
    out = L.sliding_rate_limit(df, ["tenant"], 7, window_seconds=20, bucket=2)
    got = {(r.tenant, r.ts.replace(tzinfo=None)): (r.allowed, r.current, r.retry_after) for r in out.collect()}
    assert len(got) == len(rows)
    for key in ("hot", "k3"):
        for t, ok, n in naive_limit([t for k, t in rows if k == key], 7, 20):
            assert got[key, t][:2] == (ok, n) and (got[key, t][2] is None) == ok
    plan = out._jdf.queryExecution().toString()
    assert "MapInPandas" not in plan and "FlatMapCoGroupsInArrow" in plan
    shards = df.groupBy("tenant", F.floor(F.unix_micros("ts") / 40_000_000).alias("shard")).count()
    assert shards.agg(F.max("count")).first()[0] < 400  # of 18,000


def test_dense_traffic_is_not_counted_anew_for_every_row(spark, monkeypatch):
    """Only windows without an overloaded request, which hold `limit` requests at most, are frames of times."""
    plans = []
    monkeypatch.setattr(L, "materialize", lambda df: plans.append(df._jdf.queryExecution().analyzed().toString()) or df)
    rnd = random.Random(4)
    times = [T0 + dt.timedelta(milliseconds=rnd.randrange(90_000)) for _ in range(500)]
    df = spark.createDataFrame([("hot", t) for t in times], "tenant string, ts timestamp")
    got = {r.ts.replace(tzinfo=None): (r.allowed, r.current) for r in L.sliding_rate_limit(df, ["tenant"], 5, bucket=4).collect()}
    assert got == {t: (ok, n) for t, ok, n in naive_limit(set(times), 5, 60)}
    assert len(plans) == 1 and plans[0].count("specifiedwindowframe(RangeFrame") == 1
    out = L.rolling_counts(df.withColumn("id", F.monotonically_increasing_id()), ["tenant"], 3)
    assert sorted((r.ts.replace(tzinfo=None), r.in_window) for r in out.collect()) == sorted(
        (t, sum(t - dt.timedelta(seconds=3) < x <= t for x in times)) for t in times
    )
    assert out.columns == ["tenant", "ts", "id", "in_window"]
    assert "specifiedwindowframe(RangeFrame, unboundedpreceding$(), currentrow$())" in out._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("limit", [1, 4])
def test_state_is_carried_over_any_shards(limit):
    """Limits as sums and minima: shards decided apart and joined by tables of fresh starts."""
    rng = np.random.default_rng(limit)
    for _ in range(300):
        w, step = int(rng.integers(5, 60)), int(rng.integers(1, 4))
        times = np.unique(rng.integers(0, w * 30, rng.integers(1, 200)))
        if rng.random() < 0.5:
            times = np.union1d(times, np.arange(0, w * 30, step))
        kept, want = [], []
        for t in times.tolist():
            kept = [k for k in kept if k > t - w]
            want.append(len(kept) < limit)
            kept += [t] if want[-1] else []
        state, got = np.zeros(0, np.int64), np.zeros(len(times), bool)
        shard = times // (w * int(rng.integers(1, 4)))
        for b in np.unique(shard):
            own = np.flatnonzero(shard == b)
            got[own[L._accepted_from(times[own], w, limit, state[::-1])]] = True
            state = L._carried_on(state, w, limit, *L._fresh_starts(times[own], w, limit))
        assert got.tolist() == want


def test_cooldown_of_one_rule(spark):
    rnd = random.Random(4)
    times = sorted({T0 + dt.timedelta(seconds=rnd.randrange(40_000)) for _ in range(3000)})
    got = {r.ts.replace(tzinfo=None): r.fires for r in M.cooldown_sequence(spark.createDataFrame([(1, t) for t in times], "rule_id int, ts timestamp"), 5).collect()}
    last = None
    for t in times:
        fires = last is None or t >= last + dt.timedelta(minutes=5)
        last = t if fires else last
        assert got[t] == fires


def test_quota_of_a_hot_tenant(spark, monkeypatch):
    """Amounts of all sizes in an order that refuses many; rounds stay few, whatever the number of rows."""
    rnd = random.Random(6)
    rows, quota = [], 5000
    for i in range(3000):
        amount = rnd.choice([1, 2, 3, 50, 700, 2400, 2600, 4999, 6000, 0])
        rows.append(("hot", "audits", T0 + dt.timedelta(minutes=rnd.randrange(20_000)), i, amount))
    # small and nearly full amounts in turn: each refusal alone would be a round of its own
    rows += [("turns", "audits", T0 + dt.timedelta(seconds=i), 10_000 + i, 1 if i % 2 == 0 else quota - i // 2) for i in range(400)]
    rows += [("none", "audits", T0, 20_000, 10**6), ("nulls", "audits", T0, 20_001, 1)]
    usage = spark.createDataFrame(rows, "tenant_id string, usage_type string, ts timestamp, event_id int, amount int")
    quotas = spark.createDataFrame([(t, 0, 0, 0, q, 0, 0) for t, q in (("hot", quota), ("turns", quota), ("none", 0))], "tenant_id string, " + ", ".join(f"{c} int" for c in L.USAGE_TYPES))
    rounds = []
    real = L.running_total
    monkeypatch.setattr(L, "running_total", lambda *a: rounds.append(1) or real(*a))
    got = {r.event_id: r.allowed for r in L.quota_check(usage, quotas).collect()}
    assert len(got) == len(rows) and got[20_000] and got[20_001]
    for tenant in ("hot", "turns"):
        used = 0
        for *_, i, amount in sorted([r for r in rows if r[0] == tenant], key=lambda r: r[2:4]):
            assert got[i] == (used + amount <= quota), (tenant, i)
            used += amount if got[i] else 0
    assert len(rounds) <= 13  # 2 ** 13 > 5000


def test_uptime_edges(spark):
    sites = spark.createDataFrame([("a",), ("none",)], "site_id string")
    checks = spark.createDataFrame([("a", i, T0 + dt.timedelta(hours=i), i > 2) for i in range(4)], "site_id string, check_id int, checked_at timestamp, is_up boolean")
    as_of = F.lit("2024-01-01 12:00:00").cast("timestamp")
    got = {r.site_id: r for r in M.uptime_stats(checks, sites, as_of).collect()}
    assert (got["a"].uptime_1d, got["none"].uptime_1d) == (25.0, 100.0)
    assert {r.site_id: r.status for r in M.current_status(checks, sites).collect()} == {"a": "up", "none": "unknown"}
    assert M.consecutive_failures(checks, 5).first().failures == 0
    assert M.consecutive_failures(checks, 4).first().failures == 3


def test_crawl_depth_limits(spark):
    edges = spark.createDataFrame([("s", f"u{i}", f"u{i + 1}") for i in range(20)] + [("s", "u5", "u0")], "site_id string, src string, dst string")
    roots = spark.createDataFrame([("s", "u0")], "site_id string, url string")
    seeds = spark.createDataFrame([("s", "u9")], "site_id string, url string")
    got = {r.url: r.depth for r in G.crawl_depth(edges, roots, seeds, max_depth=6).collect()}
    assert got == {**{f"u{i}": i for i in range(7)}, **{f"u{i}": i - 8 for i in range(9, 15)}}
    few = G.crawl_depth(edges, roots, seeds, max_depth=6, max_pages=3).collect()
    assert sorted(r.depth for r in few) == [0, 1, 1]


def jaccard(a, b, n=3):
    s = lambda t: {tuple(t.split()[i:i + n]) for i in range(len(t.split()) - n + 1)}
    return len(s(a) & s(b)) / len(s(a) | s(b))


def test_near_duplicates_brute_force(spark):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(500)]
    texts = [" ".join(rnd.choices(words, k=120)) for _ in range(15)]
    for i in range(5):
        t = texts[i].split()
        t[40] = "changed"
        texts.append(" ".join(t))
    texts += [texts[0]] * 3
    df = spark.createDataFrame([("s", i, f"u{i}", t) for i, t in enumerate(texts)], "site_id string, page_seq bigint, url string, text_content string")
    got = {r.page_seq: r for r in N.near_duplicates(df).collect()}
    for i, t in enumerate(texts):
        similar = [j for j in range(i) if jaccard(texts[j], t) >= 0.8]
        assert (i in got) == bool(similar)
        if similar:
            assert got[i].near_duplicate_of == f"u{min(similar)}"
            assert got[i].similarity == pytest.approx(jaccard(texts[min(similar)], t))


def test_near_duplicates_of_a_family(spark, monkeypatch):
    """A family of near copies costs a comparison per page; pages that miss the first one still find the earliest."""
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    base = rnd.choices(words, k=150)
    texts = [" ".join(base[:60] + rnd.choices(words, k=90))]  # shares rare runs with the family, but isn't similar
    for i in range(200):
        own = list(base)
        own[rnd.randrange(150)] = f"x{i}"
        texts.append(" ".join(own))
    texts += [" ".join(base[:75] + rnd.choices(words, k=75)) for _ in range(10)]
    df = spark.createDataFrame([("s", i, f"u{i}", t) for i, t in enumerate(texts)], "site_id string, page_seq bigint, url string, text_content string")
    pairs = []
    real = N._similar
    monkeypatch.setattr(N, "_similar", lambda p, s, k: pairs.append(p) or real(p, s, k))
    got = {r.page_seq: r.near_duplicate_of for r in N.near_duplicates(df).collect()}
    want = {}
    for i, t in enumerate(texts):
        similar = [j for j in range(i) if jaccard(texts[j], t) >= 0.8]
        if similar:
            want[i] = f"u{similar[0]}"
    assert got == want and len(want) > 150
    assert pairs[0].count() <= len(texts)


@pytest.mark.parametrize("percent", [50, 80])
def test_near_duplicates_of_all_sizes(spark, percent):
    """Leads of the sets lose no pair, whatever the sizes and however near the limit."""
    rnd = random.Random(percent)
    texts = []
    for size in [1, 2, 3, 4, 7, 12, 30, 31, 60, 120]:
        base = [f"w{rnd.randrange(400)}" for _ in range(size)]
        texts.append(" ".join(base))
        for _ in range(5):
            own = base[rnd.randrange(size // 6 + 1) :] + [f"x{rnd.randrange(400)}" for _ in range(rnd.randrange(size // 6 + 1))]
            for _ in range(rnd.randrange(size // 30 + 1)):
                own[rnd.randrange(len(own))] = f"y{rnd.randrange(400)}"
            texts.append(" ".join(own))
    rnd.shuffle(texts)
    df = spark.createDataFrame([("s", i, f"u{i}", t) for i, t in enumerate(texts)], "site_id string, page_seq bigint, url string, text_content string")
    runs = [{tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} for w in (t.split() for t in texts)]
    similar = {i: [j for j in range(i) if 100 * len(runs[j] & r) >= percent * len(runs[j] | r)] for i, r in enumerate(runs)}
    want = {i: f"u{js[0]}" for i, js in similar.items() if js}
    assert {r.page_seq: r.near_duplicate_of for r in N.near_duplicates(df, percent).collect()} == want and want


def test_near_duplicates_move_leads(spark, monkeypatch):
    """Of pages that are like no other only two fifths of the shingles are stored, once."""
    rnd = random.Random(3)
    texts = [" ".join(str(rnd.random()) for _ in range(102)) for _ in range(30)]
    df = spark.createDataFrame([("s", i, f"u{i}", t) for i, t in enumerate(texts)], "site_id string, page_seq bigint, url string, text_content string")
    stored = []
    real = N.materialize
    monkeypatch.setattr(N, "materialize", lambda d: stored.append(real(d)) or stored[-1])
    assert N.near_duplicates(df).count() == 0
    held = 0
    for d in stored:
        for name, kind in d.dtypes:
            held += sum(len(r[0]) for r in d.select(name).collect()) if kind.startswith("array") else 0
    assert held <= 0.42 * 30 * 100
