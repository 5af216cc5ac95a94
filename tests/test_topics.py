"""Topic clusters against a plain restatement."""

from __future__ import annotations

import math
from collections import Counter
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from siteprism.operators import topics as T

SITES = {
    "garden": ["rose garden care", "tulip garden care", "rose garden tips", "lawn mower repair", "mower blade repair", "electric mower repair", "garden soil", "", "  ", None],
    "travel": ["cheap flight to rome", "cheap flight to oslo", "rome hotel deals", "oslo hotel deals", "Rome  HOTEL deals", "train to oslo", "cheap flight to rome"],
    "same": ["one text", "one text", "one text", "one text"],
    "few": ["rose garden", "cheap flight"],
    "one": ["rose"],
}


def plain(vectors: dict[int, dict[int, int]], k: int, rounds: int) -> dict[int, str]:
    def apart(a, b):
        return sum((a.get(i, 0) - b.get(i, 0)) ** 2 for i in {*a, *b})

    ids = sorted(vectors)
    centers = [vectors[ids[0]]]
    while len(centers) < k:
        least, i = min((-min(apart(vectors[i], c) for c in centers), i) for i in ids)
        if not least:
            break
        centers.append(vectors[i])
    for turn in range(rounds + 1):
        of = {i: min(range(len(centers)), key=lambda c: (apart(vectors[i], centers[c]), c)) for i in ids}
        for c in range(len(centers) if turn < rounds else 0):
            own = [vectors[i] for i in ids if of[i] == c]
            if own:
                centers[c] = {d: sum(x.get(d, 0) for x in own) // len(own) for d in set().union(*own)}
    return {i: f"topic_{c}" for i, c in of.items()}


def weights(texts: list[str | None], dims: int) -> list[dict[int, int]]:
    counts = [Counter(int(md5(w.encode()).hexdigest()[:8], 16) % dims for w in (t or "").lower().split()) for t in texts]
    df = Counter(i for c in counts for i in c)
    return [{i: w for i, n in c.items() if (w := math.floor(T.SCALE * n * math.log((len(texts) + 1) / (df[i] + 1)) + 0.5))} for c in counts]


@pytest.mark.parametrize(("k", "rounds", "dims"), [(3, 4, 1024), (8, 2, 16)])
def test_texts_of_each_site_by_themselves(spark, k, rounds, dims):
    rows = [(site, 100 * n + i, t) for n, (site, texts) in enumerate(SITES.items()) for i, t in enumerate(texts)]
    got = {r.keyword_id: r.cluster_label for r in T.topic_clusters(spark.createDataFrame(rows, "site_id string, keyword_id int, text string"), k, rounds, dims=dims).collect()}
    want = {}
    for n, texts in enumerate(SITES.values()):
        ids = range(100 * n, 100 * n + len(texts))
        want |= plain(dict(zip(ids, weights(texts, dims))), k, rounds) if len(texts) >= 3 else dict.fromkeys(ids, "mixed")
    assert got == want
    if dims > 16:
        assert len({got[i] for i in (0, 1, 2)}) == 1 != len({got[i] for i in (0, 3)})


def test_a_site_in_several_blocks(spark, monkeypatch):
    """Centers meet blocks of keywords, not each keyword, and sums and ties hold over all blocks of a site."""
    monkeypatch.setattr(T, "BLOCK", 2)
    rows = [("garden", i, t) for i, t in enumerate(SITES["garden"])]
    df = spark.createDataFrame(rows, "site_id string, keyword_id int, text string")
    held = T.blocks(T.text_vectors(df).withColumn("n", F.lit(len(rows)))).collect()
    assert 1 < len(held) < len(rows) and sorted(i for r in held for i in r.ids) == list(range(len(rows)))
    got = {r.keyword_id: r.cluster_label for r in T.topic_clusters(df, 3, 1).collect()}
    assert got == plain(dict(enumerate(weights(SITES["garden"], T.DIMS))), 3, 1)


def test_given_vectors(spark):
    rows = [("s", 1, [0.0, 1.0]), ("s", 2, [0.1, 1.0]), ("s", 3, [5.0, -1.0]), ("s", 4, [5.0, -1.5]), ("s", 5, None), ("s", 6, [math.nan, None]), (None, 7, [1.0, 1.0]), ("s", None, [1.0, 1.0]), ("t", 8, [1.0])]
    df = spark.createDataFrame(rows, "site_id string, keyword_id int, vec array<double>")
    got = {r.keyword_id: r.cluster_label for r in T.topic_clusters(df, 2, 3, "vec", 2).collect()}
    whole = {i: {d: math.floor(c * T.SCALE) for d, c in enumerate(v or []) if c is not None and c == c and c} for s, i, v in rows if s == "s" and i}
    assert got == plain(whole, 2, 3) | {8: "mixed"}


def test_empty(spark):
    assert T.topic_clusters(spark.createDataFrame([], "site_id string, keyword_id int, text string")).count() == 0
