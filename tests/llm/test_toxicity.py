import math
import random

import numpy as np
from conftest import table
from llm_helpers import rows_of

from siteprism.llm.toxicity import GRADES, Model, descend, features_of, fit, severity


def corpus(seed, n=400):
    rng = random.Random(seed)
    common = [f"word{i}" for i in range(200)]
    bad = ["vile", "scumlike", "scumly", "scumish", "foul"]
    out = []
    for i in range(n):
        w = [rng.choice(common) for _ in range(rng.randint(20, 80))]
        toxic = int(i % 5 == 0)
        for _ in range(rng.randint(1, 9) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        out.append((i, " ".join(w), toxic))
    return out


def test_planted(spark):
    train, held = corpus(1), corpus(2)
    labels = spark.createDataFrame([(i, x) for i, _, x in train] + [(None, 1), (3, None), (5, 0)], "doc_id long, toxic int")
    model = fit(table(spark, [(i, t) for i, t, _ in train]), labels)
    assert list(model.thresholds) == sorted(model.thresholds)
    got = {r["doc_id"]: r for r in rows_of(severity(table(spark, [(i, t) for i, t, _ in held]), model))}
    assert sum(got[i]["toxic"] != bool(x) for i, _, x in held) <= 8
    few, many = ([got[i]["severity"] for i, t, x in held if x and (sum(w in t for w in ("vile", "scum", "foul")) > 0) and lo <= sum(t.count(w) for w in ("vile", "scum", "foul")) <= hi] for lo, hi in ((1, 2), (7, 9)))
    assert np.mean(few) < np.mean(many) <= GRADES - 1


def test_new_forms_of_a_stem(spark):
    labels = spark.createDataFrame([(i, x) for i, _, x in corpus(1)], "doc_id long, toxic int")
    model = fit(table(spark, [(i, t) for i, t, _ in corpus(1)]), labels)
    out = rows_of(severity(table(spark, [(1, "word1 scumness word2 scumhood scumful"), (2, "word1 word2 word3")]), model))
    assert [r["toxic"] for r in sorted(out, key=lambda r: r["doc_id"])] == [True, False]


def test_gradient_descends_the_ordinal_loss():
    rng = np.random.default_rng(0)
    n = 600
    x = rng.integers(0, 2, (n, 3))
    z = x @ np.array([3.0, -2.0, 0.0]) + rng.logistic(size=n)
    grade = (z[:, None] > np.array([0.5, 2.0, 3.5])[None]).sum(1)
    at, column = np.nonzero(x)
    w, cuts = descend(at, column, np.ones(len(at)), grade, 3, 1e-4, 2000)
    assert np.allclose(w, [3, -2, 0], atol=0.5) and np.allclose(cuts, [0.5, 2, 3.5], atol=0.5)


def test_edge_rows(spark, edge, empty, edge_pairs):
    none = fit(edge, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.weights == {}
    out = rows_of(severity(edge, Model({b"word$": 3.0}, (1.0, 2.0, 3.0))))
    assert len(out) == len(edge_pairs) and {r["doc_id"] for r in out if r["toxic"]} == {7}
    assert severity(empty, none).count() == 0 and fit(empty, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")).weights == {}
    assert features_of([]) == {}
    row = rows_of(severity(edge, none, carry=True))[0]["row"]
    assert set(row["columns"]) == set(edge.columns) - {"text"}


def test_scores_as_a_plain_version(spark, edge, edge_pairs):
    """Weights of prefixes and whole words times 1 + ln(count), thresholds through the logistic function, all by hand."""
    model = Model({b"word$": 0.7, b"wor": 9.0, b"words": -0.4, b"anot": 1.3, b"a$": 0.2, "é".encode(): 2.0, b"text$": 0.5}, (0.4, 1.1, 2.5))
    pairs = [*edge_pairs, (20, "Words WORD wording, another's text; text text"), (21, "a-a a é éa"), (22, "worded words word")]

    def plain(text):
        bag = {}
        word = ""
        for c in (text or "") + " ":
            c = c.lower() if c.isascii() else c
            if "a" <= c <= "z" or not c.isascii():
                word += c
                continue
            raw = word.encode()
            for f in {raw + b"$", *(raw[:k] for k in range(4, 9) if len(raw) >= k)} if raw else ():
                bag[f] = bag.get(f, 0) + 1
            word = ""
        score = sum(w * (1 + math.log(bag[f])) for f, w in model.weights.items() if f in bag)
        beyond = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        chances = [a - b for a, b in zip([1, *beyond], [*beyond, 0])]
        return sum(beyond), max(range(4), key=lambda g: chances[g]), beyond[0]

    got = rows_of(severity(table(spark, pairs), model))
    want = [(i, *plain(t)) for i, t in pairs]
    key = lambda r: (repr(r[0]), round(r[1], 9))
    for g, w in zip(sorted([(r["doc_id"], r["severity"], r["grade"], r["p_toxic"]) for r in got], key=key), sorted(want, key=key), strict=True):
        assert g[0] == w[0] and g[2] == w[2] and np.allclose([g[1], g[3]], [w[1], w[3]], rtol=1e-12)
