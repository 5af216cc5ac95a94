import random
import re

from llm_helpers import rows_of

from siteprism.llm.quality import MEASURES, RULES, fit, judge, measure, measures, repeated_words


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    covered = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_measures_against_brute_force(edge, edge_pairs):
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b ", "é", "\n", "#", "\x0b", "\x1f", " ", " x y", "日 ", "a b c d e f g h "]) for _ in range(rng.randint(0, 80)))
        assert measure(text.encode())[:5] == brute(text)
    small = [(i, t) for i, t in edge_pairs if len(t or "") < 50_000]
    got = sorted((r["doc_id"] or 0, *(r[m] for m in MEASURES[:5])) for r in rows_of(measures(edge)) if r["word_chars"] < 45_000)
    assert got == sorted((i or 0, *brute(t)) for i, t in small)


def test_repeats_overlap():
    assert repeated_words([b"a"] * 9) == 9 and repeated_words([b"a"] * 8) == 0
    assert repeated_words(list(b"abcdefgh") + [0] + list(b"abcdefgh")) == 16


def test_em_finds_the_accuracies():
    rng = random.Random(3)
    sides, chances = [-1, -1, -1, 1, 1], [(0.7, 0.02), (0.5, 0.05), (0.6, 0.01), (0.2, 0.9), (0.3, 0.8)]
    counts = {}
    for _ in range(20_000):
        good = rng.random() < 0.8
        votes = tuple(s if rng.random() < c[good] else 0 for s, c in zip(sides, chances))
        counts[votes] = counts.get(votes, 0) + 1
    model = fit(sorted(counts.items()), sides)
    assert abs(model.good - 0.8) < 0.02
    assert all(abs(a - b) < 0.04 for c, d in zip(chances, model.chances) for a, b in zip(c, d))
    assert all(a > 0.5 for a in model.accuracy(sides))
    assert fit([], sides).good == 0.8


def test_judged(spark, edge, empty, edge_pairs):
    out = rows_of(judge(edge))
    assert len(out) == len(edge_pairs) and judge(empty).count() == 0
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"]) and 0 <= r["posterior"] <= 1


def test_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = judge(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("not base_failed")
    share = {(r["quality"], r["kept"]): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert share.get((1, False), 0) <= 0.01 * share[1, True]
    assert share.get((0, True), 0) <= 0.2 * share[0, False]
    assert len(RULES) == 10
