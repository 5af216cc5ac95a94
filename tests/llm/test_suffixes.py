import collections
import hashlib
import random

import numpy as np
import pytest
from conftest import table
from llm_helpers import rows_of

from siteprism.llm import common, suffixes
from siteprism.llm.suffixes import LENGTH, Fingerprints, kept, segments, sliding_least


def brute(pairs):
    texts = [(i, (t or "").encode()) for i, t in pairs]
    seen = collections.Counter(t[k : k + LENGTH] for _, t in texts for k in range(len(t) - LENGTH + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - LENGTH + 1):
            if seen[t[k : k + LENGTH]] > 1:
                gone[k : k + LENGTH] = True
        rest = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i or 0, len(t), int(gone.sum()), int((np.diff(gone.astype(int)) == -1).sum()), hashlib.sha256(rest).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in rows_of(df))


def corpus(seed):
    """Passages of lengths around LENGTH in many texts, with single bytes changed, periods, repeats inside a text, copies."""
    rng = random.Random(seed)

    def noise(n):
        return "".join(rng.choice("abcdefgh é") for _ in range(n))

    passages = [noise(n) for n in (150, 185, 199, 200, 201, 260, 400, 900)]
    out = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            if rng.random() < 0.4:
                at = rng.randrange(len(p))
                p = p[:at] + "X" + p[at + 1 :]
            a, b = sorted(rng.sample(range(len(p) + 1), 2)) if rng.random() < 0.3 else (0, len(p))
            parts += [noise(rng.choice([0, 3, 150, 500])), p[a:b]]
        out.append("".join([*parts, noise(rng.choice([0, 40, 300]))]))
    out += ["z" * 450, "z" * 199, "ab" * 300, "ab" * 120, noise(200), out[3], out[3], out[5], "", "short"]
    return list(enumerate(out, 1))


@pytest.mark.parametrize("batches", [1, 2, 4, 5])
def test_against_brute_force(spark, batches):
    pairs = corpus(batches)
    assert found(kept(table(spark, pairs).repartition(5), batches)) == brute(pairs)


def test_very_long_texts(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefghijklmnop") for _ in range(2 * suffixes.SLICE + 70_000))
    passage = long[suffixes.SLICE - 130 : suffixes.SLICE + 170]  # over a cut between two parts
    pairs = [(1, long), (2, "start " + passage + " end"), (3, "xy" * 300)]
    got = {r["doc_id"]: r for r in rows_of(kept(table(spark, pairs)))}
    assert (got[1]["n_removed"], got[1]["n_spans"], got[2]["n_removed"], got[2]["kept"]) == (300, 1, 300, b"start  end")
    assert got[3]["n_removed"] == 600


def test_edge_rows(edge, empty, edge_pairs):
    pairs = [(i, t) for i, t in edge_pairs if len(t or "") < 110_000]
    assert found(kept(edge.filter("coalesce(length(text), 0) < 110000"))) == brute(pairs)
    assert kept(empty).count() == 0 and kept(edge).count() == len(edge_pairs)


@pytest.mark.parametrize("batches", [1, 3])
def test_a_very_common_passage(spark, batches):
    """Most rows of a slice are equal: two of them stand for it elsewhere, the others are settled where they are."""
    rng = random.Random(31)
    noise = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    common, once = noise(900), noise(700)
    pairs = [(i, noise(rng.randint(0, 90)) + common[: rng.choice([900, 900, 900, 500])] + noise(rng.randint(0, 90))) for i in range(150)]
    pairs += [(200, once), (201, noise(50) + once[100:400]), (202, common * 3), (203, once[:250] + common[:300] + once[:250])]
    assert found(kept(table(spark, pairs).repartition(4), batches)) == brute(pairs)
    data = np.frombuffer("".join(t for _, t in pairs).encode(), np.uint8)
    got = segments(Fingerprints(data), data, np.cumsum([len(t.encode()) for _, t in pairs]))
    settled = suffixes.beyond_two(got["core"], got["cover"])
    counts = collections.Counter(zip(got["core"].tolist(), got["cover"].tolist()))
    assert settled.sum() == sum(max(0, n - 2) for n in counts.values()) > len(settled) / 3


def test_runs_of_two_texts_may_touch(spark):
    """A text that goes to its last byte, before one that goes from its first."""
    pairs = [(1, "k" * 250), (2, "m" * 250), (3, "k" * 250 + "tail"), (4, ""), (5, None), (6, "m" * 250)]
    assert found(kept(table(spark, pairs).coalesce(1), 1)) == brute(pairs)


def test_segments_hold_every_window_once():
    rng = np.random.default_rng(3)
    sizes = [0, 199, 200, 201, 1000, 5, 777]
    data = rng.integers(97, 101, sum(sizes)).astype(np.uint8)
    ends = np.cumsum(sizes)
    got = segments(Fingerprints(data), data, ends)
    starts = sorted(s for a, b in zip(got["first"], got["last"]) for s in range(a, b + 1))
    assert starts == [s for e, n in zip(ends, sizes) for s in range(e - n, e - LENGTH + 1)]
    assert ((got["anchor"] >= got["last"]) & (got["anchor"] + suffixes.GRAM <= got["first"] + LENGTH)).all()
    x = rng.integers(0, 99, 500)
    assert all((sliding_least(x, w) == [x[i : i + w].min() for i in range(501 - w)]).all() for w in (1, 2, 3, 161))


def test_places_beyond_the_bits_that_hold_them(monkeypatch):
    rng = np.random.default_rng(11)
    passage = rng.integers(0, 256, 700).astype(np.uint8)
    long = rng.integers(0, 256, 5000).astype(np.uint8)
    long[3900:4600] = passage  # over a limit of 1024 bytes and over its fourfold
    whole = segments(Fingerprints(long), long, np.array([len(long)]))
    monkeypatch.setattr(suffixes, "_PLACE", 10)
    got = segments(Fingerprints(long), long, np.array([len(long)]))
    assert all((got[k] == whole[k]).all() for k in whole)
    assert ((got["anchor"] >= got["last"]) & (got["anchor"] + suffixes.GRAM <= got["first"] + LENGTH)).all()
    alone = segments(Fingerprints(passage), passage, np.array([len(passage)]))
    assert set(alone["core"].tolist()) <= set(got["core"].tolist())


def test_levels_double(spark, tmp_path):
    family = suffixes.IndexFamily(str(tmp_path))
    rows = suffixes.keyed_texts(table(spark, [(1, "q" * 300)]))
    for sizes in ([1], [2], [2, 1], [4], [4, 1]):
        family.add(rows)
        assert [x.size for x in family.levels] == sizes


def test_repeats_reach_python_in_small_batches(spark, monkeypatch):
    """While repeats are looked for, texts come to Python in batches of bounded size; the session's own setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen, real = spark.conf.get(name), [], suffixes.stored
    monkeypatch.setattr(suffixes, "stored", lambda df: seen.append(spark.conf.get(name)) or real(df))
    text = " ".join(f"w{i}" for i in range(100))
    assert {r["n_removed"] for r in suffixes.kept(table(spark, [(1, text), (2, text)])).collect()} == {len(text)}
    assert len(seen) == 4 and set(seen) == {f"{common.BATCH_BYTES}b"}
    assert spark.conf.get(name) == before
