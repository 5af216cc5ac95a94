import itertools
import random
from collections.abc import Iterator

import pyarrow as pa
import pytest
from conftest import table
from llm_helpers import rows_of
from pyspark.sql import functions as F

from siteprism.llm import common, jaccard
from siteprism.llm.graph import components


def shingles(text, n):
    w = (text or "").lower().encode().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(pairs, n, percent):
    sets = {i: shingles(t, n) for i, t in pairs}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            top[y] = x
    return sorted((i, len(s), find(i)) for i, s in sets.items())


def corpus(seed, n=240):
    """Families with every degree of likeness, short and long, exact copies, and a passage that half of all share."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(words) for _ in range(30)]
    out = []
    while len(out) < n:
        base = [rng.choice(words) for _ in range(rng.choice([3, 4, 6, 9, 14, 30, 90, 300]))]
        if rng.random() < 0.5:
            base += passage
        for _ in range(rng.choice([1, 1, 2, 8, 25])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, len(w) // 40, len(w) // 20])):
                at = rng.randrange(len(w))
                w[at : at + rng.choice([0, 1, 1])] = [rng.choice(words)]
            out.append(" ".join(w))
    order = list(range(1000, 1000 + len(out)))
    rng.shuffle(order)
    return list(zip(order, out))


@pytest.mark.parametrize("n, percent, block", [(4, 85, None), (5, 80, None), (4, 85, 2000)])
def test_against_brute_force(spark, monkeypatch, n, percent, block):
    if block:  # large families in several blocks
        monkeypatch.setattr(jaccard, "BLOCK", block)
    pairs = corpus(percent)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows_of(jaccard.join(table(spark, pairs).repartition(7), n, percent)))
    assert got == brute(pairs, n, percent)


def test_edge_rows(spark, edge, empty, edge_pairs):
    out = rows_of(jaccard.join(edge, 4, 85))
    assert len(out) == len(edge_pairs) and jaccard.join(empty, 4, 85).count() == 0
    assert all(r["component_id"] == r["doc_id"] for r in out)
    assert {r["n_shingles"] for r in out if r["doc_id"] in (1, 2, 3)} == {0}
    assert jaccard.join(table(spark, [(1, None), (2, "")]), 4, 85).count() == 2


def test_links_go_over_rows_without_an_id(spark):
    text = " ".join(f"w{i}" for i in range(50))
    out = rows_of(jaccard.join(table(spark, [(None, text), (9, text), (4, text + " more")]), 4, 85))
    assert [r["component_id"] for r in out] == [4, 4, 4]


def test_a_text_that_only_a_row_without_an_id_holds_links_others(spark):
    """1 ~ NULL ~ 2, but not 1 ~ 2."""
    words = [f"w{i}" for i in range(60)]
    left, right = [*words], [*words]
    left[:4] = [f"x{i}" for i in range(4)]
    right[-4:] = [f"y{i}" for i in range(4)]
    pairs = [(1, " ".join(left)), (None, " ".join(words)), (2, " ".join(right))]
    assert [r[2] for r in brute([pairs[0], pairs[2]], 4, 85)] == [1, 2]
    out = {r["doc_id"]: r["component_id"] for r in rows_of(jaccard.join(table(spark, pairs), 4, 85))}
    assert out == {1: 1, None: 1, 2: 1}
    many = [*pairs, (3, None), (None, None), (None, " ".join(words)), (1, "w0 w1 w2 w3 w4"), (2, " ".join(left)), (2, " ".join(left))] + [(None, " ".join(words))] * 30
    got = sorted(((r["doc_id"], r["component_id"]) for r in rows_of(jaccard.join(table(spark, many).repartition(5), 4, 85))), key=repr)
    assert got == sorted([(1, 1), (None, 1), (2, 1), (3, 3), (None, None), (None, 1), (1, 1), (2, 1), (2, 1)] + [(None, 1)] * 30, key=repr)


def test_families_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 1500)
    rng = random.Random(12)
    words = [f"w{i}" for i in range(70)]
    pairs = []
    for i in range(60):
        own = [*words]
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(70)] = f"z{i}"
        pairs.append((rng.randint(1, 50), " ".join(own[: rng.choice([70, 70, 66, 50])])))
    ids = {i: (i, t) for i, t in pairs}
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows_of(jaccard.join(table(spark, list(ids.values())), 4, 85)))
    assert got == brute(list(ids.values()), 4, 85)


def test_bands_and_bounds():
    for percent in (80, 85, 90):
        starts = jaccard.band_starts(percent)
        for a in range(1, 4000):
            b = a * 100 // percent
            band = [int((starts <= x).sum()) for x in (a, b)]
            assert band[1] - band[0] <= 1
            common = -(-percent * (a + b) // (100 + percent))
            if common <= a:
                assert a + b - 2 * common <= jaccard.allowed(a + b, percent)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100)] + [(200, 200 + i) for i in range(50)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    top = {}
    for a, b in edges:
        top.setdefault(a, a)
        top.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            top[a] = top[b] = min(top[a], top[b])
    assert got == {k: v for k, v in top.items() if any(a != b and k in (a, b) for a, b in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_texts_travel_in_rounds(spark, monkeypatch):
    """A family of many blocks that all meet: its texts go to their tasks in several rounds, with the same result."""
    monkeypatch.setattr(jaccard, "BLOCK", 2000)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    pairs = []
    for i in range(80):
        own = list(base)
        for _ in range(rng.randrange(5)):
            own[rng.randrange(200)] = f"x{i}"
        pairs.append((i, " ".join(own)))
    passes = []
    real = jaccard.stored
    monkeypatch.setattr(jaccard, "stored", lambda df: passes.append(df) or real(df))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows_of(jaccard.join(table(spark, pairs), 4, 85)))
    assert got == brute(pairs, 4, 85)
    assert len(passes) > 2


def test_texts_reach_python_in_small_batches(spark, monkeypatch):
    """Long texts come to the comparisons, as to all passes over them, in batches of bounded size; the session's own setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen = spark.conf.get(name), []
    real = jaccard.stored

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"bytes": pa.array([b.nbytes for b in batches], pa.int64())})

    def noted(df):
        texts = spark.range(1000, numPartitions=1).select(F.lit(1).alias("task"), F.repeat(F.lit("x"), 10_000).alias("text"))
        seen.extend(r["bytes"] for r in texts.groupBy("task").applyInArrow(sizes, "bytes long").collect())
        return real(df)

    monkeypatch.setattr(jaccard, "stored", noted)
    text = " ".join(f"w{i}" for i in range(50))
    out = rows_of(jaccard.join(table(spark, [(9, text), (4, text + " more")]), 4, 85))
    assert [r["component_id"] for r in out] == [4, 4]
    assert seen and max(seen) <= 1.1 * common.BATCH_BYTES
    assert spark.conf.get(name) == before


def test_sets_of_a_slice_and_of_its_texts_alone(monkeypatch):
    """Words of many texts are hashed at once, long texts in parts: the sets are those of the texts one by one."""
    rng = random.Random(3)
    odd = [b"", None, b" ", b"\x0b", b"One", b"one  TWO", b"a b c d e f", b"x" * 3000, b" a\tb\nc\x0bd\x0ce\rf ", "é ü   ß\xa0a".encode()]
    odd += [b" ".join(rng.choice([b"aa", b"B", b"ccc"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    alone = [jaccard.sets_of([t], 4)[0].tolist() for t in odd]
    assert [len(s) for s in alone] == [len({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else ()) for w in ((t or b"").lower().split() for t in odd)]
    for piece in (1 << 19, 37, 1):
        monkeypatch.setattr(jaccard, "PIECE", piece)
        assert [s.tolist() for s in jaccard.sets_of(odd, 4)] == alone


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80)])
def test_linked_sets_share_the_keys_they_need(n, percent):
    pairs = corpus(percent + 1)
    plain = [shingles(t, n) for _, t in pairs]
    sets = jaccard.sets_of([t.encode() for _, t in pairs], n)
    key, place, need = jaccard.keys_of(sets, percent)
    mine = {i: {} for i in range(len(sets))}
    for k, p, x in zip(key.tolist(), place.tolist(), need.tolist()):
        mine[p][k] = x
    linked = 0
    for a, b in itertools.combinations(range(len(sets)), 2):
        common = len(plain[a] & plain[b])
        if plain[a] != plain[b] and 100 * common >= percent * (len(plain[a]) + len(plain[b]) - common):
            linked += 1
            shared = [k for k in mine[a].keys() & mine[b].keys() if not mine[a][k] & mine[b][k] & 1]
            assert shared and len(shared) >= max(max(mine[a][k], mine[b][k]) >> 1 for k in shared)
    assert linked > 100


@pytest.mark.parametrize("few", [2, 5])
def test_crowded_keys_against_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(jaccard, "FEW", few)
    pairs = corpus(7 + few)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows_of(jaccard.join(table(spark, pairs).repartition(5), 5, 80)))
    assert got == brute(pairs, 5, 80)


def test_common_passages_bring_no_texts_together(spark, monkeypatch):
    """A third of every text is a passage that all hold, another third one that it shares with one neighbour: nothing is compared."""
    words = lambda c, n: [f"{c}{i}" for i in range(n)]
    common = words("w", 60)
    pairs = [(i, " ".join(common + words(f"p{i // 2}_", 60) + words(f"own{i}_", 80))) for i in range(60)]
    pairs += [(100, " ".join(words("z", 200))), (101, " ".join(words("z", 201)))]
    families, real = [], jaccard.components
    monkeypatch.setattr(jaccard, "components", lambda edges: families.append(real(edges)) or families[-1])
    got = {r["doc_id"]: r["component_id"] for r in rows_of(jaccard.join(table(spark, pairs), 5, 80))}
    assert got == {i: 100 if i == 101 else i for i, _ in pairs}
    assert families[0].count() == 2
