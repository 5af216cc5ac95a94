"""Stages against brute force, each on what the one before kept."""

import corpus_pipeline as P
import pytest
from llm_helpers import rows_of
from test_decontaminate import brute as brute_hits
from test_jaccard import brute as brute_groups
from test_suffixes import brute as brute_repeats

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        stage(spark, out[-1], SF).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1]) and steps[-1].columns == ["doc_id", "n_tokens", "ids", "round_trip"]
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_copies", "repeats", "decontamination", "pieces"]


def test_near_copies(steps):
    groups = brute_groups(pairs(steps[1]), P.SHINGLE, P.PERCENT)
    assert sorted(i for i, _ in pairs(steps[2])) == sorted({c for _, _, c in groups})


def test_near_copies_of_repeated_ids(spark, edge):
    """A copy goes although its id also has a text of its own; of a group's rows with one id one stays."""
    a, other = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    columns = ["doc_id", "text", "lang", "source", "n_chars"]

    def kept(*rows):
        docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], edge.select(*columns).schema)
        return sorted(((r["doc_id"], r["text"]) for r in P.drop_near_copies(spark, docs, SF).collect()), key=repr)

    assert kept((1, other), (1, a), (0, a)) == [(0, a), (1, other)]
    assert kept((5, other), (5, a)) == [(5, a), (5, other)]
    assert len(kept((0, a), (0, a + " more"), (1, a))) == 1
    assert kept((0, a), (0, a), (None, a), (None, a), (2, ""), (2, None)) == sorted([(0, a), (None, a), (None, a), (2, ""), (2, None)], key=repr)


def test_repeats(steps):
    want = {i: n - r for i, n, r, *_ in brute_repeats(pairs(steps[2]))}
    got = {i: len((t or "").encode()) for i, t in pairs(steps[3])}
    assert set(got) == {i for i, n in want.items() if n} and all(want[i] - 6 <= n <= want[i] for i, n in got.items())


def test_decontamination(spark, steps):
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute_hits(pairs(steps[3]), items, 13) if r[-1]}
    assert sorted(i for i, _ in pairs(steps[4])) == sorted(i for i, _ in pairs(steps[3]) if i not in bad)


def test_encoding(steps):
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in rows_of(steps[5])) and steps[5].count() == steps[4].count()


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES])
def test_edge_rows(spark, edge, empty, stage):
    columns = ["doc_id", "text", "lang", "source", "n_chars", "node", "row", "label"]
    out = stage(spark, edge.select(*columns), SF)
    rows = out.collect()
    assert {r["doc_id"] for r in rows} >= {1, 2, 3, 4, None}
    assert stage(spark, empty.select(*columns), SF).count() == 0
