import collections

import pytest
from llm_helpers import rows_of

from siteprism.llm.sharding import assign, fill_table, hashed, next_prime, table_size, write_shards

NAMES = [f"s{i}" for i in range(7)]


def by_rounds(names, size):
    """The same filling told otherwise: whole preference lists, a set of free slots."""
    orders = [[(hashed(f"{n}:offset") + j * (hashed(f"{n}:skip") % (size - 1) + 1)) % size for j in range(size)] for n in names]
    free, owner = set(range(size)), {}
    while free:
        for i, order in enumerate(orders):
            if free:
                slot = next(s for s in order if s in free)
                free.remove(slot)
                owner[slot] = i
    return [owner[s] for s in range(size)]


def test_filling():
    assert fill_table(NAMES, 71) == by_rounds(NAMES, 71)
    counts = collections.Counter(fill_table(NAMES, table_size(7)))
    assert max(counts.values()) - min(counts.values()) <= 1
    assert [next_prime(n) for n in (1, 8, 6400)] == [2, 11, 6421]


def test_few_slots_move_when_a_shard_goes():
    size = 7001
    before, after = fill_table(NAMES, size), fill_table(NAMES[:-1], size)
    moved = sum(a != b for a, b in zip(before, after) if a != 6)
    assert moved < 0.15 * size


@pytest.mark.parametrize("names, size", [([], 7), (["a", "a"], 7), (["a"], 8), (["a"] * 3, 2), (["a"], 1 << 21)])
def test_refused(names, size):
    with pytest.raises(ValueError):
        fill_table(names, size)


def test_edge_rows(edge, empty, edge_pairs, tmp_path):
    out = assign(edge.withColumnRenamed("label", "slot"), "doc_id", NAMES)
    rows = out.collect()
    assert len(rows) == len(edge_pairs) and {"slot", "shard", "text", "n_words"} <= set(out.columns)
    assert len({r["shard"] for r in rows if r["doc_id"] == 5}) == len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    assert assign(empty, "doc_id", NAMES).count() == 0
    write_shards(edge, "doc_id", NAMES, str(tmp_path / "out"), files=2)
    assert edge.sparkSession.read.parquet(str(tmp_path / "out")).count() == len(edge_pairs)


def test_no_python_and_no_shuffle(edge):
    plan = assign(edge, "doc_id", NAMES)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "Exchange hash" not in plan


def test_a_key_named_as_an_added_column(spark):
    for name in ("slot", "shard"):
        rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], f"{name} string, x int")
        plain = {r["x"]: (r["slot"], r["shard"]) for r in rows_of(assign(rows.withColumnRenamed(name, "k"), "k", ["p", "q", "r"]))}
        assert {r["x"]: (r["slot"], r["shard"]) for r in rows_of(assign(rows, name, ["p", "q", "r"]))} == plain
