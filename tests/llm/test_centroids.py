"""Centroid clustering against a plain version with whole numbers."""

from __future__ import annotations

import math
import random
from hashlib import sha256

import numpy as np
import pytest
from llm_helpers import rows_of

from siteprism.llm import centroids as C

SCHEMA = "vec_id long, embedding array<float>, label int, x int, place int, ids int, data int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, 1, 1, 1) for r in rows], SCHEMA)


def brute(rows, k, rounds, dims, scale=1024):
    held = [(i, [math.floor(scale * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) and abs(c) < 1e5 for c in v)]
    centers = [x for i, x in sorted(((i, x) for i, x in held if i is not None), key=lambda r: (sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    if not centers:
        return []

    def apart(a, b):
        return sum((p - q) ** 2 for p, q in zip(a, b))

    for turn in range(rounds + 1):
        of = [min(range(len(centers)), key=lambda c: (apart(x, centers[c]), c)) for _, x in held]
        if turn < rounds:
            for c in range(len(centers)):
                own = [x for (_, x), o in zip(held, of) if o == c]
                if own:
                    centers[c] = [sum(col) // len(own) for col in zip(*own)]
    far = [apart(x, centers[o]) for (_, x), o in zip(held, of)]
    return sorted([(i, o, d, sum(e for e, p in zip(far, of) if p == o), sum(far), tuple(centers[o])) for (i, _), o, d in zip(held, of, far)], key=repr)


def found(df, *args):
    return sorted([(r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], tuple(r["centroid"])) for r in C.cluster(df, *args).collect()], key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = [(1, None), (2, []), (3, [1.0, 2.0]), (4, [1.0, None, 2.0]), (5, [math.nan, 1.0, 1.0]), (6, [1.0, -math.inf, 1.0]), (7, [3e38, 1.0, 1.0]), (None, [0.5, 0.5, 0.5]), (8, [0.0, -0.0, 0.0]), (9, [1.0, 1.0, 1.0]), (9, [2.0, 1.0, -1.0]), (9, [1.0, 1.0, 1.0])]
    spots = [[rng.uniform(-3, 3) for _ in range(3)] for _ in range(5)]
    out += [(100 + i, [rng.gauss(c, 0.4) for c in spots[i % 5]]) for i in range(300)]
    out += [(500 + i, [0.25, -0.5, 0.125]) for i in range(60)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("k", "rounds", "block"), [(4, 3, 16), (7, 10, 256), (1, 1, 1)])
def test_as_the_plain_version(spark, rows, monkeypatch, k, rounds, block):
    monkeypatch.setattr(C, "BLOCK", block)
    assert found(table(spark, rows), k, rounds, 3) == brute(rows, k, rounds, 3)


def test_fewer_rows_than_centroids_and_none(spark):
    few = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 1.0, 0.0])]
    assert found(table(spark, few), 8, 10, 3) == brute(few, 8, 10, 3)
    assert rows_of(C.cluster(table(spark, []), 8, 10, 3)) == []
    assert rows_of(C.cluster(table(spark, [(None, [1.0, 1.0, 1.0])]), 8, 10, 3)) == []


def test_centroids_that_lose_all_vectors_stay(spark):
    """Equal starts: ties go to the smaller number, so the others stay empty where they are."""
    rows = [(i, [1.0, 1.0, 1.0]) for i in range(20)]
    assert found(table(spark, rows), 3, 2, 3) == brute(rows, 3, 2, 3)


@pytest.mark.parametrize(("dims", "bits"), [(1, 3), (2, 3), (3, 2), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
    keys = [k.tobytes() for k in C.hilbert(cells, bits)]
    assert len(set(keys)) == len(cells)
    path = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_candidates_hold_every_nearest_centroid():
    rng = np.random.default_rng(2)
    fewer = 0
    for _ in range(300):
        x = rng.integers(-50, 50, (12, 3)) // rng.integers(1, 9) + rng.integers(-60, 60, 3)
        centers = rng.integers(-90, 90, (8, 3))
        near = C.candidates(x.min(0), x.max(0), centers)
        of, apart = C.nearest(x, centers, near)
        every, least = C.nearest(x, centers, np.arange(8))
        assert (of == every).all() and (apart == least).all()
        fewer += len(near) < 8
    assert fewer > 200


def test_blocks_cover_all_rows_in_order(spark, rows, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 16)
    held = rows_of(C.blocks(C.whole(table(spark, rows), 3, 1024), 3))
    assert sorted(str(i) for b in held for i in b["ids"]) == sorted(str(i) for i, *_ in brute(rows, 1, 0, 3))
    for b in held:
        x = np.frombuffer(b["data"], np.int64).reshape(-1, 3)
        assert len(x) == len(b["ids"]) <= 16 and x.min(0).tolist() == b["low"] and x.max(0).tolist() == b["high"]
