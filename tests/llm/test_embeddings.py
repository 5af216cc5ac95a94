"""Near-duplicate vectors against a plain comparison of all pairs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from llm_helpers import rows_of

from siteprism.llm import embeddings as E

SCHEMA = "vec_id long, embedding array<float>, label int, node int, v string, copies int, tile int, side int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 1, 1, 1) for r in rows], SCHEMA)


def brute(rows, threshold=0.98):
    """[(vec_id, n_links, component_id)] in the order of the rows."""

    def fine(v):
        return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v)

    def cosine(a, b):
        a, b = (np.array(x, np.float32).astype(float) for x in (a, b))
        a, b = a / np.abs(a).max(), b / np.abs(b).max()
        return (a * b).sum() / math.sqrt((a * a).sum() * (b * b).sum())

    n = len(rows)
    links = [[j for j in range(n) if j != i and rows[i][2] is not None and rows[i][2] == rows[j][2] and fine(rows[i][1]) and fine(rows[j][1]) and len(rows[i][1]) == len(rows[j][1]) and cosine(rows[i][1], rows[j][1]) >= threshold] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(links[i]), min(ids) if ids else None))
    return sorted(out, key=repr)


def found(df):
    return sorted([(r["vec_id"], r["n_links"], r["component_id"]) for r in E.near_duplicates(df).collect()], key=repr)


def around(rng, v, angle):
    """A vector at the given angle to v."""
    v = np.array(v) / np.linalg.norm(v)
    w = np.array([rng.gauss(0, 1) for _ in v])
    w -= (w @ v) * v
    return (math.cos(angle) * v + math.sin(angle) * w / np.linalg.norm(w)).tolist()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    gauss = lambda n=12: [rng.gauss(0, 1) for _ in range(n)]
    out = [
        (1, None, 1), (2, [], 1), (3, [0.0] * 12, 1), (4, [1.0, None] + [0.0] * 10, 1), (5, [math.nan] + [1.0] * 11, 1), (6, [math.inf] + [1.0] * 11, 1),
        (7, gauss(), None), (8, gauss(5), 1), (9, gauss(5), 1), (None, [1.0] * 12, 2), (None, [1.0] * 12, 2), (11, [-1.0] * 12, 2), (12, [0.0, -0.0, 1.0] + [0.0] * 9, 3), (13, [-0.0, 0.0, 1.0] + [0.0] * 9, 3),
        (14, [3e38] * 12, 2), (15, [1e-44] * 12, 4), (16, [3e-44] * 12, 4), (14, [5.0] * 12, 5), (14, [5.0] * 12, 5),
    ]
    k = 100
    for label in (1, 2, 6):
        for _ in range(8):
            v = gauss()
            for _ in range(6):  # chains: neighbours are linked, ends are not
                out.append((k, v, label))
                v = around(rng, v, math.acos(0.98) * rng.choice([0.2, 0.98, 1.02]))
                k += 1
    hub = gauss()
    out += [(k + i, around(rng, hub, 0.15 * rng.random()), 7) for i in range(120)]
    out += [(k + 200 + i, hub, 7) for i in range(60)]
    rng.shuffle(out)
    return out


def test_as_all_pairs(spark, rows):
    assert found(table(spark, rows)) == brute(rows)


def test_small_tiles_lose_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(E, "TILE", 7)
    monkeypatch.setattr(E, "PIVOTS", 3)
    assert found(table(spark, rows)) == brute(rows)


def test_tiles_that_lie_apart_do_not_meet(spark, monkeypatch):
    rng = random.Random(4)
    centers = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(20)]
    vectors = [(i, around(rng, centers[i % 20], 0.05 * rng.random()), 1) for i in range(400)]
    monkeypatch.setattr(E, "TILE", 10)
    asked = []
    real = E.compared
    monkeypatch.setattr(E, "compared", lambda rows, wanted, t: asked.append(wanted) or real(rows, wanted, t))
    assert found(table(spark, vectors)) == brute(vectors)
    tiles = asked[0].select("tile").distinct().count()
    meetings = asked[0].select("x", "y").distinct().count()
    assert tiles >= 40 and meetings < tiles * (tiles + 1) / 4


@pytest.mark.parametrize("dims", [1, 3, 64, 2000])
def test_bounds_hold(dims):
    rng = np.random.default_rng(dims)
    u, w = (E.unit(rng.standard_normal((50, dims)) * 10.0 ** rng.integers(-30, 30, (50, 1))) for _ in range(2))
    a, b = E.quantised(u), E.quantised(w)
    near = E.products(a[0], b[0]) * a[1][:, None] * b[1][None, :]
    assert (E.products(a[0], b[0]) == a[0].astype(int) @ b[0].astype(int).T).all()
    assert (np.abs(near - u @ w.T) <= a[2][:, None] + (1 + a[2])[:, None] * b[2][None, :]).all()


def test_only_pairs_in_doubt_are_worked_out():
    rng = np.random.default_rng(1)
    u = E.unit(rng.standard_normal((300, 64)))
    u[150:] = E.unit(u[:150] + 0.01 * rng.standard_normal((150, 64)))
    q = E.quantised(u)
    links, worked = E.linked(q, q, u, u, 0.98)
    assert (links == (u @ u.T >= 0.98)).all() and links.sum() == 600 and worked < 300


def test_ties_of_a_chain():
    assert E.stars(6, np.array([4, 3, 1]), np.array([3, 1, 5])).tolist() == [0, 1, 2, 1, 1, 1]


def test_empty_and_all_unusable(spark):
    assert rows_of(E.near_duplicates(table(spark, []))) == []
    assert found(table(spark, [(1, None, 1), (2, [0.0], 2)])) == [(1, 0, 1), (2, 0, 2)]
