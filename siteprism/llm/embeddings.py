"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

A vector of length 1 is kept as whole numbers q of 8 bits and a scale s, with
e, the length of what s * q leaves over.  For two vectors the product of the
rounded ones differs from the cosine by at most e1 + (1 + e1) * e2, so most
pairs are decided by whole-number products of two tiles: surely below the
threshold, or surely not below it.  Only pairs in between are worked out in
double precision.

Equal vectors of a label are one node with a number of copies.  Nodes are dealt
to tiles by label and nearest pivot (PIVOTS vectors, taken by hash), large ones
by hash on top.  A tile knows the least and most distance of its vectors to
every pivot; as distances of linked vectors to a pivot differ by no more than
their own distance, two tiles meet only where all these ranges come close
enough.  Every meeting is a task of its own, whatever share of all vectors a
label holds, and sends on a count and a tie per linked vector, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteprism.llm.common import stored
from siteprism.llm.graph import components

#: Vectors in a tile (about: they are dealt by hash); vectors that tiles are told apart by.
TILE, PIVOTS = 1024, 16
#: Products of so many components are exact in single precision; pairs worked out at once.
EXACT, PAIRS = (1 << 24) // (127 * 127), 1 << 16
#: Added to bounds for the rounding of double precision.
SLACK = 1e-9


def unit(v: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled by powers of two first, so that no square leaves the range of doubles."""
    _, exponent = np.frexp(np.abs(v).max(1, keepdims=True, initial=0))
    v = np.ldexp(v, -exponent)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, s, e) of rows of length 1."""
    s = np.abs(u).max(1) / 127
    q = np.rint(u / s[:, None]).astype(np.int8)
    return q, s, np.sqrt(((u - s[:, None] * q) ** 2).sum(1)) + SLACK


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole-number products of all rows of two int8 tiles, exact."""
    out = np.zeros((len(a), len(b)))
    for i in range(0, a.shape[1], EXACT):
        out += a[:, i : i + EXACT].astype(np.float32) @ b[:, i : i + EXACT].astype(np.float32).T
    return out


def linked(a: tuple, b: tuple, u: np.ndarray, w: np.ndarray, threshold: float) -> tuple[np.ndarray, int]:
    """(matrix of links, number of pairs worked out in full) of two tiles: (q, s, e) and vectors of length 1 of each."""
    near = products(a[0], b[0]) * a[1][:, None] * b[1][None, :]
    most = a[2][:, None] + (1 + a[2])[:, None] * b[2][None, :] + SLACK
    found = near - most >= threshold
    i, j = np.nonzero((near + most >= threshold) & ~found)
    for k in range(0, len(i), PAIRS):
        x, y = i[k : k + PAIRS], j[k : k + PAIRS]
        found[x, y] = (u[x] * w[y]).sum(1) >= threshold
    return found, len(i)


def stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least one that it reaches over the edges (i, j)."""
    least = np.arange(n)
    while True:
        m = np.minimum(least[i], least[j])
        new = least.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        new = new[new]
        if (new == least).all():
            return least
        least = new


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_buffer(), np.float64) for x in column])


def placed(nodes: DataFrame, pivots: list[list[float]]) -> DataFrame:
    """node, label, dims, copies, v (bytes of the vector at length 1), q, s, e, home (nearest pivot), far (distance to each pivot)."""
    kind = dict(nodes.dtypes)["label"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            lengths = np.diff(column.offsets.to_numpy())
            for dims in np.unique(lengths):
                rows = batch.filter(pa.array(lengths == dims))
                u = unit(rows.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
                far = np.empty((len(u), len(pivots)))
                for k, p in enumerate(pivots):  # shorter vectors count as ending in zeros
                    p = unit(np.array([p]))[0]
                    n = min(dims, len(p))
                    far[:, k] = np.sqrt(np.maximum(0, 2 - 2 * (u[:, :n] @ p[:n])))
                q, s, e = quantised(u)
                yield pa.RecordBatch.from_pydict({
                    "node": rows.column("node"), "label": rows.column("label"), "dims": pa.array(np.full(len(u), dims, np.int32)), "copies": rows.column("copies"),
                    "v": pa.array([x.tobytes() for x in u], pa.binary()), "q": pa.array([x.tobytes() for x in q], pa.binary()), "s": pa.array(s), "e": pa.array(e),
                    "home": pa.array(far.argmin(1).astype(np.int32)), "far": pa.array(far.tolist(), pa.list_(pa.float64())),
                })

    return nodes.mapInArrow(run, f"node long, label {kind}, dims int, copies long, v binary, q binary, s double, e double, home int, far array<double>")


def meetings(rows: DataFrame, n_pivots: int, reach: float) -> tuple[DataFrame, DataFrame]:
    """(rows with their tile, (tile, x, y, side) for every two tiles x <= y that may hold a link; side 0: the tile alone, 1 and 2: one of two)."""
    cell = ["label", "dims", "home"]
    parts = stored(rows.groupBy(*cell).agg(F.ceil(F.count("*") / TILE).cast("long").alias("parts")))
    cut = rows.join(parts, cell).withColumn("part", F.pmod(F.xxhash64("node"), "parts")).drop("parts")
    ranges = [f(F.col("far")[k]).alias(f"{name}{k}") for k in range(n_pivots) for f, name in ((F.min, "low"), (F.max, "high"))]
    tiles = stored(cut.groupBy(*cell, "part").agg(*ranges).withColumn("tile", F.monotonically_increasing_id()))
    x, y = tiles.alias("x"), tiles.alias("y")
    apart = [F.col(f"{a}.low{k}") - F.col(f"{b}.high{k}") <= reach + SLACK for k in range(n_pivots) for a, b in ("xy", "yx")]
    same = (F.col("x.label") == F.col("y.label")) & (F.col("x.dims") == F.col("y.dims")) & (F.col("x.tile") <= F.col("y.tile"))
    pairs = stored(x.join(y, same & reduce(Column.__and__, apart)).select(F.col("x.tile").alias("x"), F.col("y.tile").alias("y")))
    wanted = pairs.select(F.col("x").alias("tile"), "x", "y", F.when(F.col("x") == F.col("y"), 0).otherwise(1).alias("side"))
    wanted = wanted.unionByName(pairs.filter("x < y").select(F.col("y").alias("tile"), "x", "y", F.lit(2).alias("side")))
    return cut.join(tiles.select(*cell, "part", "tile"), [*cell, "part"]).select("tile", "node", "copies", "v", "q", "s", "e"), wanted


def compared(rows: DataFrame, wanted: DataFrame, threshold: float) -> DataFrame:
    """(node, links, tie): per meeting and linked node the rows that it is linked with, and the least node it reaches."""

    def compare(group: pa.Table) -> pa.Table:
        sides = []
        side = group.column("side").to_numpy()
        for wants in ((0, 1), (0, 2)):
            part = group.filter(pa.array(np.isin(side, wants))).combine_chunks()
            q = np.stack([np.frombuffer(x.as_buffer(), np.int8) for x in part.column("q")]) if part.num_rows else np.zeros((0, 1), np.int8)
            u = _matrix(part.column("v")) if part.num_rows else np.zeros((0, 1))
            sides.append((part.column("node").to_numpy(), part.column("copies").to_numpy(), (q, part.column("s").to_numpy(), part.column("e").to_numpy()), u))
        (node_a, copies_a, a, u), (node_b, copies_b, b, w) = sides
        if not len(u) or not len(w):
            return pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "tie": pa.array([], pa.int64())})
        found, _ = linked(a, b, u, w, threshold)
        alone = not side.any()
        if alone:
            found = np.triu(found, 1)
        i, j = np.nonzero(found)
        links_a = np.bincount(i, copies_b[j], len(u))
        links_b = np.bincount(j, copies_a[i], len(w))
        if alone:
            nodes, links, least = node_a, links_a + links_b, stars(len(u), i, j)
        else:
            nodes, links, least = np.concatenate([node_a, node_b]), np.concatenate([links_a, links_b]), stars(len(u) + len(w), i, j + len(u))
        some = links > 0
        return pa.table({"node": pa.array(nodes[some]), "links": pa.array(links[some].astype(np.int64)), "tie": pa.array(nodes[least[some]])})

    return rows.join(wanted, "tile").drop("tile").groupBy("x", "y").applyInArrow(compare, "node long, links long, tie long")


def usable(vector: Column) -> Column:
    """The vector in double precision; NULL if it is NULL, empty, zero or holds NULL or what is not finite."""
    v = F.transform(vector.cast("array<double>"), lambda c: c + F.lit(0.0))  # -0.0 as 0.0
    fine = F.forall(v, lambda c: F.coalesce(c - c == 0, F.lit(False))) & F.exists(v, lambda c: c != 0)
    return F.when(F.coalesce(fine, F.lit(False)), v)


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable over links, itself included); a row per row.

    Rows are linked where labels are equal and not NULL, both vectors have the same number of components and their cosine
    is `threshold` or more.  Vectors that are NULL, empty, zero or hold NULL or non-finite components link with nothing.
    Equal vectors are linked; rows that repeat an id are rows of their own; rows with a NULL id take part (component_id
    is NULL where no row of the component has an id).  An empty table gives an empty one.  Other columns are left behind.
    """
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), usable(F.col(f"`{vector}`")).alias("v"))
    live = rows.filter("label IS NOT NULL AND v IS NOT NULL")
    nodes = stored(live.groupBy("label", "v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least")).withColumn("node", F.monotonically_increasing_id()))
    pivots = [r["v"] for r in nodes.orderBy(F.xxhash64("v"), "node").select("v").limit(PIVOTS).collect()]
    ready = stored(placed(nodes.select("node", "label", "v", "copies"), pivots))
    tiled, wanted = meetings(ready, len(pivots), math.sqrt(max(0.0, 2 - 2 * threshold))) if pivots else (None, None)
    spark = vectors.sparkSession
    found = stored(compared(tiled, wanted, threshold)) if pivots else spark.createDataFrame([], "node long, links long, tie long")
    labels = components(found.filter("node <> tie").select(F.col("node").alias("a"), F.col("tie").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    told = nodes.join(links, "node", "left").join(labels.withColumnRenamed("label", "component"), "node", "left")
    told = stored(told.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "least", F.coalesce("component", "node").alias("component")))
    lowest = told.groupBy("component").agg(F.min("least").alias("component_id"))
    told = told.join(lowest, "component").select("label", "v", "n_links", "component_id")
    alone = rows.filter("label IS NULL OR v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return live.join(told, ["label", "v"]).select("vec_id", "n_links", "component_id").unionByName(alone)
