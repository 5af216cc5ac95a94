"""Exact centroid clustering with space-filling-curve zone maps.

Vectors of whole numbers are ordered by their place on a Hilbert curve through
all dimensions and cut into blocks of BLOCK neighbours.  A block is one row: its
vectors and their box (least and most per component).  In every round the box
gives each centroid a least and a most distance to anything inside; a centroid
whose least exceeds another's most can be nearest to none of the block, and the
block's vectors are compared exactly with the others only.

A round reads the blocks where they lie, sends on one partial sum per task and
centroid and brings k rows to the driver.  All arithmetic is exact: 64-bit whole
numbers for distances, decimals for sums, whole division with floor.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteprism.llm.common import stored

#: Vectors in a block; bits of a component that place it on the curve.
BLOCK, BITS = 256, 4
#: Components from here on (either sign) would not let squared distances fit 64 bits.
MOST = 1 << 27


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points (rows) with components below 2 ** bits, as rows of bytes that sort like them."""
    n, dims = cells.shape
    x = cells.astype(np.uint32).T.copy()
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns of the coarser cells
        low = np.uint32(q - 1)
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, 0) ^ swap
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(n, np.uint32)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[dims - 1] & q) != 0, np.uint32(q - 1), np.uint32(0))
        q >>= 1
    x ^= turn
    spread = (x[None, :, :] >> np.arange(bits - 1, -1, -1, dtype=np.uint32)[:, None, None]) & 1  # bit, component, point
    return np.packbits(spread.reshape(bits * dims, n).T.astype(np.uint8), axis=1)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def whole(vectors: DataFrame, dims: int, scale: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x): vectors of `dims` components, none NULL or non-finite, as floor(scale * component).

    Vectors with a component of MOST or more after scaling are left out too: their distances have no 64-bit value.
    """
    v = F.col(f"`{vector}`").cast("array<double>")
    # x - x is NULL or NaN just for NULL and what is not finite
    fits = (F.size(v) == dims) & F.forall(v, lambda c: F.coalesce((c - c == 0) & (F.abs(c) * scale < MOST - 1), F.lit(False)))
    x = F.transform(v, lambda c: F.floor(c * scale).cast("long"))
    return vectors.filter(v.isNotNull() & F.coalesce(fits, F.lit(False))).select(F.col(f"`{vec_id}`").alias("vec_id"), x.alias("x"))


def blocks(rows: DataFrame, dims: int) -> DataFrame:
    """A row per block: ids (list of vec_id), data (64-bit components, row by row), low and high (box).

    Blocks never reach over a partition of the order, so each has BLOCK vectors, but for the last of a partition.
    """
    kind = dict(rows.dtypes)["vec_id"]
    bounds = rows.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.min("c").alias("low"), F.max("c").alias("high")).orderBy("i").collect()  # dims rows
    low = np.array([r["low"] for r in bounds], np.float64)
    step = np.array([max(1, r["high"] - r["low"] + 1) for r in bounds], np.float64)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = np.floor((matrix(batch.column("x"), dims) - low) / step * (1 << BITS))
                keys = hilbert(np.clip(cells, 0, (1 << BITS) - 1), BITS)
                yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "x": batch.column("x"), "place": pa.array([k.tobytes() for k in keys], pa.binary())})

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def packed(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            x = matrix(rows.column("x").chunk(0), dims).astype(np.int64)
            parts = [slice(a, a + BLOCK) for a in range(0, len(x), BLOCK)]
            ids = rows.column("vec_id").chunk(0)
            whole_list = lambda f: pa.array([f(x[p]).tolist() for p in parts], pa.list_(pa.int64()))
            offsets = pa.array([p.start for p in parts] + [len(x)], pa.int32())
            return pa.RecordBatch.from_pydict({"ids": pa.ListArray.from_arrays(offsets, ids), "data": pa.array([x[p].tobytes() for p in parts], pa.binary()), "low": whole_list(lambda b: b.min(0)), "high": whole_list(lambda b: b.max(0))})

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            full = held.num_rows // BLOCK * BLOCK
            if full:
                yield packed(held.slice(0, full))
                held = held.slice(full)
        if held is not None and held.num_rows:
            yield packed(held)

    placed = rows.mapInArrow(place, f"vec_id {kind}, x array<long>, place binary")
    ordered = stored(placed).repartitionByRange("place", "vec_id").sortWithinPartitions("place", "vec_id")
    return stored(ordered.select("vec_id", "x").mapInArrow(cut, f"ids array<{kind}>, data binary, low array<long>, high array<long>"))


def candidates(low: np.ndarray, high: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to a vector in the box, rising."""
    outside = np.maximum(np.maximum(low - centers, centers - high), 0)
    least = (outside * outside).sum(1)
    across = np.maximum(np.abs(centers - low), np.abs(centers - high))
    return np.flatnonzero(least <= (across * across).sum(1).min())


def nearest(x: np.ndarray, centers: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, squared distance) of each vector among the candidates; the smaller number at ties."""
    apart = np.stack([((x - centers[c]) ** 2).sum(1) for c in near])
    best = apart.argmin(0)
    return near[best], apart[best, np.arange(len(x))]


def _unpacked(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    lows, highs = matrix(batch.column("low"), dims), matrix(batch.column("high"), dims)
    for data, low, high in zip(batch.column("data"), lows, highs):
        yield np.frombuffer(data.as_buffer(), np.int64).reshape(-1, dims), low, high


def sums(held: DataFrame, centers: np.ndarray) -> DataFrame:
    """(cluster, n, s0, s1, ...): vectors and sum per component of every centroid that is nearest to any."""
    k, dims = centers.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), object)
        for batch in batches:
            for x, low, high in _unpacked(batch, dims):
                of, _ = nearest(x, centers, candidates(low, high, centers))
                for c in np.unique(of):
                    own = x[of == c]
                    count[c] += len(own)
                    total[c] += own.sum(0)
        some = np.flatnonzero(count)
        if len(some):
            texts = [pa.array([str(total[c, i]) for c in some], pa.string()) for i in range(dims)]
            yield pa.RecordBatch.from_pydict({"cluster": pa.array(some, pa.int32()), "n": pa.array(count[some])} | {f"s{i}": t for i, t in enumerate(texts)})

    parts = held.select("data", "low", "high").mapInArrow(run, "cluster int, n long, " + ", ".join(f"s{i} string" for i in range(dims)))
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col(f"s{i}").cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)])


def first_centers(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ids have the least hashes, by hash; rows without an id start none, rows that repeat one go by components."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return np.array([r["x"] for r in rows.filter("vec_id IS NOT NULL").orderBy(hashed, "x").select("x").limit(k).collect()], np.int64)


def cluster(vectors: DataFrame, k: int, rounds: int, dims: int, scale: int = 1024, seed: int = 3, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared, to the final centroid), cluster_inertia, inertia, centroid (final components); a row per kept vector.

    Kept are vectors of `dims` components, none NULL or non-finite (see `whole`).  `rounds` times every vector goes to its nearest
    centroid (the smaller number at ties) and every centroid with vectors to the floor of their mean; then vectors are
    assigned once more.  Repeated rows and equal vectors count as often as they come; NULL ids take part.  Fewer than k
    rows with an id give fewer centroids; without any, and for an empty table, the result is empty.  Other columns are left behind.
    """
    rows = stored(whole(vectors, dims, scale, vec_id, vector))
    kind = dict(rows.dtypes)["vec_id"]
    shape = f"vec_id {kind}, cluster int, distance long"
    centers = first_centers(rows, k, seed)
    if not len(centers):
        return rows.sparkSession.createDataFrame([], f"{shape}, cluster_inertia long, inertia long, centroid array<long>")
    held = blocks(rows, dims)
    for _ in range(rounds):
        centers = centers.copy()
        for r in sums(held, centers).collect():  # k rows at most
            centers[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dims)]

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch.column("ids").offsets.to_numpy())
            ids = batch.column("ids").flatten()
            found = [nearest(x, centers, candidates(low, high, centers)) for x, low, high in _unpacked(batch, dims)]
            if len(lengths):
                yield pa.RecordBatch.from_pydict({"vec_id": ids, "cluster": pa.array(np.concatenate([f[0] for f in found]).astype(np.int32)), "distance": pa.array(np.concatenate([f[1] for f in found]))})

    assigned = stored(held.mapInArrow(assign, shape))
    per = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows at most
    finals = [(c, per[c], sum(per.values()), centers[c].tolist()) for c in sorted(per)]
    return assigned.join(F.broadcast(assigned.sparkSession.createDataFrame(finals, "cluster int, cluster_inertia long, inertia long, centroid array<long>")), "cluster")
