"""Topics per site: all sites are clustered at once, each by its own keywords.

Keywords are sparse vectors of whole numbers (hashed TF-IDF of a site's texts,
or given vectors), so distances and means are exact.  A site's keywords are cut
into blocks and its centroids are one row, joined to its blocks by site: rows
never meet rows, centroids travel once for each block instead of each keyword,
and blocks give partial sums per (site, cluster, dimension).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteprism.common import materialize

#: Dimensions that words are hashed to; whole numbers that stand for 1.
DIMS, SCALE = 1024, 1024
#: Keywords in a block, on average; its components are arrays of its own.
BLOCK = 1024
_SPARSE = "array<struct<i:int,v:bigint>>"


def text_vectors(keywords: DataFrame, dims: int = DIMS) -> DataFrame:
    """(site_id, keyword_id, x): per hashed word its count in the text times ln((keywords + 1) / (keywords with it + 1)) of the site."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != "")
    place = (F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("bigint") % dims).cast("int")
    found = keywords.select("site_id", "keyword_id", F.explode(words).alias("word")).withColumn("i", place)
    counts = found.groupBy("site_id", "keyword_id", "i").agg(F.count("*").alias("tf"))
    spread = counts.groupBy("site_id", "i").agg(F.count("*").alias("df"))
    sizes = keywords.groupBy("site_id").agg(F.count("*").alias("n"))
    value = F.floor(SCALE * F.col("tf") * F.log((F.col("n") + 1) / (F.col("df") + 1)) + 0.5).cast("bigint")
    weights = counts.join(spread, ["site_id", "i"]).join(sizes, "site_id").select("site_id", "keyword_id", "i", value.alias("v"))
    packed = weights.filter("v <> 0").groupBy("site_id", "keyword_id").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("x"))
    return keywords.select("site_id", "keyword_id").join(packed, ["site_id", "keyword_id"], "left").withColumn("x", F.coalesce("x", F.array().cast(_SPARSE)))


def given_vectors(keywords: DataFrame, column: str) -> DataFrame:
    """(site_id, keyword_id, x) of an array column; NULL counts as zeros, as do components that are NULL or not finite."""
    whole = F.transform(F.col(column), lambda v, i: F.struct(i.alias("i"), F.when(v - v == 0, F.floor(v.cast("double") * SCALE)).cast("bigint").alias("v")))
    return keywords.select("site_id", "keyword_id", F.coalesce(F.filter(whole, lambda p: p["v"] != 0), F.array().cast(_SPARSE)).alias("x"))


def blocks(rows: DataFrame) -> DataFrame:
    """(site_id, ids, sizes, i, v) from rows (site_id, keyword_id, x, n): up to some BLOCK keywords of a site of n, by id."""
    part = F.pmod(F.xxhash64("keyword_id"), F.ceil(F.col("n") / BLOCK))
    packed = rows.groupBy("site_id", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("keyword_id", "x"))).alias("r"))
    x = F.transform("r", lambda r: r["x"])
    return packed.select(
        "site_id", F.col("r.keyword_id").alias("ids"), F.transform(x, F.size).alias("sizes"),
        F.flatten(F.transform(x, lambda c: c["i"])).alias("i"), F.flatten(F.transform(x, lambda c: c["v"])).alias("v"),
    )


def _apart(ends: np.ndarray, sizes: np.ndarray, i: np.ndarray, v: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of a block's keywords to all centers, a column each."""
    out = np.empty((len(ends), len(centers)), np.int64)
    for n, c in enumerate(centers):
        total = np.concatenate([[0], np.cumsum(v * (v - 2 * c[i]))])
        out[:, n] = c @ c + total[ends] - total[ends - sizes]
    return out


def _per_block(held: DataFrame, centers: DataFrame, dims: int, work: Callable[..., dict | None], schema: str) -> DataFrame:
    """`work(ids, ends, i, v, distances)` → columns of a block's result, to which its site is added."""
    site = f"site_id {dict(held.dtypes)['site_id']}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                sizes, i, v = (batch.column(c)[row].values.to_numpy() for c in ("sizes", "i", "v"))
                taken = batch.column("centers")[row].values
                dense = np.zeros((len(taken), dims), np.int64)
                for n, c in enumerate(taken):
                    dense[n, c.values.field("i").to_numpy()] = c.values.field("v").to_numpy()
                ends = np.cumsum(sizes)
                out = work(batch.column("ids")[row].values, ends, i, v, _apart(ends, sizes, i, v, dense))
                if out is not None:
                    yield pa.RecordBatch.from_pydict({"site_id": pa.repeat(batch.column("site_id")[row], len(next(iter(out.values())))), **out})

    return held.join(centers, "site_id").mapInArrow(run, f"{site}, {schema}")


def farthest_first(held: DataFrame, k: int, dims: int) -> DataFrame:
    """(site_id, centers): a site's first keyword by id, then each time the one farthest from all taken so far (least id at ties).

    A site with fewer than k different vectors gets fewer.
    """
    own = dict(held.dtypes)["ids"].removeprefix("array<")[:-1]

    def farthest(ids: pa.Array, ends: np.ndarray, i: np.ndarray, v: np.ndarray, far: np.ndarray) -> dict | None:
        least = far.min(1)
        at = int(least.argmax())  # the first in the order of ids
        if not least[at] > 0:
            return None
        own = slice(int(ends[at - 1]) if at else 0, int(ends[at]))
        return {"least": pa.array([least[at]]), "keyword_id": ids[at : at + 1], "i": pa.array([i[own]], pa.list_(pa.int32())), "v": pa.array([v[own]], pa.list_(pa.int64()))}

    vector = F.arrays_zip("i", "v").cast(_SPARSE)
    size = F.element_at("sizes", 1)
    first = held.select("site_id", F.col("ids")[0].alias("keyword_id"), F.slice("i", F.lit(1), size).alias("i"), F.slice("v", F.lit(1), size).alias("v"))
    centers = materialize(first.groupBy("site_id").agg(F.min_by(vector, "keyword_id").alias("x")).select("site_id", F.array("x").alias("centers")))
    for _ in range(k - 1):
        far = _per_block(held, centers, dims, farthest, f"least bigint, keyword_id {own}, i array<int>, v array<bigint>")
        far = far.groupBy("site_id").agg(F.min_by(vector, F.struct(-F.col("least"), "keyword_id")).alias("x"))
        more = F.when(F.col("x").isNotNull(), F.concat("centers", F.array("x"))).otherwise(F.col("centers"))
        centers = materialize(centers.join(far, "site_id", "left").select("site_id", more.alias("centers")))
    return centers


def moved(held: DataFrame, centers: DataFrame, dims: int) -> DataFrame:
    """Centers at the floor of the mean of the rows nearest to them (the smaller number at ties); those without rows stay."""

    def sums(ids: pa.Array, ends: np.ndarray, i: np.ndarray, v: np.ndarray, far: np.ndarray) -> dict:
        near = far.argmin(1)
        total = np.zeros((far.shape[1], dims + 1), np.int64)
        total[:, dims] = np.bincount(near, minlength=len(total))  # keywords, behind the dimensions
        np.add.at(total, (np.repeat(near, np.diff(ends, prepend=0)), i), v)
        cluster, at = total.nonzero()
        return {"cluster": pa.array(cluster, pa.int32()), "i": pa.array(at, pa.int32()), "s": pa.array(total[cluster, at])}

    got = _per_block(held, centers, dims, sums, "cluster int, i int, s bigint").groupBy("site_id", "cluster", "i").agg(F.sum("s").alias("s"))
    listed = got.groupBy("site_id", "cluster").agg(F.collect_list(F.struct("i", "s")).alias("p"), F.max(F.when(F.col("i") == dims, F.col("s"))).alias("n"))
    means = F.expr(f"transform(filter(p, q -> q.i < {dims}), q -> named_struct('i', q.i, 'v', (q.s - pmod(q.s, n)) div n))")
    new = listed.select("site_id", "cluster", F.filter(means, lambda q: q["v"] != 0).cast(_SPARSE).alias("x"))
    old = centers.select("site_id", F.posexplode("centers").alias("cluster", "old"))
    both = old.join(new, ["site_id", "cluster"], "left").withColumn("new", F.coalesce("x", "old"))
    ordered = F.array_sort(F.collect_list(F.struct("cluster", "new")))  # k of them at most
    return materialize(both.groupBy("site_id").agg(F.transform(ordered, lambda p: p["new"]).alias("centers")))


def _labels(ids: pa.Array, ends: np.ndarray, i: np.ndarray, v: np.ndarray, far: np.ndarray) -> dict:
    return {"keyword_id": ids, "cluster": pa.array(far.argmin(1), pa.int32())}


def topic_clusters(keywords: DataFrame, k: int = 8, rounds: int = 5, features: str | None = None, dims: int = DIMS) -> DataFrame:
    """``keywords(site_id, keyword_id, text)`` → site_id, keyword_id, cluster_label: "topic_<n>" among its site's own, or "mixed" for sites with fewer than three.

    ``features`` names an array of numbers of up to ``dims`` components to use instead of the text.  Starts are taken
    farthest first, then `rounds` times keywords go to the nearest centroid and centroids to the floor of the mean.
    """
    ids = keywords.filter("site_id IS NOT NULL AND keyword_id IS NOT NULL")
    sizes = ids.groupBy("site_id").agg(F.count("*").alias("n"))
    rows = given_vectors(ids, features) if features else text_vectors(ids, dims)
    rows = materialize(rows.join(sizes, "site_id"))
    few = rows.filter("n < 3").select("site_id", "keyword_id", F.lit("mixed").alias("cluster_label"))
    held = materialize(blocks(rows.filter("n >= 3")))
    centers = farthest_first(held, k, dims)
    for _ in range(rounds):
        centers = moved(held, centers, dims)
    found = _per_block(held, centers, dims, _labels, f"keyword_id {dict(rows.dtypes)['keyword_id']}, cluster int")
    return found.select("site_id", "keyword_id", F.concat(F.lit("topic_"), F.col("cluster").cast("string")).alias("cluster_label")).unionByName(few)
