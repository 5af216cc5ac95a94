"""Merkle manifest of a table by nested-interval labels.

Every node carries the interval [low, high) of leaf ranks that it covers in its
tree, so a tree is a flat table and no node points at another.  Level k holds
intervals of fanout ** k ranks, and the bucket of a rank there is
rank div fanout ** k:

* build: BAND levels at a time; nodes meet by the bucket that the band's last
  level gives them (fanout ** BAND nodes at most) and become parents, which keep
  the intervals and digests of their children;
* ancestors: a node meets its ancestors of a band by (tree, level, bucket) and
  containment, so a key holds the nodes below one parent at most;
* siblings: what a parent's children cover less the interval of the one that
  holds the node itself; those before and those after it stay apart;
* a leaf's path is its path inside its band, then that of its ancestor at the
  band's end, and so on: upper paths are worked out once for all leaves below.

All of it is built-in functions; hot trees are spread by rank.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteprism.llm.common import stored

FANOUT, BAND = 2, 8
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: The tree over the roots of all groups.
TOP = "top"


def leaf_digest(fields: list[Column]) -> Column:
    """Digest of values: `-` for NULL, else the value's length in UTF-8 bytes, a colon and the value."""
    said = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*said), 256)


def group_key(group: Column) -> Column:
    """A group's name that is never NULL and sorts as groups do: NULL first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


def ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Adds low and high (rank and rank + 1 inside the tree) and n (rows of the tree); NULL sorts first.

    Rows are dealt by ranges of (tree, order), so no tree is sorted in one task; what is summed in order are the counts
    of a tree's ranges.
    """
    keys = [F.col(c).asc_nulls_first() for c in (tree, *order)]
    placed = rows.repartitionByRange(*keys, F.monotonically_increasing_id()).sortWithinPartitions(*keys)
    placed = stored(placed.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("at", 33)
    counts = placed.groupBy(tree, part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy(tree)
    before = F.coalesce(F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(tree, "part", "first", before.alias("before"), F.sum("rows").over(whole).alias("n"))
    joined = placed.withColumn("part", part).join(counts, [tree, "part"])
    low = F.col("at") - F.col("first") + F.col("before")
    return joined.withColumns({"low": low, "high": low + 1}).drop("at", "part", "first", "before")


def _parents(nodes: Column, fanout: int) -> Column:
    """Runs of `fanout` neighbours of a sorted array of nodes as their parents, with children."""

    def parent(i: Column) -> Column:
        run = F.slice(nodes, i * fanout + 1, F.lit(fanout))
        return F.struct(
            run[0]["low"].alias("low"), F.element_at(run, -1)["high"].alias("high"),
            F.sha2(F.array_join(F.transform(run, lambda x: x["digest"]), ""), 256).alias("digest"), run.alias("children"),
        )

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fanout).cast("int")), parent)


def band_of_parents(base: DataFrame, level: int, fanout: int, band: int) -> DataFrame:
    """Parents of the levels level + 1 to level + band above `base` (tree, n, low, high, digest), as far as the trees reach.

    Columns: tree, n, level, low, high, digest, children (low, high, digest).
    """
    node = F.struct("low", "high", "digest")
    now = base.groupBy("tree", "n", F.floor(F.col("low") / fanout ** (level + band)).alias("bucket")).agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    made = []
    for k in range(1, band + 1):
        now = now.withColumn(f"p{k}", _parents(F.col("nodes"), fanout))
        now = now.withColumn("nodes", F.transform(f"p{k}", lambda x: F.struct(x["low"], x["high"], x["digest"])))
        # a tree ends with the level that has one node
        made.append(F.when(F.col("n") > fanout ** (level + k - 1), F.transform(f"p{k}", lambda x: F.struct(F.lit(level + k).alias("level"), x.alias("node")))))
    rows = now.select("tree", "n", F.explode(F.flatten(F.array_compact(F.array(*made)))).alias("row"))
    return rows.select("tree", "n", "row.level", "row.node.*")


def band_paths(base: DataFrame, parents: DataFrame, level: int, fanout: int, band: int) -> DataFrame:
    """(tree, low, path): for each node of `base` its levels in the band, each as (level, before, after): joined digests of the siblings."""
    levels = F.filter(F.sequence(F.lit(level + 1), F.lit(level + band)), lambda k: F.col("n") > F.pow(F.lit(fanout), k - 1))
    asked = base.select("tree", "low", F.explode(levels).alias("level"))
    bucket = F.floor(F.col("low") / F.pow(F.lit(fanout), F.col("level"))).cast("long")
    left = asked.withColumn("bucket", bucket).alias("a")
    right = parents.withColumn("bucket", bucket).alias("p")
    contained = (F.col("p.low") <= F.col("a.low")) & (F.col("a.low") < F.col("p.high"))
    met = left.join(right, (F.col("a.tree") == F.col("p.tree")) & (F.col("a.level") == F.col("p.level")) & (F.col("a.bucket") == F.col("p.bucket")) & contained)
    own = F.col("a.low")

    def joined(side) -> Column:
        return F.unhex(F.array_join(F.transform(F.filter("p.children", side), lambda x: x["digest"]), ""))

    step = F.struct(F.col("a.level").alias("level"), joined(lambda x: x["high"] <= own).alias("before"), joined(lambda x: x["low"] > own).alias("after"))
    return met.select("a.tree", "a.low", step.alias("step")).groupBy("tree", "low").agg(F.array_sort(F.collect_list("step")).alias("path"))


def _no_path() -> Column:
    return F.array().cast("array<struct<level: int, before: binary, after: binary>>")


@dataclass
class Forest:
    """nodes: tree, n, level, low, high, digest, children (empty at leaves); roots: tree, digest.

    steps: per band its first level and (tree, low, path) of the nodes there.
    """

    nodes: DataFrame
    roots: DataFrame
    steps: list[tuple[int, DataFrame]]
    fanout: int

    def with_paths(self, leaves: DataFrame) -> DataFrame:
        """Adds path (from the leaf up) to rows with tree and low, which are moved for their first band and together with that path."""
        path, above = _no_path(), None
        for level, found in reversed(self.steps[1:]):  # a node stands for all leaves below, so these tables are small
            above = found if above is None else self._continued(found, above, level)
        if self.steps:
            leaves = leaves.join(self.steps[0][1], ["tree", "low"], "left")
            path = F.coalesce("path", _no_path())
        leaves = leaves.withColumn("path", path)
        return leaves if above is None else self._continued(leaves, stored(above), 0)

    def _continued(self, rows: DataFrame, above: DataFrame, level: int) -> DataFrame:
        size = self.fanout ** (level + BAND)
        up = above.select("tree", F.col("low").alias("up"), F.col("path").alias("rest"))
        joined = rows.withColumn("up", F.floor(F.col("low") / size).cast("long") * size).join(up, ["tree", "up"], "left")
        return joined.withColumn("path", F.concat("path", F.coalesce("rest", _no_path()))).drop("up", "rest")


def forest(leaves: DataFrame, fanout: int = FANOUT) -> Forest:
    """Trees over ranked leaves (tree, n, low, high, digest).  A tree of one leaf has it as its root and an empty path."""
    kinds = "array<struct<low: bigint, high: bigint, digest: string>>"
    base = leaves.select("tree", "n", "low", "high", "digest")
    nodes = base.select("tree", "n", F.lit(0).alias("level"), "low", "high", "digest", F.array().cast(kinds).alias("children"))
    steps, level = [], 0
    most = base.agg(F.max("n").alias("n")).first()["n"] or 0
    while fanout**level < most:
        live = base.filter(F.col("n") > fanout**level)
        parents = stored(band_of_parents(live, level, fanout, BAND))
        steps.append((level, stored(band_paths(live, parents, level, fanout, BAND))))
        nodes = nodes.unionByName(parents)
        level += BAND
        base = parents.filter(F.col("level") == level).drop("level", "children")
    tops = nodes.filter("low = 0 and high = n").withColumn("turn", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("level"))))
    return Forest(nodes, tops.filter("turn = 1").select("tree", "digest"), steps, fanout)


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda d, s: F.sha2(F.concat(_hex(s["before"]), d, _hex(s["after"])), 256))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: _hex(F.concat(s["before"], s["after"]))), ""), 256)


@dataclass
class Manifest:
    """leaves: the input's columns but text, leaf, leaf_now, subroot, root, path; nodes: all nodes (tree is a group's name, see `group_key`, or TOP)."""

    leaves: DataFrame
    nodes: DataFrame


def manifest(docs: DataFrame, fields: list[str] = FIELDS, group: str = "lang", order: str = "doc_id", now: dict[str, Column] | None = None, fanout: int = FANOUT) -> Manifest:
    """A Merkle tree per group, their roots in a top tree, and every row's path of siblings up to the top root.

    Leaves are digests of `fields` and ascend by `order` (NULL first; rows that repeat it by digest; equal rows are
    leaves of their own).  NULL values and NULL groups count as values of their own; empty and long texts are hashed
    whole; other columns are left behind.  An empty table gives empty tables.  `now` replaces fields by what they hold
    today; `leaf_now` is the leaf of that state.
    """
    changed = {c: F.col(f"`{c}`") for c in fields} | (now or {})
    rows = docs.select(
        F.col(f"`{order}`").alias("order_key"), group_key(F.col(f"`{group}`")).alias("tree"),
        leaf_digest([F.col(f"`{c}`") for c in fields]).alias("digest"), leaf_digest([changed[c] for c in fields]).alias("leaf_now"),
    )
    leaves = stored(ranked(rows, "tree", ["order_key", "digest"]))
    lower = forest(leaves, fanout)
    tops = stored(ranked(lower.roots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), "digest"), "tree", ["name"]))
    upper = forest(tops, fanout)
    subroots = upper.with_paths(tops).join(upper.roots.withColumnRenamed("digest", "root"), "tree")
    subroots = stored(subroots.select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", F.col("path").alias("above")))
    out = lower.with_paths(leaves).join(subroots, "tree")
    shown = [F.col("order_key").alias(order), F.col("digest").alias("leaf"), "leaf_now", "subroot", "root", F.concat("path", "above").alias("path")]
    return Manifest(out.select(*shown), lower.nodes.unionByName(upper.nodes))


def checked(found: Manifest) -> DataFrame:
    """Adds proof_sha256, folded_root (from leaf_now and the path) and verified; the path stays."""
    out = found.leaves.withColumns({"proof_sha256": proof_digest(F.col("path")), "folded_root": folded(F.col("leaf_now"), F.col("path"))})
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
