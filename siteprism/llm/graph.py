"""Connected components of a large edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteprism.llm.common import checkpointed


def _with_least(edges: DataFrame) -> DataFrame:
    """Adds m: the smallest of u and its v (a partial aggregate, then a join that Spark may split at hubs)."""
    least = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return edges.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of `edges` (columns a, b of one orderable type); label is the component's smallest node.

    Alternates two steps until nothing changes: every node hands its larger neighbours to its smallest one, then every
    node hands its smaller neighbours (and itself) to its smallest one.  Stars come out; rounds grow with the logarithm
    of the number of nodes.  Every round is checkpointed and told from the one before by its number of edges and the sum
    of their hashes.  Nodes with NULL are left out; an empty table gives an empty one.
    """
    now = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        small = _with_least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        now = checkpointed(small)
        got = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if got == seen:
            break
        seen = got
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
