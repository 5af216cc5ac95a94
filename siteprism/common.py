"""Shared building blocks: session, top-k, materialisation, rounding.

Every per-group "first N" in the package goes through :func:`top_k`.  Spark
turns ``row_number() <= k`` into a group limit that runs *before* the shuffle,
so a site holding a third of all rows sends at most k rows per map task.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEVERITY_ORDER = ["low", "medium", "high", "critical"]


def session(app: str = "siteprism", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans are written for (all overridable)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.ui.enabled": "false",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def stage_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster in spark.checkpoint.dir.

    Where none is named, a temporary folder serves a session on one machine; a cluster without one is refused, as its
    executors would write to disks that nobody else reads.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate table once and read it back column by column.

    Used where several branches need the same expensive columns (HTML features)
    and inside the breadth-first loop, where lineage would otherwise grow.
    """
    spark = df.sparkSession
    path = f"{stage_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "_rn") -> DataFrame:
    """First k rows of each group in the given order, with their rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def first_n(df: DataFrame, keys: list[str], buckets: dict[str, Column], order: list[Column], n: int) -> DataFrame:
    """First n rows per group for a large n, without sorting a group in one task.

    ``buckets`` are coarse columns that agree with the wanted order.  Counts per
    (group, bucket) show which buckets lie wholly inside the limit; only rows
    of one bucket are ever ranked together.
    """
    placed = df.withColumns(buckets)
    names = list(buckets)
    counts = placed.groupBy(*keys, *names).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*keys, *names, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    kept = placed.join(before.filter(F.col("_before") < n), [*keys, *names])
    inner = Window.partitionBy(*keys, *names).orderBy(*order)
    ranked = kept.withColumn("_rn", F.row_number().over(inner))
    return ranked.filter(F.col("_rn") <= n - F.col("_before")).select(*df.columns)


def running_total(
    df: DataFrame, keys: list[str], bucket: Column, order: list[Column], value: Column, name: str
) -> DataFrame:
    """Inclusive running total per group in two levels.

    Totals per (group, bucket) are summed up first (few rows per group); only
    rows of one bucket are ordered together, so a huge group is split.
    ``bucket`` must agree with ``order``.
    """
    placed = df.withColumns({"_b": bucket, "_v": value})
    sums = placed.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s"))
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*keys, "_b", F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(before, [*keys, "_b"])
    return joined.withColumn(name, F.col("_before") + F.sum("_v").over(inner)).select(*df.columns, name)


def ordered_list(value: Column, *order: Column) -> Column:
    """Values of a (bounded) group as an array, in the given ascending order."""
    names = [f"o{i}" for i in range(len(order))]
    packed = F.struct(*[o.alias(n) for o, n in zip(order, names)], value.alias("v"))
    return F.transform(F.array_sort(F.collect_list(packed)), lambda x: x["v"])


def blank(c: Column) -> Column:
    """True for NULL and '' alike."""
    return F.coalesce(c, F.lit("")) == ""


def falsy_zero(c: Column) -> Column:
    """NULL where the value is NULL or 0."""
    return F.when(c != 0, c)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times inside `body`.

    Catalyst does not share sub-expressions across conditional branches or
    inside lambdas, so an expensive regex result is bound to a lambda variable.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def spread(df: DataFrame, per_core: int = 1) -> DataFrame:
    """Split a scan with fewer tasks than `per_core` for each core before CPU-heavy row work.

    Only small inputs are affected; a scan of many files is left as it is, so
    wide text is never shuffled at scale.
    """
    tasks = per_core * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def finer(df: DataFrame, *keys: str, times: int = 8) -> DataFrame:
    """Deal a scan's rows by `keys` to `times` as many tasks as it has, before they are grouped by these keys.

    What a task groups and sorts is then a part of one scan task's rows, whatever the size of the table.  Worth it where
    few rows share a group: partial groups of a scan task would be as many as its rows.
    """
    return df.repartition(times * df.rdd.getNumPartitions(), *keys)


def severity_rank(c: Column) -> Column:
    """low 1 … critical 4, by position in the enum; NULL for anything else."""
    out = F.lit(None).cast("int")
    for i, s in enumerate(SEVERITY_ORDER):
        out = F.when(c == s, F.lit(i + 1)).otherwise(out)
    return out


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small constant dimension (rule and quota tables), safe to broadcast."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def intdiv(a: Column, b: Column) -> Column:
    """Floor division of two non-negative numbers as BIGINT."""
    return F.floor(a / b).cast("bigint")
