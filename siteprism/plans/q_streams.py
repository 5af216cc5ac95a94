"""Monitors over the events read as a stream; each gives the rows of its batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteprism.plans.q_monitor import _CHK, _RECURSIVE
from siteprism.plans.registry import query, table
from siteprism.streaming import monitors as S

#: Files read at once, which bounds what waits in a key's state while old data is caught up with.
FILES = 64


def events(spark: SparkSession, sf: str) -> DataFrame:
    stream = spark.readStream.schema(table(spark, sf, "events").schema).option("maxFilesPerTrigger", FILES)
    # a pattern, as a stream takes a plain path for a folder and the table may be one file
    return stream.parquet(f"{sf}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def checks(spark: SparkSession, sf: str) -> DataFrame:
    """Events as checks of a site, as in the batch queries."""
    return events(spark, sf).select(F.col("user_id").alias("site_id"), F.col("event_id").alias("check_id"), F.col("ts").alias("checked_at"), (F.col("event_type") != "error").alias("is_up"))


def _naive(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.col(column).cast("timestamp_ntz"))


@query(
    "u01_sliding_rate_limit_stream",
    f"WITH RECURSIVE {_RECURSIVE.format(key='event_type', limit=5, w=3600 * 1_000_000)} SELECT k AS endpoint, make_timestamp(us) AS ts, allowed, current::INT AS current FROM run",
)
def u01_stream(spark: SparkSession, sf: str) -> DataFrame:
    return _naive(S.drained(S.rate_limited(events(spark, sf).select(F.col("event_type").alias("endpoint"), "ts"), ["endpoint"], 5, 3600)), "ts")


@query(
    "m10_cooldown_stream",
    f"WITH RECURSIVE {_RECURSIVE.format(key='user_id', limit=1, w=86400 * 1_000_000)} SELECT k AS rule_id, make_timestamp(us) AS created_at FROM run WHERE allowed",
)
def m10_stream(spark: SparkSession, sf: str) -> DataFrame:
    return _naive(S.drained(S.cooled_alerts(events(spark, sf).select(F.col("user_id").alias("rule_id"), F.col("ts").alias("created_at")), 1440)), "created_at")


@query(
    "m05_failure_runs_stream",
    f"""WITH {_CHK}, r AS (SELECT site_id, checked_at, check_id, count_if(NOT is_up) OVER (PARTITION BY site_id ORDER BY checked_at, check_id ROWS 2 PRECEDING) AS down FROM chk)
    SELECT site_id, checked_at, check_id AS seq, 3 AS failures FROM r WHERE down = 3""",
)
def m05_stream(spark: SparkSession, sf: str) -> DataFrame:
    return _naive(S.drained(S.failure_runs(checks(spark, sf), 3, "check_id")), "checked_at")


@query(
    "m02_daily_uptime_stream",
    f"""WITH {_CHK} SELECT site_id, date_trunc('day', checked_at)::TIMESTAMP AS day, count(*) AS total, count_if(is_up) AS up, 100.0::DOUBLE * count_if(is_up) / count(*) AS uptime FROM chk GROUP BY ALL""",
)
def m02_stream(spark: SparkSession, sf: str) -> DataFrame:
    return _naive(S.drained(S.daily_uptime(checks(spark, sf)), ["site_id", "day"]), "day")
