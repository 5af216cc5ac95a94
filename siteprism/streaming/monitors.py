"""Streaming forms of the polled monitors: state over event time per key.

Rows are decided in event-time order, however they arrive: a key's rows wait in
its state until the watermark has passed them (a timer at the earliest one), so
late and shuffled rows up to the watermark's delay change nothing.  A second
timer clears what a key remembers once nothing to come can depend on it.  State
lives in RocksDB; rows later than the delay are dropped by Spark, rows of one
millisecond that arrive after the watermark reached it are decided after those
before.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siteprism.common import stage_dir
from siteprism.operators.limits import decided_in_order

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InEventTime(StatefulProcessor):
    """Hands a key's rows (columns us, seq, up) over in order of (us, seq), once the watermark has passed them.

    `memory` is what a key remembers, as a list of whole numbers; subclasses say in `step` what rows make of it, and in
    `until` when it may go (microseconds).
    """

    def __init__(self, names: list[str]) -> None:
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, seq long, up boolean")
        self.memory = handle.getValueState("memory", "items array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            new = list(zip(pdf["us"].tolist(), pdf["seq"].tolist(), pdf["up"].tolist()))
            if new:
                first = min(first or new[0], min(new))
                self.waiting.appendList(new)
        if first:
            self.handle.registerTimer(first[0] // 1000)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        reached = timerValues.getCurrentWatermarkInMs()
        rows = pd.DataFrame(list(self.waiting.get()), columns=["us", "seq", "up"]).sort_values(["us", "seq"], ignore_index=True)
        ready = rows["us"] // 1000 <= reached
        memory = list(self.memory.get()[0]) if self.memory.exists() else []
        if ready.any():
            memory, out = self.step(rows[ready], memory)
            for name, value in zip(self.names, key):
                out[name] = value
            yield out
            rest = rows[~ready]
            if len(rest):
                self.waiting.put(list(rest.itertuples(index=False, name=None)))
                self.handle.registerTimer(int(rest["us"].iloc[0]) // 1000)
            else:
                self.waiting.clear()
        until = self.until(memory)
        if until is None or until // 1000 < reached:
            self.memory.clear()
        else:
            self.memory.update((memory,))
            self.handle.registerTimer(until // 1000 + 1)

    def step(self, rows: pd.DataFrame, memory: list[int]) -> tuple[list[int], pd.DataFrame]:
        raise NotImplementedError

    def until(self, memory: list[int]) -> int | None:
        raise NotImplementedError

    def close(self) -> None:
        pass


class SlidingLimit(InEventTime):
    """Remembers the accepted times of the last window (at most `limit`)."""

    def __init__(self, names: list[str], limit: int, window_seconds: int) -> None:
        super().__init__(names)
        self.limit, self.window = limit, window_seconds * 1_000_000

    def step(self, rows: pd.DataFrame, memory: list[int]) -> tuple[list[int], pd.DataFrame]:
        times = np.unique(rows["us"].to_numpy())
        history = np.array(memory, np.int64)
        again = np.isin(times, history)  # a time that was accepted before shares that decision
        allowed, current, _ = decided_in_order(times[~again], self.window, self.limit, history)
        taken = np.concatenate([history, times[~again][allowed]])
        shown = pd.DataFrame({"us": times, "allowed": True, "current": np.searchsorted(taken, times) - np.searchsorted(taken, times - self.window, "right")})
        shown.loc[~again, "allowed"], shown.loc[~again, "current"] = allowed, current
        kept = taken[taken > times[-1] - self.window][-self.limit :]
        return kept.tolist(), shown.astype({"current": "int32"})

    def until(self, memory: list[int]) -> int | None:
        return memory[-1] + self.window if memory else None


class FailureRuns(InEventTime):
    """Remembers the length of a key's run of failed checks (n at most) and the time of its last check."""

    def __init__(self, names: list[str], n: int, forget_seconds: int) -> None:
        super().__init__(names)
        self.n, self.forget = n, forget_seconds * 1_000_000

    def step(self, rows: pd.DataFrame, memory: list[int]) -> tuple[list[int], pd.DataFrame]:
        run, last = memory or [0, 0]
        runs = []
        if memory and rows["us"].iloc[0] - last > self.forget:
            run = 0
        gaps = rows["us"].diff().fillna(0) > self.forget
        for up, gap in zip(rows["up"], gaps):
            run = 0 if up else 1 if gap else min(self.n, run + 1)
            runs.append(run)
        hit = rows[np.array(runs) == self.n]
        return [run, int(rows["us"].iloc[-1])], hit[["us", "seq"]].assign(failures=np.int32(self.n))

    def until(self, memory: list[int]) -> int | None:
        return memory[1] + self.forget if memory and memory[0] else None


def _in_order(rows: DataFrame, keys: list[str], at: str, delay: str, processor: InEventTime, seq: str | None, up: str | None) -> DataFrame:
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)  # what this kind of state asks for
    more = [F.col(seq).cast("long").alias("seq") if seq else F.lit(0).cast("long").alias("seq"), F.col(up).alias("up") if up else F.lit(True).alias("up")]
    marked = rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    us = F.unix_micros(F.col(at)).alias("us")
    shape = ", ".join(f"{k} {_type(rows, k)}" for k in keys)
    kinds = {SlidingLimit: "us long, allowed boolean, current int", FailureRuns: "us long, seq long, failures int"}
    out = marked.select(*keys, at, us, *more).groupBy(*keys).transformWithStateInPandas(processor, f"{kinds[type(processor)]}, {shape}", "append", "eventtime")
    return out.withColumn(at, F.timestamp_micros("us"))


def daily_uptime(checks: DataFrame, delay: str = "1 day") -> DataFrame:
    """Checks and up share per site and day; late checks within `delay` count.

    ``checks(site_id, is_up, checked_at)``, streaming or batch.
    """
    return (
        checks.withWatermark("checked_at", delay)
        .groupBy("site_id", F.window("checked_at", "1 day").alias("w"))
        .agg(F.count("*").alias("total"), F.count_if("is_up").alias("up"))
        .select("site_id", F.col("w.start").alias("day"), "total", "up", (100.0 * F.col("up") / F.col("total")).alias("uptime"))
    )


def failure_runs(checks: DataFrame, n: int = 2, seq: str | None = None, delay: str = "0 seconds", forget_seconds: int = 30 * 86400) -> DataFrame:
    """``checks(site_id, is_up, checked_at)`` as a stream → a row (site_id, checked_at, seq, failures) whenever a site's newest n checks are all down.

    `seq` orders checks of one time.  A run ends where a site isn't checked for `forget_seconds`; then its state goes.
    """
    out = _in_order(checks, ["site_id"], "checked_at", delay, FailureRuns(["site_id"], n, forget_seconds), seq, "is_up")
    return out.select("site_id", "checked_at", "seq", "failures")


def rate_limited(requests: DataFrame, keys: list[str], limit: int, window_seconds: int = 60, delay: str = "0 seconds") -> DataFrame:
    """``requests(*keys, ts)`` as a stream → a row (*keys, ts, allowed, current) per time of a key, as the batch form has it.

    State is the accepted times of the last window, and goes a window after the last of them.
    """
    out = _in_order(requests, keys, "ts", delay, SlidingLimit(keys, limit, window_seconds), None, None)
    return out.select(*keys, "ts", "allowed", "current")


def cooled_alerts(candidates: DataFrame, cooldown_minutes: int, delay: str = "0 seconds") -> DataFrame:
    """Candidate alerts that fire; each firing mutes its rule for the cooldown."""
    fired = rate_limited(candidates.select("rule_id", F.col("created_at").alias("ts")), ["rule_id"], 1, cooldown_minutes * 60, delay)
    return fired.filter("allowed").select("rule_id", F.col("ts").alias("created_at"))


def drained(stream: DataFrame, latest: list[str] | None = None) -> DataFrame:
    """Run a stream over all that its source holds now and return what it wrote (to the shared folder).

    latest: for aggregates that change from batch to batch, the key whose newest row counts.
    """
    spark: SparkSession = stream.sparkSession
    folder = f"{stage_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if latest is None:
        writer.outputMode("append").format("parquet").option("path", f"{folder}/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/rows")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/rows/part={number}")

    writer.outputMode("update").foreachBatch(write).start().awaitTermination()
    rows = spark.read.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")
    newest = F.max_by(F.struct(*[c for c in stream.columns if c not in latest]), "_batch").alias("row")
    return rows.groupBy(*latest).agg(newest).select(*latest, "row.*").select(*stream.columns)


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()
