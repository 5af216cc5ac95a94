"""Streaming monitors against plain restatements: shuffled, late and repeated rows, small chunks, state that goes."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_state import T0, naive_limit

from siteprism.streaming import monitors as S


def _stream(spark, df, path):
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _parts(spark, parts, schema, path):
    """A stream of one micro-batch per part."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/{i:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_streams(spark, tmp_path):
    times = [T0 + dt.timedelta(seconds=7 * i) for i in range(40)]
    req = spark.createDataFrame([("t", t) for t in times], "tenant string, ts timestamp")
    limited = S.drained(S.rate_limited(_stream(spark, req, str(tmp_path / "r")), ["tenant"], 3))
    got = {r.ts.replace(tzinfo=None): (r.allowed, r.current) for r in limited.collect()}
    assert got == {t: (ok, n) for t, ok, n in naive_limit(times, 3, 60)}

    chk = spark.createDataFrame([("s", t, i % 4 == 0) for i, t in enumerate(times)], "site_id string, checked_at timestamp, is_up boolean")
    assert S.drained(S.failure_runs(_stream(spark, chk, str(tmp_path / "c")), 3)).count() == 10
    assert S.daily_uptime(chk).first().total == 40

    ev = req.select(F.col("tenant").alias("rule_id"), F.col("ts").alias("created_at"))
    assert S.drained(S.cooled_alerts(_stream(spark, ev, str(tmp_path / "e")), 1)).count() == 5


def test_streams_in_small_chunks(spark, tmp_path):
    """Shuffled input in chunks of five rows: decisions follow time, equal times share one."""
    rnd = random.Random(8)
    times = sorted(T0 + dt.timedelta(seconds=rnd.randrange(400)) for _ in range(60))
    rows = [("t", t) for t in times]
    rnd.shuffle(rows)
    want = {t: ok for t, ok, _ in naive_limit(sorted(set(times)), 3, 60)}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        req = spark.createDataFrame(rows, "tenant string, ts timestamp").repartition(3)
        got = {r.ts.replace(tzinfo=None): r.allowed for r in S.drained(S.rate_limited(_stream(spark, req, str(tmp_path / "r")), ["tenant"], 3)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == want


@pytest.mark.parametrize("limit", [1, 4])
def test_rows_that_come_late_within_the_delay(spark, tmp_path, limit):
    """Batches overlap by some minutes; a row far ahead lets the watermark pass everything at the end."""
    rnd = random.Random(limit)
    times = sorted({T0 + dt.timedelta(milliseconds=rnd.randrange(1_200_000)) for _ in range(240)})
    late = sorted(times, key=lambda t: t + dt.timedelta(seconds=rnd.randrange(200)))
    parts = [[("a", t) for t in late[i : i + 40]] for i in range(0, len(late), 40)] + [[("end", T0 + dt.timedelta(days=1))]]
    stream = S.rate_limited(_parts(spark, parts, "k string, ts timestamp", str(tmp_path / "p")), ["k"], limit, 60, "5 minutes")
    got = {r.ts.replace(tzinfo=None): (r.allowed, r.current) for r in S.drained(stream).filter("k = 'a'").collect()}
    assert got == {t: (ok, n) for t, ok, n in naive_limit(times, limit, 60)}


def test_rows_later_than_the_delay_change_nothing(spark, tmp_path):
    first = [T0 + dt.timedelta(seconds=i) for i in range(0, 200, 20)]
    parts = [[("a", t) for t in first], [("a", first[-1] + dt.timedelta(seconds=500))], [("a", T0 + dt.timedelta(seconds=1))]]
    got = S.drained(S.rate_limited(_parts(spark, parts, "k string, ts timestamp", str(tmp_path / "p")), ["k"], 2)).collect()
    assert {r.ts.replace(tzinfo=None) for r in got} == {t for _, t in parts[0] + parts[1]} and len(got) == 11


def test_failures_over_batches(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(s, T0 + dt.timedelta(seconds=10 * (i // 2)), i, rnd.random() < 0.4) for s in "ab" for i in range(80)]
    parts = [rows[:30] + rows[80:95], rows[95:160], rows[30:80], [("end", T0 + dt.timedelta(days=1), 0, True)]]
    stream = S.failure_runs(_parts(spark, parts, "site_id string, checked_at timestamp, check_id long, is_up boolean", str(tmp_path / "p")), 3, "check_id", "1 hour")
    got = sorted((r.site_id, r.seq, r.failures) for r in S.drained(stream).collect())
    want = [(s, own[i][2], 3) for s in "ab" for own in [[r for r in rows if r[0] == s]] for i in range(2, len(own)) if not any(r[3] for r in own[i - 2 : i + 1])]
    assert got == sorted(want) and want


def test_daily_uptime_counts_rows_of_all_batches(spark, tmp_path):
    rows = [("s", T0 + dt.timedelta(hours=5 * i), i % 3 > 0) for i in range(20)]
    stream = S.daily_uptime(_parts(spark, [rows[:7], rows[7:13], rows[13:]], "site_id string, checked_at timestamp, is_up boolean", str(tmp_path / "p")))
    got = {r.day.replace(tzinfo=None): (r.total, r.up) for r in S.drained(stream, ["site_id", "day"]).collect()}
    days = sorted({t.replace(hour=0) for _, t, _ in rows})
    assert got == {d: (len(own), sum(u for _, _, u in own)) for d in days for own in [[r for r in rows if r[1].replace(hour=0) == d]]}


class _State:
    """Stands for a list or value in a key's state."""

    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held or []

    def put(self, rows):
        self.held = list(rows)

    def update(self, row):
        self.held = list(row)

    def appendList(self, rows):
        self.held = [*(self.held or []), *rows]

    def clear(self):
        self.held = None


class _Handle:
    def __init__(self):
        self.timers, self.states = set(), {}

    def getListState(self, name, schema):
        return self.states.setdefault(name, _State())

    getValueState = getListState

    def registerTimer(self, at):
        self.timers.add(at)


class _Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


@pytest.mark.parametrize(("processor", "last"), [(S.SlidingLimit(["k"], 3, 60), 60), (S.FailureRuns(["k"], 2, 3600), 3600)])
def test_state_goes(processor, last):
    """Once nothing to come can depend on what a key remembers, nothing of it is left."""
    handle = _Handle()
    processor.init(handle)
    rows = pd.DataFrame({"us": np.arange(5) * 10_000_000, "seq": range(5), "up": [True, False, False, False, False]})
    assert not list(processor.handleInputRows(("a",), iter([rows]), _Now(0))) and handle.timers == {0}
    out = pd.concat(list(processor.handleExpiredTimer(("a",), _Now(25_000), None)))
    assert out["us"].max() == 20_000_000 and handle.states["waiting"].held and 30_000 in handle.timers
    list(processor.handleExpiredTimer(("a",), _Now(40_000), None))
    assert not handle.states["waiting"].exists() and handle.states["memory"].exists()
    end = max(handle.timers)
    assert end <= 40_000 + last * 1000 + 1
    assert not list(processor.handleExpiredTimer(("a",), _Now(end), None))
    assert not handle.states["memory"].exists()
