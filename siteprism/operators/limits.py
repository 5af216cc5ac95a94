"""Sliding rate limits and monthly quotas, exact also for huge keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteprism.common import falsy_zero, literal_rows, materialize, running_total, top_k

# Monthly limits and requests per minute of each plan (0 = unlimited).
USAGE_TYPES = ["api_calls", "crawl_pages", "keyword_lookups", "audits", "content_generations", "js_renders"]
PLANS = [
    ("free", 1000, 5000, 100, 10, 20, 500, 30),
    ("pro", 50000, 100000, 5000, 100, 500, 10000, 120),
    ("enterprise", 0, 0, 0, 0, 0, 0, 600),
]
# Requests per minute by path, first match wins; plan factors.
PATH_LIMITS = [
    ("/api/v1/analyze", 10), ("/api/v1/sites/{site_id}/audits", 20),
    ("/api/v1/sites/{site_id}/keywords/discover", 20), ("/api/v1/sites/{site_id}/rankings/update", 10),
]
PLAN_FACTOR = {"pro": 4, "enterprise": 20}
PLAN_DEFAULT = {"pro": 120, "enterprise": 600}
DEFAULT_PER_MINUTE, NO_TENANT_PER_MINUTE = 60, 30

#: Columns of a shard's table of fresh starts; a time before all others.
_TABLE = ["starts", "kinds", "counts", "lasts"]
_NEVER = -(1 << 62)


def plan_table(spark: SparkSession) -> DataFrame:
    cols = ", ".join(f"{c} int" for c in USAGE_TYPES)
    return literal_rows(spark, PLANS, f"plan string, {cols}, rate_limit_per_minute int")


def effective_limit(path: Column, plan: Column) -> Column:
    """Requests per minute for a path and plan; NULL plan = no tenant."""
    custom = F.lit(None).cast("int")
    for pattern, n in reversed(PATH_LIMITS):
        custom = F.when(path.startswith(pattern.split("{")[0]), F.lit(n)).otherwise(custom)
    factor, default = F.lit(1), F.lit(DEFAULT_PER_MINUTE)
    for name, k in PLAN_FACTOR.items():
        factor = F.when(plan == name, F.lit(k)).otherwise(factor)
        default = F.when(plan == name, F.lit(PLAN_DEFAULT[name])).otherwise(default)
    return F.when(plan.isNull(), F.lit(NO_TENANT_PER_MINUTE)).otherwise(F.coalesce(custom * factor, default))


def _accepted_from(times: np.ndarray, window: int, limit: int, history: np.ndarray) -> np.ndarray:
    """Places of accepted times (ascending), given at most `limit` times accepted before.

    The next accepted time comes after the last one and a window or more after the one `limit` acceptances back, so
    `limit` of them follow at once from the `limit` before.
    """
    n, turns = len(times), np.arange(limit)
    free = np.append(np.searchsorted(times, times + window), n)  # the first place that no longer sees this one
    bound = np.zeros(limit, np.int64)
    bound[limit - len(history) :] = np.searchsorted(times, history + window)
    found, last = [], -1
    while last < n - 1:
        bound[0] = max(bound[0], last + 1)
        places = np.maximum.accumulate(bound - turns) + turns
        found.append(places[places < n])
        last = int(places[-1])
        bound = free[np.minimum(places, n)].copy()
    return np.concatenate([*found, np.zeros(0, np.int64)])


def decided_in_order(times: np.ndarray, window: int, limit: int, history: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(allowed, accepted before in the window, seconds until a rejected one may come again) of ascending times."""
    allowed = np.zeros(len(times), bool)
    allowed[_accepted_from(times, window, limit, history)] = True
    taken = np.concatenate([history, times[allowed]])
    oldest = np.searchsorted(taken, times - window, "right")
    wait = (taken[np.minimum(oldest, len(taken) - 1)] + window - times) // 1_000_000
    return allowed, np.searchsorted(taken, times) - oldest, wait


def _fresh_starts(times: np.ndarray, window: int, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a shard makes of every state that may be carried in.

    A state counts through at most `limit` + 1 starts without a history (see `sliding_rate_limit`), all within a window
    of the shard's first time.  Returns the starts' times, each one's kind, and per kind the number of accepted times and
    the last `limit` of them (newest first, _NEVER where there are fewer).
    """
    n, turns = len(times), np.arange(limit)
    free = np.append(np.searchsorted(times, times + window), n)
    starts = np.arange(min(n, free[0] + 1))
    kinds, counts, lasts, first = [], [], [], 0
    step = max(1, (1 << 20) // limit)
    for a in range(0, len(starts), step):
        own = starts[a : a + step]
        kind, places = np.arange(len(own)), own[:, None] + turns
        before = np.full_like(places, -1)
        blocks = 0
        while (places[:, -1] < n).any():
            on = places[:, -1] < n
            later = free[np.minimum(places[on], n)]
            later[:, 0] = np.maximum(later[:, 0], places[on, -1] + 1)
            later = np.maximum.accumulate(later - turns, 1) + turns
            before[on], places[on] = places[on], later
            blocks = blocks + on.astype(np.int64)  # a number per kind
            # states never cross, so equal ones are neighbours: they stay equal
            same = (places[1:] == places[:-1]).all(1) & (before[1:] == before[:-1]).all(1) & (np.diff(blocks) == 0)
            if same.any():
                to = np.concatenate([[0], np.cumsum(~same)])
                kind, keep = to[kind], np.concatenate([[True], ~same])
                places, before, blocks = places[keep], before[keep], blocks[keep]
        held = (places < n).sum(1)
        both = np.concatenate([before, places], 1)
        at = held[:, None] + limit - 1 - turns  # the newest accepted, and back
        taken = np.take_along_axis(both, at, 1)
        kinds.append(kind + first)
        counts.append(held + limit * blocks)
        lasts.append(np.where(taken >= 0, times[np.maximum(taken, 0)], _NEVER))
        first += len(places)
    return times[starts], np.concatenate(kinds), np.concatenate(counts), np.concatenate(lasts)


def _carried_on(carried: np.ndarray, window: int, limit: int, starts: np.ndarray, kinds: np.ndarray, counts: np.ndarray, lasts: np.ndarray) -> np.ndarray:
    """The last accepted times (newest first) behind a shard, from those before it and its table of fresh starts."""
    at = np.concatenate([[0], np.searchsorted(starts, carried + window)])
    base = np.concatenate([[0], limit - 1 - np.arange(len(carried))])
    inside = at < len(starts)
    kind = kinds[np.minimum(at, len(starts) - 1)]
    total = base + np.where(inside, counts[kind], 0)
    back = (total - total.min())[:, None] + np.arange(limit)
    times = np.where(inside[:, None] & (back < limit), np.take_along_axis(lasts[kind], np.minimum(back, limit - 1), 1), _NEVER).max(0)
    return times[times > _NEVER]


def sliding_rate_limit(requests: DataFrame, keys: list[str], limit: int, window_seconds: int = 60, bucket: int = 20) -> DataFrame:
    """Accept or reject each request by the accepted ones in the last window.

    ``requests(*keys, ts)`` → one row per distinct (key, ts) with ``requests``,
    ``allowed``, ``current`` (accepted before it in the window), ``remaining``
    and ``retry_after``.  Equal times of a key share one decision.

    A rejected request does not count, so decisions feed back.  They only do
    where raw traffic exceeds the limit:

    * requests are cut into (key, time bucket) shards of `bucket` windows with a
      halo of three windows before and one after;
    * if a window holds no more than `limit` raw requests, the request is
      accepted for certain; only requests within one window of an overloaded one
      go on.

    A key may be overloaded without a pause, so its shards are decided in
    parallel too.  With A(i) accepted up to request i, A(i) is the smaller of
    A(i - 1) + 1 and limit + A(last request a window before i): sums and minima
    only.  So a state that is carried into a shard (the last `limit` accepted
    times) acts there as the minimum over a few fresh starts, each shifted by a
    constant: one at the shard's first request, and one where each of those
    times leaves the window.

    1. every shard works out all fresh starts of its first window (equal ones
       merge on the way) and keeps how many they accept and the last few;
    2. one pass per key over these tables, a row per shard, carries the state on;
    3. every shard decides its requests from its own state.
    """
    w = window_seconds * 1_000_000
    size = w * bucket
    t, b = F.col("us"), F.col("_bucket")
    distinct = requests.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).groupBy(*keys, "us").agg(
        F.count("*").alias("requests")
    )
    own = F.floor(t / size).cast("bigint")
    copies = F.array_compact(
        F.array(own, F.when(t >= (own + 1) * size - 3 * w, own + 1), F.when(t < own * size + w, own - 1))
    )
    placed = distinct.withColumn("_bucket", F.explode(copies))
    # A frame of times is counted anew for every row, which grows with the square of the traffic; fixed places do not.
    group, past = [*keys, "_bucket"], (Window.unboundedPreceding, Window.currentRow)
    order, back = Window.partitionBy(*group).orderBy("us"), Window.partitionBy(*group).orderBy(F.col("us").desc())
    busy = F.coalesce(F.lag("us", limit).over(order) > t - w, F.lit(False))
    marked = placed.withColumn("busy", F.when(busy, t))  # its time, where more than `limit` requests are in the window
    before, after = F.last("busy", True).over(order.rowsBetween(*past)), F.last("busy", True).over(back.rowsBetween(*past))
    # Without an overloaded request in the window everything in it was accepted.
    settled = F.coalesce(before <= t - w, F.lit(True))
    near = marked.withColumns({"settled": settled, "active": F.coalesce(after < t + w, F.lit(False))}).withColumn(
        "active", F.when(F.col("active") | ~F.col("settled"), 1).otherwise(0)
    )
    # Raw requests in the window, right where it is settled: `limit` at most, as overloaded ones are left out.
    raw = F.count("*").over(Window.partitionBy(*group, "busy").orderBy("us").rangeBetween(-(w - 1), 0))
    near = near.withColumn("raw", raw).drop("busy")
    # Written once: the two kinds of rows and both passes over shards read it.
    core = materialize(near.filter(b == own))

    calm = core.filter("active = 0").select(
        *keys, "us", "requests", F.lit(True).alias("allowed"), (F.col("raw") - 1).cast("int").alias("current"),
        F.lit(None).cast("int").alias("retry_after"),
    )
    open_ = core.filter("active = 1").select(*keys, "_bucket", "us", "requests", "settled", "raw")
    shard = [*keys, "_bucket"]
    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in open_.select(*shard).schema)

    def summarise(rows: pa.Table) -> pa.Table:
        parts = _fresh_starts(np.sort(rows.column("us").to_numpy()), w, limit)
        head = {c: rows.column(c).slice(0, 1).combine_chunks() for c in shard}
        return pa.table(head | {c: pa.array([x.ravel()], pa.list_(pa.int64())) for c, x in zip(_TABLE, parts)})

    tables = open_.select(*shard, "us").groupBy(*shard).applyInArrow(summarise, f"{named}, " + ", ".join(f"{c} array<bigint>" for c in _TABLE))

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, np.zeros(0, np.int64)
        for batch in batches:
            before = []
            for key, *row in zip(zip(*[batch.column(k).to_pylist() for k in keys]), *[batch.column(c) for c in _TABLE]):
                if key != now:
                    now, state = key, np.zeros(0, np.int64)
                before.append(state.tolist())
                starts, kinds, counts, lasts = (x.values.to_numpy() for x in row)
                state = _carried_on(state, w, limit, starts, kinds, counts, lasts.reshape(-1, limit))
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in shard} | {"state": pa.array(before, pa.list_(pa.int64()))})

    states = tables.repartition(*keys).sortWithinPartitions(*shard).mapInArrow(carry, f"{named}, state array<bigint>")

    def decide(rows: pa.Table, state: pa.Table) -> pa.Table:
        rows = rows.sort_by("us")
        allowed, current, wait = decided_in_order(rows.column("us").to_numpy(), w, limit, state.column("state")[0].values.to_numpy()[::-1])
        settled = rows.column("settled").to_numpy(zero_copy_only=False)
        current = np.where(settled, rows.column("raw").to_numpy() - 1, current)
        out = {c: rows.column(c) for c in (*keys, "us", "requests")}
        return pa.table(out | {"allowed": allowed, "current": pa.array(current, pa.int32()), "retry_after": pa.array(wait, pa.int32(), mask=allowed)})

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in calm.schema)
    decided = open_.groupBy(*shard).cogroup(states.groupBy(*shard)).applyInArrow(decide, shape)
    remaining = F.when(F.col("allowed"), F.greatest(F.lit(0), F.lit(limit) - F.col("current") - 1)).otherwise(F.lit(0))
    return calm.unionByName(decided).withColumn("remaining", remaining).withColumn("ts", F.timestamp_micros("us"))


def rolling_counts(requests: DataFrame, keys: list[str], window_seconds: int = 60) -> DataFrame:
    """Raw requests in the trailing window, an upper bound of the accepted ones."""
    w = window_seconds * 1_000_000
    us = requests.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    t, size = F.col("us"), w * 20
    own, end = F.floor(t / size).cast("bigint"), F.floor((t + w) / size).cast("bigint")
    mark = lambda bucket, at, value, kept: F.struct(bucket.alias("bucket"), at.alias("at"), F.lit(value).alias("value"), F.lit(kept).alias("kept"))
    # A request adds one at its time and takes it back a window later, so that a running total is the count.
    marks = F.array(mark(own, t, 1, True), mark(end, t + w, -1, False), F.when(end > own, mark(end, t, 1, False)))
    placed = us.withColumn("_mark", F.explode(F.array_compact(marks)))
    order = Window.partitionBy(*keys, "_mark.bucket").orderBy("_mark.at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.withColumn("in_window", F.sum("_mark.value").over(order)).filter("_mark.kept").drop("_mark", "us")


def monthly_usage(usage: DataFrame) -> DataFrame:
    """Amounts per tenant and month, one column per usage type."""
    month = F.trunc(F.col("ts").cast("date"), "month").alias("month")
    grouped = usage.groupBy("tenant_id", month).pivot("usage_type", USAGE_TYPES).agg(F.sum("amount"))
    return grouped.select("tenant_id", "month", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in USAGE_TYPES])


def effective_quota(tenants: DataFrame, overrides: DataFrame) -> DataFrame:
    """Plan limits per tenant, replaced by overrides that are neither NULL nor 0."""
    o = overrides.select("tenant_id", *[F.col(c).alias(f"o_{c}") for c in USAGE_TYPES])
    j = tenants.join(plan_table(tenants.sparkSession), "plan", "left").join(o, "tenant_id", "left")
    return j.select("tenant_id", "plan", *[F.coalesce(falsy_zero(F.col(f"o_{c}")), F.col(c)).alias(c) for c in USAGE_TYPES])


def quota_long(quota: DataFrame) -> DataFrame:
    return quota.unpivot(["tenant_id"], USAGE_TYPES, "usage_type", "quota")


def quota_check(usage: DataFrame, quota: DataFrame) -> DataFrame:
    """Accept usage in time order while the month's total stays within the quota.

    ``usage(tenant_id, usage_type, ts, event_id, amount)``; quota 0 is
    unlimited and refused usage does not count.  Usage never shrinks, so the
    room left at some point only gets smaller, and rounds settle it for all
    (tenant, type, month) groups at once:

    * an amount of more than half the room is large, the others are small; a
      running total in two levels adds up the small ones only;
    * a round ends for a group with its first large amount that still fits
      (accepted) or its first small one that doesn't (refused): before it, small
      ones are accepted and large ones refused;
    * what comes later and exceeds the new room is refused, the rest stays open.

    A large amount taken, or small ones that fill the room by more than half,
    leave less than half of it: rounds grow with the logarithm of the quota.
    """
    keys = ["tenant_id", "usage_type", "month"]
    u = usage.withColumn("month", F.trunc(F.col("ts").cast("date"), "month")).join(
        quota_long(quota), ["tenant_id", "usage_type"], "left"
    )
    cols = [*usage.columns, "month", "quota"]
    limited = F.coalesce(F.col("quota"), F.lit(0)) > 0
    done = u.filter(~limited).select(*cols, F.lit(True).alias("allowed"))
    open_ = u.filter(limited).select(*cols, F.col("quota").cast("bigint").alias("_room"))
    order = [F.col("ts"), F.col("event_id")]
    amount, room, before = F.col("amount"), F.col("_room"), F.col("_before")
    while True:
        small = F.coalesce(amount * 2 <= room, F.lit(True))
        added = F.when(small, F.coalesce(amount, F.lit(0))).otherwise(F.lit(0))
        total = running_total(open_, keys, F.date_trunc("hour", "ts"), order, added, "_total")
        rows = total.withColumns({"_small": small, "_before": F.col("_total") - added})
        rows = materialize(rows.withColumn("_ends", F.when(small, F.col("_total") > room).otherwise(amount <= room - before)))
        first = rows.filter("_ends").groupBy(*keys).agg(
            F.min(F.struct(*order, F.when(F.col("_small"), room - before).otherwise(room - before - amount).alias("left"))).alias("_end")
        )
        j = rows.join(first, keys, "left")
        at, end = F.struct(*order), F.struct("_end.ts", "_end.event_id")
        earlier = F.col("_end").isNull() | (at < end)
        allowed = F.when(earlier, F.col("_small")).when(at == end, ~F.col("_small")).when(amount > F.col("_end.left"), F.lit(False))
        judged = materialize(j.withColumns({"allowed": allowed, "_room": F.coalesce("_end.left", "_room")}).select(*cols, "_room", "allowed"))
        done = done.unionByName(judged.filter("allowed IS NOT NULL").drop("_room"))
        open_ = judged.filter("allowed IS NULL").drop("allowed")
        if open_.isEmpty():
            return done


def usage_summary(monthly: DataFrame, quota: DataFrame) -> DataFrame:
    """Used, limit and remaining per usage type; NULL where unlimited."""
    used = monthly.unpivot(["tenant_id", "month"], USAGE_TYPES, "usage_type", "used")
    j = used.join(quota_long(quota), ["tenant_id", "usage_type"])
    limit = falsy_zero(F.col("quota"))
    return j.select(
        "tenant_id", "month", "usage_type", "used", limit.alias("limit"), F.greatest(F.lit(0), limit - F.col("used")).alias("_r"),
    ).withColumn("remaining", F.when(F.col("limit").isNotNull(), F.col("_r"))).drop("_r")


def usage_history(monthly: DataFrame, months: int = 12) -> DataFrame:
    return top_k(monthly, ["tenant_id"], [F.col("month").desc()], months, "age")


def limit_events(decisions: DataFrame, limit: int) -> DataFrame:
    """Log rows of rejected requests."""
    return decisions.filter(~F.col("allowed")).withColumn("limit", F.lit(limit))
