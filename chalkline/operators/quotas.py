"""Rolling quotas, counters, and folds whose next step depends on the last decision."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cumulative(points: DataFrame, keys: Sequence[str], at: str, add: str, bucket: int) -> DataFrame:
    """points with `total`: the sum of `add` over the points of the same keys at or before theirs (at: long).

    Time is cut into buckets. Totals of buckets are summed along each key, and
    points only within their bucket, so neither a busy key nor one key for all
    rows meets in one task.
    """
    keys = list(keys)
    p = points.withColumn("__b", F.floor(F.col(at) / bucket))
    sums = p.groupBy(*keys, "__b").agg(F.sum(add).alias("__s"))
    before = F.coalesce(F.sum("__s").over(W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__b").alias("__c"), before.alias("__before"))
    same = F.col("__b") == F.col("__c")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    own = F.sum(add).over(W.partitionBy(*keys, "__b").orderBy(at).rangeBetween(W.unboundedPreceding, 0))
    return p.join(sums, same).withColumn("total", F.col("__before") + own).drop("__b", "__c", "__s", "__before", *(f"__{k}" for k in keys))


def trailing_counts(events: DataFrame, width: int, *, key: str | None, event_id: str = "event_id", at: str = "us", bucket: int | None = None) -> DataFrame:
    """(event_id, n): events of the same key (null: of all) with at in (t - width, t]."""
    keyed = F.col(key) if key else F.lit(0)
    base = events.select(keyed.alias("k"), F.col(at).alias("t"), F.col(event_id).alias("id"))
    none = F.lit(None).cast(events.schema[event_id].dataType)
    points = base.select("k", "t", F.lit(1).alias("add"), none.alias("id"), F.lit(0).alias("sign"))
    points = points.unionByName(base.select("k", "t", F.lit(0).alias("add"), "id", F.lit(1).alias("sign")))
    points = points.unionByName(base.select("k", (F.col("t") - width).alias("t"), F.lit(0).alias("add"), "id", F.lit(-1).alias("sign")))
    totals = cumulative(points, ["k"], "t", "add", bucket or max(1, width // 24))
    return totals.where("sign <> 0").groupBy(F.col("id").alias(event_id)).agg(F.sum(F.col("sign") * F.col("total")).cast("bigint").alias("n"))


def rolling_audit(events: DataFrame, limits: Sequence[tuple[str, str | None, int, int]], *, event_id: str = "event_id", at: str = "us") -> DataFrame:
    """For each event, every count and the first limit that it exceeds. limits: (name, key or None, width, most)."""
    out = events
    for name, key, width, _ in limits:
        n = trailing_counts(events, width, key=key, event_id=event_id, at=at).withColumnRenamed("n", f"n_{name}")
        out = out.join(n, event_id)
    reason = F.coalesce(*(F.when(F.col(f"n_{name}") > most, name) for name, _, _, most in limits), F.lit("ok"))
    return out.withColumn("reason", reason)


def daily_counts(calls: DataFrame, limit: Column, *, key: str, at: str) -> DataFrame:
    """Calls of each key and UTC day, what remains of limit, and whether it is used up."""
    n = calls.groupBy(key, F.to_date(at).alias("day")).agg(F.count("*").alias("used"))
    return n.withColumn("remaining", F.greatest(F.lit(0), limit - F.col("used"))).withColumn("exhausted", F.col("used") >= limit)


def in_flight(changes: DataFrame, cap: int, *, key: str, at: str = "us", delta: str = "delta", bucket: int = 3_600_000_000) -> DataFrame:
    """changes with the running sum of delta of their key, and whether it is within cap."""
    out = cumulative(changes, [key], at, delta, bucket)
    return out.withColumnRenamed("total", "running").withColumn("allowed", F.col("running") <= cap)


# ---- folds


def _fold(events: DataFrame, key: str, at: str, schema: str, start: Callable[[], Callable[[dict], dict]]) -> DataFrame:
    """Events of each key in order through a state of its own; one pass, a state at a time, nothing held."""
    rows = events.repartition(key).sortWithinPartitions(key, at)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, step = object(), None
        for f in frames:
            out = []
            for row in f.to_dict("records"):
                k = None if pd.isna(row[key]) else row[key]
                if k != last:
                    last, step = k, start()
                out.append(step(row))
            if out:
                yield pd.DataFrame(out)

    return rows.mapInPandas(run, schema)


def cooldown(events: DataFrame, gap: int, *, key: str = "user_id", event_id: str = "event_id", at: str = "us") -> DataFrame:
    """Accepts an event if the last accepted one of its key is `gap` or longer ago; else wait is what is left."""

    def start():
        last = None

        def step(r):
            nonlocal last
            ok = last is None or r[at] - last >= gap
            wait = 0 if ok else gap - (r[at] - last)
            last = r[at] if ok else last
            return {event_id: r[event_id], "allowed": ok, "wait": wait}

        return step

    return _fold(events.select(event_id, key, at), key, at, f"{event_id} bigint, allowed boolean, wait bigint", start)


def rate_limit(events: DataFrame, most: int, width: int, *, key: str = "user_id", event_id: str = "event_id", at: str = "us") -> DataFrame:
    """Accepts an event if fewer than `most` accepted ones of its key lie within the trailing width."""

    def start():
        kept: deque[int] = deque()

        def step(r):
            while kept and kept[0] <= r[at] - width:
                kept.popleft()
            ok = len(kept) < most
            if ok:
                kept.append(r[at])
            return {event_id: r[event_id], "allowed": ok, "n": len(kept)}

        return step

    return _fold(events.select(event_id, key, at), key, at, f"{event_id} bigint, allowed boolean, n bigint", start)


def breaker_step(state: tuple, at: int, outcome: str, failures: int, reset: int) -> tuple[tuple, bool, str]:
    """One call through a circuit breaker: (state, allowed, name of the new state). state: (name, failures, opened at).

    A call while open is refused until `reset` has passed; then one probe goes
    through. A rate-limited probe counts as a failure, so it cannot block the
    breaker for ever.
    """
    name, n, opened = state
    if name == "open":
        if at - opened < reset:
            return state, False, name
        name = "half_open"
    if outcome == "ok":
        return ("closed", 0, 0), True, "closed"
    if outcome == "limited" and name == "closed":
        return (name, n, opened), True, name
    n = n + 1
    if name == "half_open" or n >= failures:
        return ("open", n, at), True, "open"
    return (name, n, opened), True, name


def breaker(calls: DataFrame, *, failures: int = 5, reset: int = 120_000_000, key: str = "model", event_id: str = "event_id", at: str = "us", outcome: str = "outcome") -> DataFrame:
    """Each call with whether its key's breaker lets it through, and the state after it."""

    def start():
        state = ("closed", 0, 0)

        def step(r):
            nonlocal state
            state, ok, name = breaker_step(state, r[at], r[outcome], failures, reset)
            return {event_id: r[event_id], "allowed": ok, "state": name}

        return step

    return _fold(calls.select(event_id, key, at, outcome), key, at, f"{event_id} bigint, allowed boolean, state string", start)
