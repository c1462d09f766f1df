"""Streams: windowed counts with late-data limits, and folds whose state outlives a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.quotas import breaker_step


def daily_counts(events: DataFrame, key: str, at: str = "ts", late: str = "1 day") -> DataFrame:
    """Events of each key and UTC day."""
    stamped = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return stamped.groupBy(F.window(at, "1 day").alias("w"), key).agg(F.count("*").alias("used")).select(key, F.col("w.start").alias("day"), "used")


def session_counts(events: DataFrame, key: str, gap: str, at: str = "ts", late: str = "1 day") -> DataFrame:
    """Sessions of each key that end after a gap."""
    stamped = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return stamped.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def hit_counts(lookups: DataFrame, key: str = "q_hash", at: str = "ts") -> DataFrame:
    """Hits and last access of each cached answer (update mode)."""
    return lookups.groupBy(key).agg(F.count("*").alias("hit_count"), F.max(at).alias("last_accessed"))


def _folded(events: DataFrame, key: str, at: str, state: str, out: str, first: tuple, step: Callable[[tuple, dict], tuple[tuple, dict[str, Any]]], kept_for: str | None) -> DataFrame:
    """Events of each key in time order within a batch, through a state that is carried from batch to batch.

    An event that comes in a later batch than a younger one is applied when it comes.
    """

    def run(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        own = held.get if held.exists else first
        rows = pd.concat(frames).sort_values(at, kind="stable").to_dict("records")
        done = []
        for row in rows:
            own, result = step(own, row)
            done.append(result)
        held.update(own)
        if kept_for:
            held.setTimeoutDuration(kept_for)
        yield pd.DataFrame(done)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if kept_for else GroupStateTimeout.NoTimeout
    return events.groupBy(key).applyInPandasWithState(run, out, state, "append", timeout)


def cooldown(events: DataFrame, gap: int, *, key: str = "user_id", event_id: str = "event_id", at: str = "us", kept_for: str | None = None) -> DataFrame:
    """As the batch operator: an event is allowed if the last allowed one of its key is `gap` ago."""

    def step(own: tuple, row: dict) -> tuple[tuple, dict]:
        last = own[0]
        ok = last < 0 or row[at] - last >= gap
        wait = 0 if ok else gap - (row[at] - last)
        return ((row[at],) if ok else own), {event_id: row[event_id], "allowed": ok, "wait": wait}

    return _folded(events, key, at, "last bigint", f"{event_id} bigint, allowed boolean, wait bigint", (-1,), step, kept_for)


def rate_limit(events: DataFrame, most: int, width: int, *, key: str = "user_id", event_id: str = "event_id", at: str = "us", kept_for: str | None = None) -> DataFrame:
    """As the batch operator: at most `most` allowed events of a key in the trailing width."""

    def step(own: tuple, row: dict) -> tuple[tuple, dict]:
        kept = [t for t in own[0] if t > row[at] - width]
        ok = len(kept) < most
        kept = [*kept, row[at]] if ok else kept
        return (kept,), {event_id: row[event_id], "allowed": ok, "n": len(kept)}

    return _folded(events, key, at, "kept array<bigint>", f"{event_id} bigint, allowed boolean, n bigint", ([],), step, kept_for)


def breaker(calls: DataFrame, *, failures: int = 5, reset: int = 120_000_000, key: str = "model", event_id: str = "event_id", at: str = "us", outcome: str = "outcome") -> DataFrame:
    """As the batch operator: a circuit breaker for each key."""

    def step(own: tuple, row: dict) -> tuple[tuple, dict]:
        own, ok, name = breaker_step(tuple(own), row[at], row[outcome], failures, reset)
        return own, {event_id: row[event_id], "allowed": ok, "state": name}

    return _folded(calls, key, at, "name string, n int, opened bigint", f"{event_id} bigint, allowed boolean, state string", ("closed", 0, 0), step, None)
