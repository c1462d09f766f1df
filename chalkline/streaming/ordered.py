"""Streams whose events are taken in the order of their times, however they arrive.

Events of a key wait in a list state. An event-time timer goes off when the
watermark has passed the earliest of them; then all events before the watermark
are applied in order, and the rest wait on. So the result is that of the batch
operator over the same events, as long as none is later than `late`; events
later than that are dropped by Spark. Queries need the RocksDB state store
(spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

#: The name of the state store that list states and timers need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
Step = Callable[[tuple, dict], tuple[tuple, dict[str, Any]]]


def _plain(x):
    return x.item() if hasattr(x, "item") else None if x is pd.NaT else x


class InOrder(StatefulProcessor):
    """Applies step to the events of a key, in order of `at` (microseconds) and the other columns, behind the watermark."""

    def __init__(self, at: str, columns: Sequence[str], pending: str, state: str, first: tuple, step: Step, out: Sequence[str]):
        self.at, self.columns, self.schemas, self.first, self.step, self.out = at, list(columns), (pending, state), first, step, list(out)

    def init(self, handle) -> None:
        self.handle = handle
        self.pending, self.own = handle.getListState("pending", self.schemas[0]), handle.getValueState("own", self.schemas[1])

    def _wait_for(self, micros: int) -> None:
        self.handle.registerTimer(int(micros) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for frame in rows:
            held = [tuple(map(_plain, r)) for r in frame[self.columns].itertuples(index=False, name=None)]
            if held:
                self.pending.appendList(held)
                first = min(r[0] for r in held)
                earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            self._wait_for(earliest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        rows = sorted(tuple(r) for r in self.pending.get())
        due = [r for r in rows if r[0] // 1000 < mark]
        rest = rows[len(due) :]
        if due:
            own = tuple(self.own.get()) if self.own.exists() else self.first
            done = []
            for r in due:
                own, result = self.step(own, dict(zip(self.columns, r, strict=True)))
                done.append(result)
            self.own.update(own)
            if rest:
                self.pending.put(rest)
            else:
                self.pending.clear()
            yield pd.DataFrame(done, columns=self.out, dtype=object)
        if rest:
            self._wait_for(rest[0][0])

    def close(self) -> None:
        pass


def in_order(events: DataFrame, key: str, at: str, more: Sequence[str], state: str, first: tuple, step: Step, out: str, late: str) -> DataFrame:
    """step(state, event) -> (state, row) over the events of each key, in order; at: microseconds as a long. Rows without a time or key column value of null keep their own key."""
    columns = [at, *more]
    pending = ", ".join(f"`{c}` {events.schema[c].dataType.simpleString()}" for c in columns)
    names = [part.split()[0] for part in out.split(", ")]
    stamped = events.where(F.col(at).isNotNull()).select(key, *columns, F.timestamp_micros(at).alias("__ts")).withWatermark("__ts", late)
    return stamped.groupBy(key).transformWithStateInPandas(InOrder(at, columns, pending, state, first, step, names), out, "append", "EventTime")


def cooldown(events: DataFrame, gap: int, *, key: str = "user_id", event_id: str = "event_id", at: str = "us", late: str = "1 day") -> DataFrame:
    """The batch operator quotas.cooldown as a stream, in event-time order."""

    def step(own: tuple, row: dict) -> tuple[tuple, dict]:
        last = own[0]
        ok = last < 0 or row[at] - last >= gap
        return ((row[at],) if ok else own), {event_id: row[event_id], "allowed": ok, "wait": 0 if ok else gap - (row[at] - last)}

    return in_order(events, key, at, [event_id], "last bigint", (-1,), step, f"{event_id} bigint, allowed boolean, wait bigint", late)


def rate_limit(events: DataFrame, most: int, width: int, *, key: str = "user_id", event_id: str = "event_id", at: str = "us", late: str = "1 day") -> DataFrame:
    """The batch operator quotas.rate_limit as a stream, in event-time order."""

    def step(own: tuple, row: dict) -> tuple[tuple, dict]:
        kept = [t for t in own[0] if t > row[at] - width]
        ok = len(kept) < most
        kept = [*kept, row[at]] if ok else kept
        return (kept,), {event_id: row[event_id], "allowed": ok, "n": len(kept)}

    return in_order(events, key, at, [event_id], "kept array<bigint>", ([],), step, f"{event_id} bigint, allowed boolean, n bigint", late)


def rolling_limits(events: DataFrame, limits: Sequence[tuple[str, int, int]], *, key: str = "user_id", event_id: str = "event_id", at: str = "us", late: str = "1 day") -> DataFrame:
    """For each event, its key's events in each trailing width and the first limit (name, width, most) that they exceed.

    As the batch operator quotas.rolling_audit for limits of one key; events of
    one microsecond count each other, so they are one step.
    """
    widest = max(width for _, width, _ in limits)

    def step(own: tuple, row: dict) -> tuple[tuple, dict]:
        times = [t for t in own[0] if t > row[at] - widest] + [row[at]]
        counts = {name: sum(t > row[at] - width for t in times) for name, width, _ in limits}
        reason = next((name for name, _, most in limits if counts[name] > most), "ok")
        return (times,), {event_id: row[event_id], **{f"n_{name}": n for name, n in counts.items()}, "reason": reason}

    out = f"{event_id} bigint, " + ", ".join(f"n_{name} bigint" for name, _, _ in limits) + ", reason string"
    return in_order(events, key, at, [event_id], "times array<bigint>", ([],), step, out, late)


class Retained(StatefulProcessor):
    """The newest n events of a session, and the session's end after a time without events."""

    def __init__(self, n: int, keep_us: int, at: str, event_id: str):
        self.n, self.keep_us, self.at, self.event_id = n, keep_us, at, event_id

    def init(self, handle) -> None:
        self.handle = handle
        self.newest = handle.getListState("newest", "us bigint, id bigint")

    def _ends(self, rows: list[tuple]) -> int:
        return (rows[-1][0] + self.keep_us) // 1000 + 1

    def _changes(self, key, rows: list[tuple], change: str) -> pd.DataFrame:
        return pd.DataFrame({"session": [key[0]] * len(rows), "event_id": [r[1] for r in rows], "us": [r[0] for r in rows], "change": [change] * len(rows)}, dtype=object)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = sorted(tuple(r) for r in self.newest.get())
        new = [(_plain(a), _plain(i)) for f in rows for a, i in zip(f[self.at], f[self.event_id], strict=True)]
        now = sorted(set(before) | set(new))[-self.n :]
        if now == before:
            return
        self.newest.put(now)
        if not before or self._ends(before) != self._ends(now):
            if before:
                self.handle.deleteTimer(self._ends(before))
            self.handle.registerTimer(self._ends(now))
        yield self._changes(key, [r for r in now if r not in set(before)], "in")
        yield self._changes(key, [r for r in before if r not in set(now)], "out")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = sorted(tuple(r) for r in self.newest.get())
        self.newest.clear()
        yield self._changes(key, rows[-1:], "ended")

    def close(self) -> None:
        pass


def retained(events: DataFrame, n: int, keep: int, *, session: str = "user_id", event_id: str = "event_id", at: str = "us", late: str = "1 day") -> DataFrame:
    """Changes to what is kept: (session, event_id, us, change).

    An event that comes among the newest n of its session is `in`, one that
    leaves them `out`; a session without an event for `keep` microseconds is
    `ended` (with its last event), and its state goes. State holds n events of
    each living session.
    """
    stamped = events.select(session, event_id, at, F.timestamp_micros(at).alias("__ts")).withWatermark("__ts", late)
    kind = events.schema[session].dataType.simpleString()
    return stamped.groupBy(session).transformWithStateInPandas(Retained(n, keep, at, event_id), f"session {kind}, event_id bigint, us bigint, change string", "append", "EventTime")
