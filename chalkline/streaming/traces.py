"""Request traces as a stream: a request is put together in state until its end, or a timeout, is behind the watermark."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.traces import TRACE


class Assembler(StatefulProcessor):
    """State of a request: start, end, steps and newest event, in microseconds; -1 for what has not come."""

    def __init__(self, starts: Sequence[str], ends: Sequence[str], timeout: int):
        self.starts, self.ends, self.timeout = set(starts), set(ends), timeout

    def init(self, handle) -> None:
        self.handle, self.own = handle, handle.getValueState("own", "started bigint, ended bigint, steps bigint, newest bigint")

    def _due(self, own: tuple) -> int:
        """When the trace is complete: once all events up to its end have come, or after the timeout."""
        started, ended, _, newest = own
        return (newest if 0 <= started <= ended else newest + self.timeout) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.own.get()) if self.own.exists() else None
        started, ended, steps, newest = before or (-1, -1, 0, -1)
        for f in rows:
            for at, kind in zip(f["us"].tolist(), f["kind"].tolist(), strict=True):
                if kind in self.starts:
                    started = at if started < 0 else min(started, at)
                if kind in self.ends:
                    ended = max(ended, at)
                steps += kind not in self.starts and kind not in self.ends
                newest = max(newest, at)
        now = (started, ended, steps, newest)
        if before and self._due(before) != self._due(now):
            self.handle.deleteTimer(self._due(before))
        if not before or self._due(before) != self._due(now):
            self.handle.registerTimer(self._due(now))
        self.own.update(now)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        started, ended, steps, _ = tuple(self.own.get())
        self.own.clear()
        status = "orphan" if started < 0 else "done" if ended >= started else "timeout"
        row = (key[0], started if started >= 0 else None, ended if ended >= 0 else None, steps, ended - started if status == "done" else None, status)
        yield pd.DataFrame([row], columns=[c.split()[0] for c in TRACE.split(", ")], dtype=object)

    def close(self) -> None:
        pass


def traces(log: DataFrame, starts: Sequence[str], ends: Sequence[str], timeout: int, *, request: str = "request", at: str = "us", kind: str = "event_type", late: str = "1 hour") -> DataFrame:
    """The batch operator of this name as a stream; a trace comes once, when it is done or `timeout` after its newest event.

    Events may be late by `late`. What comes for a request after its trace is a
    trace of its own (an orphan, or a new start). Needs the RocksDB state store.
    """
    rows = log.where(F.col(request).isNotNull() & F.col(at).isNotNull())
    rows = rows.select(F.col(request).cast("string").alias("request"), F.col(at).alias("us"), F.col(kind).alias("kind"), F.timestamp_micros(at).alias("__ts")).withWatermark("__ts", late)
    return rows.groupBy("request").transformWithStateInPandas(Assembler(starts, ends, timeout), TRACE, "append", "EventTime")
