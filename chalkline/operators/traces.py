"""Request traces: start, steps and end of each request in an event log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRACE = "request string, started bigint, ended bigint, n_steps bigint, elapsed bigint, status string"


def status_of(started: Column, ended: Column, newest: Column, now: Column, timeout: int) -> Column:
    """done with an end at or after the start, orphan without a start, else timeout or open by the time since its newest event."""
    return F.when(started.isNull(), "orphan").when(ended >= started, "done").when(now - newest > timeout, "timeout").otherwise("open")


def traces(log: DataFrame, starts: Sequence[str], ends: Sequence[str], timeout: int, *, request: str = "request", at: str = "us", kind: str = "event_type") -> DataFrame:
    """One row for each request (columns of TRACE; times in microseconds).

    A request starts with its first event of a kind in `starts` and ends with
    its last of one in `ends`; its other events are steps. elapsed is null
    unless it is done. A request without an end times out when its newest event
    is more than `timeout` before the newest of the log. Events without a
    request or time do not count; kinds may be null (steps). One aggregation,
    combined before the shuffle, so a request may hold most of the log.
    """
    rows = log.where(F.col(request).isNotNull() & F.col(at).isNotNull())
    is_start, is_end = (F.coalesce(F.col(kind).isin(*kinds), F.lit(False)) for kinds in (starts, ends))
    own = rows.groupBy(F.col(request).cast("string").alias("request")).agg(
        F.min(F.when(is_start, F.col(at))).alias("started"), F.max(F.when(is_end, F.col(at))).alias("ended"), F.sum((~is_start & ~is_end).cast("long")).alias("n_steps"), F.max(at).alias("__newest")
    )
    now = F.lit(rows.agg(F.max(at)).first()[0]).cast("long")
    status = status_of(F.col("started"), F.col("ended"), F.col("__newest"), now, timeout)
    out = own.withColumn("status", status).withColumn("elapsed", F.when(F.col("status") == "done", F.col("ended") - F.col("started")))
    return out.select("request", "started", "ended", "n_steps", "elapsed", "status")


def by_status(found: DataFrame) -> DataFrame:
    """Requests of each status, with the mean and the largest elapsed time."""
    return found.groupBy("status").agg(F.count("*").alias("n"), F.sum("n_steps").alias("n_steps"), F.avg("elapsed").alias("mean_elapsed"), F.max("elapsed").alias("max_elapsed"))
