"""Streams in event-time order: shuffled events over many batches equal the batch operators."""

import random

import pytest
from pyspark.sql import functions as F

from chalkline.operators import quotas
from chalkline.operators import traces as batch_traces
from chalkline.streaming import ordered
from chalkline.streaming import traces as stream_traces

SCHEMA = "event_id long, user_id string, us long"
SECOND = 1_000_000


@pytest.fixture(scope="module")
def events():
    rng = random.Random(3)
    times = rng.sample(range(0, 3600), 300)
    return [(i, rng.choice(["a", "b", "c"]), t * SECOND) for i, t in enumerate(times)]


@pytest.fixture(scope="module")
def source(spark, events, tmp_path_factory):
    """Batches in a shuffled order; then two events far ahead, which let the watermark pass all others."""
    folder = str(tmp_path_factory.mktemp("events"))
    rows = list(events)
    random.Random(4).shuffle(rows)
    for k in range(0, len(rows), 50):
        spark.createDataFrame(rows[k : k + 50], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    for i in (1, 2):
        spark.createDataFrame([(-i, "z", 10**6 * i * SECOND)], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return folder


def run(spark, source, stream, name, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ordered.ROCKSDB)
    try:
        rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        q = stream(rows).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(200)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return [r for r in spark.table(name).collect() if r.event_id is None or r.event_id >= 0]


CASES = {
    "cooldown": (lambda df: ordered.cooldown(df, 60 * SECOND), lambda df: quotas.cooldown(df, 60 * SECOND)),
    "rate": (lambda df: ordered.rate_limit(df, 2, 120 * SECOND), lambda df: quotas.rate_limit(df, 2, 120 * SECOND)),
    "rolling": (
        lambda df: ordered.rolling_limits(df, [("minute", 60 * SECOND, 1), ("hour", 600 * SECOND, 8)]),
        lambda df: quotas.rolling_audit(df, [("minute", "user_id", 60 * SECOND, 1), ("hour", "user_id", 600 * SECOND, 8)]).select("event_id", "n_minute", "n_hour", "reason"),
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_shuffled_events_equal_the_batch_operator(spark, events, source, tmp_path, name):
    stream, batch = CASES[name]
    got = run(spark, source, stream, f"ordered_{name}", tmp_path)
    expected = batch(spark.createDataFrame(events, SCHEMA)).collect()
    assert len(got) == len(events) and sorted(map(tuple, got)) == sorted(map(tuple, expected))


def test_retention_equals_the_newest_and_the_old_sessions(spark, events, source, tmp_path):
    got = run(spark, source, lambda df: ordered.retained(df, 5, 1000 * SECOND, late="2 hours"), "retained", tmp_path)
    kept = {(r.session, r.event_id) for r in got if r.change == "in"} - {(r.session, r.event_id) for r in got if r.change == "out"}
    plain = {}
    for i, user, us in events:
        plain.setdefault(user, []).append((us, i))
    assert kept == {(u, i) for u, rows in plain.items() for _, i in sorted(rows)[-5:]}
    ended = [(r.session, r.us) for r in got if r.change == "ended"]
    assert sorted(ended) == sorted((u, max(rows)[0]) for u, rows in plain.items())


LOG = [
    ("done", 10, "start"), ("done", 11, "step"), ("done", 12, None), ("done", 20, "end"), ("late end", 30, "start"), ("late end", 90, "end"), ("late end", 60, "step"), ("no end", 40, "start"), ("no end", 45, "step"), ("no start", 50, "step"),
    ("no start", 55, "end"), ("end before", 70, "end"), ("end before", 80, "start"), ("recent", 990, "start"), (None, 5, "start"), ("two ends", 100, "start"), ("two ends", 110, "end"), ("two ends", 120, "end"), ("no time", None, "start"),
]
EXPECTED = {
    ("done", 10, 20, 2, 10, "done"), ("late end", 30, 90, 1, 60, "done"), ("no end", 40, None, 1, None, "timeout"), ("no start", None, 55, 1, None, "orphan"), ("end before", 80, 70, 0, None, "timeout"), ("two ends", 100, 120, 0, 20, "done"),
}


def seconds(rows):
    return {(r.request, *(None if x is None else x // SECOND for x in (r.started, r.ended)), r.n_steps, None if r.elapsed is None else r.elapsed // SECOND, r.status) for r in rows}


def test_traces_of_a_log(spark):
    rows = [(r, None if t is None else t * SECOND, k) for r, t, k in LOG]
    log = spark.createDataFrame(rows, "request string, us long, event_type string")
    found = batch_traces.traces(log, ["start"], ["end"], 300 * SECOND)
    assert seconds(found.collect()) == EXPECTED | {("recent", 990, None, 0, None, "open")}
    assert {(r.status, r.n, r.n_steps) for r in batch_traces.by_status(found).collect()} == {("done", 3, 3), ("timeout", 2, 1), ("orphan", 1, 1), ("open", 1, 0)}
    assert batch_traces.traces(log.limit(0), ["start"], ["end"], 1).collect() == []


def test_traces_of_a_stream_with_late_and_missing_ends(spark, tmp_path):
    schema = "request string, us long, event_type string"
    rows = [(r, None if t is None else t * SECOND, k) for r, t, k in LOG]
    random.Random(6).shuffle(rows)
    batches = [rows[:6], rows[6:12], rows[12:], [("far", 100_000 * SECOND, "step")], [("farther", 200_000 * SECOND, "step")]]
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ordered.ROCKSDB)
    try:
        log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = stream_traces.traces(log, ["start"], ["end"], 300 * SECOND).writeStream.format("memory").queryName("traces").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(200)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = [r for r in spark.table("traces").collect() if not r.request.startswith("far")]
    assert len(got) == 7 and seconds(got) == EXPECTED | {("recent", 990, None, 0, None, "timeout")}
