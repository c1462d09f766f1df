"""Incremental indexing, and errors of single rows."""

import json

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkline.operators import isolation
from chalkline.plans import retrieval
from chalkline.plans.incremental import IncrementalIndex


def test_only_changed_files_are_embedded(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def embedder(text):
        @F.arrow_udf(T.ArrayType(T.FloatType()))
        def embed(texts: pa.Array) -> pa.Array:
            calls.add(len(texts))
            return pa.array([[float(len(t)), float(sum(map(ord, t)) % 1000)] for t in texts.to_pylist()], pa.list_(pa.float32()))

        return embed(text)

    body = lambda i, word: f"# H{i}\n" + f"{word} beta gamma delta {i} " * 12 + "\n---\n" + f"second part {word} of file {i} with more words " * 6
    plain = {f"f{i}.md": body(i, "alpha") for i in range(1000)}
    table = lambda d: spark.createDataFrame(list(d.items()), "source_file string, text string")
    own = IncrementalIndex(spark, str(tmp_path / "ix"), embedder, buckets=8)
    assert own.sync(table(plain)) == {"changed": 1000, "removed": 0, "embedded": 2000}
    whole = retrieval.build_index(table(plain), embedder)
    columns = ["chunk_id", "content", "embedding", "index_name", "pos"]
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert rows(own.index()) == rows(whole)

    plain["f7.md"] = body(7, "alpha").replace("second part", "other part")
    before, version = calls.value, own.files.version()
    assert own.sync(table(plain)) == {"changed": 1, "removed": 0, "embedded": 1}
    assert calls.value - before == 1 and own.files.version() == version + 1
    assert own.sync(table(plain)) == {"changed": 0, "removed": 0, "embedded": 0} and own.files.version() == version + 1

    del plain["f8.md"]
    plain["empty.md"] = None
    plain["copy.md"] = plain["f9.md"]
    assert own.sync(table(plain)) == {"changed": 2, "removed": 1, "embedded": 0}
    assert rows(own.index()) == rows(retrieval.build_index(table(plain), embedder))
    own.batches()(table({"f8.md": body(8, "alpha")}), 0)  # back from a stream; no other file is removed
    assert own.index().select("source_file").distinct().count() == 1001


def test_a_poisoned_row_fails_alone(spark, tmp_path):
    def ratio(row):
        d = json.loads(row["payload"])
        return {"ratio": 1 / d["n"], "kind": d.get("kind")}

    rows = [(1, '{"n": 2, "kind": "a"}'), (2, '{"n": 0}'), (3, "{broken"), (4, None), (5, "{}"), (6, '{"n": 4, "kind": 7}'), (7, '{"n": -1}')]
    table = spark.createDataFrame(rows, "id long, payload string").withColumn("reason", F.lit("clash")).drop("reason")
    checked = isolation.checked(table, {"no payload": F.col("payload").isNull(), "negative": F.col("payload").contains("-")})
    got = isolation.attempted(checked, ratio, "ratio double, kind string")
    assert {r.id: (r.ratio, r.kind, r.status, r.reason) for r in got.collect()} == {
        1: (0.5, "a", "ok", None), 2: (None, None, "failed", "ZeroDivisionError"), 3: (None, None, "failed", "JSONDecodeError"), 4: (None, None, "failed", "no payload"), 5: (None, None, "failed", "KeyError"),
        6: (None, None, "failed", "ArrowTypeError"), 7: (None, None, "failed", "negative"),
    }
    assert {(r.status, r.reason): r.n for r in isolation.by_reason(got).collect()}["ok", None] == 1
    path = str(tmp_path / "dead")
    assert isolation.split(got, path, "payloads").columns == ["id", "payload", "ratio", "kind"]
    dead = spark.read.parquet(path).collect()
    assert len(dead) == 6 and {r.source for r in dead} == {"payloads"} and json.loads(next(r.payload for r in dead if r.reason == "KeyError"))["id"] == 5
    assert isolation.attempted(table.limit(0), ratio, "ratio double, kind string").collect() == []
