"""The keyed store against a plain dictionary: merges, versions, conflicts, repeated batches, compaction."""

import random

import pytest
from pyspark.sql import functions as F

from chalkline.sources import store as S
from chalkline.sources import tables

SCHEMA = "k string, at int, v string, hits int"


def rows_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def content(df):
    return sorted(map(tuple, df.select("k", "at", "v", "hits").collect()), key=str)


def test_versions_equal_a_dictionary(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "MOST_PARTS", 4)
    own = S.KeyedStore(spark, str(tmp_path / "s"), "k", "at", buckets=4)
    with pytest.raises(ValueError):
        own.read()
    rng, plain, seen = random.Random(1), {}, {}
    for step in range(7):
        batch = [(rng.choice(["a", "b", "c", "d", "e", None]), rng.randrange(6), f"{step}.{i}", i) for i in range(4)]
        batch = list({(k, at): (k, at, v, h) for k, at, v, h in batch}.values())
        version = own.upsert(rows_of(spark, batch))
        for r in batch:
            if r[0] not in plain or r[1] >= plain[r[0]][1]:
                plain[r[0]] = r
        seen[version] = sorted(plain.values(), key=str)
        assert content(own.read()) == seen[version]
    assert len(own.manifest()["parts"]) <= 5 and any(p.get("compacted") for p in own.manifest()["parts"])
    first = min(seen)
    assert content(own.read(first)) == seen[first]  # readers of an older version still see it
    before = own.version()
    assert own.compact() >= before and content(own.read()) == seen[max(seen)]
    assert own.vacuum(1) > 0 and content(own.read()) == seen[max(seen)]


def test_a_write_holds_only_its_rows_and_untouched_buckets_are_not_merged(spark, tmp_path):
    own = S.KeyedStore(spark, str(tmp_path / "s"), "k", "at", buckets=8)
    own.upsert(spark.range(500).select(F.concat(F.lit("k"), "id").alias("k"), F.lit(1).alias("at"), F.lit("x").alias("v"), F.lit(0).alias("hits")))
    own.upsert(rows_of(spark, [("k7", 2, "new", 1)]))
    part = own.manifest()["parts"][-1]
    assert spark.read.parquet(f"{own.path}/parts/{part['folder']}").count() == 1 and len(part["buckets"]) == 1
    assert own._changed(own.manifest()["parts"]) == part["buckets"]
    assert own.read().count() == 500 and [r.v for r in own.read().where("k = 'k7'").collect()] == ["new"]
    assert [(r.k, r["__seq"]) for r in own.changes(1).collect()] == [("k7", 2)]


def test_two_writers_one_wins_and_nothing_is_lost(spark, tmp_path):
    one, two = (S.KeyedStore(spark, str(tmp_path / "s"), "k", "at", buckets=2) for _ in range(2))
    base = one.upsert(rows_of(spark, [("a", 1, "x", 0)]))
    assert two.upsert(rows_of(spark, [("b", 1, "two", 0)]), expected=base) == base + 1
    with pytest.raises(S.Conflict):
        one.upsert(rows_of(spark, [("b", 2, "one", 0)]), expected=base)
    assert content(one.read()) == [("a", 1, "x", 0), ("b", 1, "two", 0)]
    # both commit the same version: the rename of the second fails, and it commits on top
    mine, theirs = one.manifest(), two.manifest()
    for m in (mine, theirs):
        m["version"] += 1
    assert one._commit(mine) and not two._commit(theirs)
    two.upsert(rows_of(spark, [("c", 1, "later", 0)]))
    assert len(content(one.read())) == 3
    assert one.insert_new(rows_of(spark, [("a", 9, "ignored", 0), ("d", 1, "new", 0)])) and {r[0]: r[2] for r in content(one.read())} == {"a": "x", "b": "two", "c": "later", "d": "new"}


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "s")
    run = tables.upsert_batches(path, "k", "at")
    run(rows_of(spark, [("a", 1, "x", 0), ("a", 3, "y", 0)]), 0)
    run(rows_of(spark, [("a", 2, "late", 0), ("b", 1, "z", 0)]), 1)
    version = S.KeyedStore(spark, path, "k", "at").version()
    run(rows_of(spark, [("a", 9, "again", 0)]), 1)
    own = S.KeyedStore(spark, path, "k", "at")
    assert own.version() == version and content(own.read()) == [("a", 3, "y", 0), ("b", 1, "z", 0)]
    run(rows_of(spark, []), 2)
    assert content(own.read()) == [("a", 3, "y", 0), ("b", 1, "z", 0)]


def test_merge_sums_and_removal(spark, tmp_path):
    own = S.KeyedStore(spark, str(tmp_path / "s"), "k", "at", buckets=2, merge=True, sums=["hits"])
    own.upsert(rows_of(spark, [("a", 1, "x", 1), ("a", 2, None, 1), ("b", 1, "y", 5)]))
    own.upsert(rows_of(spark, [("a", 3, None, 2), ("b", 2, "z", None)]))
    assert content(own.read()) == [("a", 3, "x", 4), ("b", 2, "z", 5)]
    own.remove(spark.createDataFrame([("a", 3), ("c", 1)], "k string, at int"))
    assert content(own.read()) == [("b", 2, "z", 5)]
    own.compact()
    own.upsert(rows_of(spark, [("a", 4, "back", 1)]))
    assert content(own.read()) == [("a", 4, "back", 1), ("b", 2, "z", 5)]


def test_a_stream_of_batches(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "s")
    for i in range(3):
        rows_of(spark, [("a", i, f"v{i}", 1), (f"k{i}", i, "x", 1)]).coalesce(1).write.mode("append").json(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(source)
    stream.writeStream.foreachBatch(tables.upsert_batches(path, "k", "at")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    got = content(S.KeyedStore(spark, path, "k", "at").read())
    assert got == [("a", 2, "v2", 1), ("k0", 0, "x", 1), ("k1", 1, "x", 1), ("k2", 2, "x", 1)]


def test_reads_prune_buckets_and_push_filters(spark, tmp_path):
    own = S.KeyedStore(spark, str(tmp_path / "s"), "k", "at", buckets=16)
    own.upsert(spark.range(400).select(F.concat(F.lit("k"), "id").alias("k"), F.lit(1).alias("at"), F.concat(F.lit("v"), F.col("id") % 3).alias("v"), F.col("id").cast("int").alias("hits")))
    own.upsert(rows_of(spark, [("k7", 2, "new", 1), (None, 1, "null key", 0)]))
    found = own.get(["k7", "k300", "missing", None])
    assert content(found) == [("k300", 1, "v0", 300), ("k7", 2, "new", 1), (None, 1, "null key", 0)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "__bucket#" in plan and "PushedFilters: [Or(In(k, [" in plan and "IsNull(k)" in plan
    newest = own.read().where("hits >= 390 and v = 'v0'").orderBy(F.desc("hits")).limit(2)
    assert [r.hits for r in newest.collect()] == [399, 396]
    scans = own.read().where("hits >= 390")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(hits,390)" in scans  # buckets without changes filter in the scan
