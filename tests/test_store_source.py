"""The keyed store as a data source: the same rows as the store's own read, pushed filters, and a stream of versions."""

import pytest
from pyspark.sql import functions as F

from chalkline.sources import store_source
from chalkline.sources.store import KeyedStore

SCHEMA = "k string, at int, v string, hits int"


@pytest.fixture()
def store(spark, tmp_path):
    own = KeyedStore(spark, f"file://{tmp_path}/s", "k", "at", buckets=4)
    own.upsert(spark.range(300).select(F.concat(F.lit("k"), "id").alias("k"), F.lit(1).alias("at"), F.concat(F.lit("v"), F.col("id") % 3).alias("v"), F.col("id").cast("int").alias("hits")))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield own
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def rows(df):
    return sorted(map(tuple, df.select("k", "at", "v", "hits").collect()), key=str)


def test_batches_equal_the_store(spark, store):
    assert rows(store_source.frame(store)) == rows(store.read())
    store.upsert(spark.createDataFrame([("k7", 2, "new", 1), ("k8", 0, "older", 1), (None, 1, "null key", 5)], SCHEMA))
    store.remove(spark.createDataFrame([("k9", 1), ("k10", 0)], "k string, at int"))
    assert rows(store_source.frame(store)) == rows(store.read()) and len(rows(store.read())) == 300
    for where in ("hits >= 290", "v = 'v1' and hits < 9", "k in ('k7', 'k8', 'k9')", "k is null", "v like '%w' or hits = 3", "k is not null and hits <= 1"):
        assert rows(store_source.frame(store).where(where)) == rows(store.read().where(where)) != []


def test_filters_reach_the_scan(spark, store):
    got = store_source.frame(store).where("hits >= 290 and upper(v) = 'V1'")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hits" not in plan.partition("BatchScan")[0].partition("Filter")[2].partition("\n")[0]  # Spark filters by upper(v) alone
    assert [r.hits for r in got.orderBy("hits").collect()] == [292, 295, 298]


def test_a_stream_gives_the_rows_of_each_version(spark, store, tmp_path):
    store_source.register(spark)

    def run():
        stream = spark.readStream.format("keyed_store").option("key", "k").option("at", "at").load(store.path)
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return spark.read.schema(SCHEMA).parquet(str(tmp_path / "out"))

    assert rows(run()) == rows(store.read())
    store.upsert(spark.createDataFrame([("k7", 2, "new", 1), ("x", 1, "more", 1)], SCHEMA))
    newest = run()
    assert newest.count() == 302
    assert rows(newest.groupBy("k").agg(F.max_by(F.struct("at", "v", "hits"), "at").alias("r")).select("k", "r.*")) == rows(store.read())


def test_an_unwritten_store_says_so(spark, tmp_path):
    store_source.register(spark)
    with pytest.raises(Exception, match="nothing has been written"):
        spark.read.format("keyed_store").option("key", "k").option("at", "at").load(str(tmp_path / "none"))
