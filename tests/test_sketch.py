"""The sketch of a cache's keys: no miss is lost, and few rows go through the join."""

from pyspark.sql import functions as F

from chalkline.operators import memory
from chalkline.operators.sketch import Sketch, anti_join


def test_no_miss_is_lost_and_few_rows_are_joined(spark, tmp_path):
    texts = spark.range(30_000).select(F.concat(F.lit("text "), F.col("id") % 20_000).alias("text"))
    cache = spark.range(15_000, 60_000).select(F.sha2(F.concat(F.lit("text "), "id"), 256).alias("sha"))
    Sketch.of(cache, "sha").save(str(tmp_path / "sketch"))
    sketch = Sketch.load(spark, str(tmp_path / "sketch"))
    plain = memory.unseen(texts, cache)
    pruned = memory.unseen(texts, cache, sketch=sketch)
    assert pruned.columns == plain.columns and pruned.count() == plain.count() == 15_000
    assert pruned.select("sha").exceptAll(plain.select("sha")).count() == 0
    rows = texts.select(F.sha2("text", 256).alias("sha")).distinct()
    joined = rows.where(sketch.might_have(F.col("sha"))).count()
    assert 5_000 <= joined < 5_000 + 15_000 * 0.03  # of 20000 rows, those that the cache has and a few others


def test_nulls_empty_caches_and_large_ones(spark, tmp_path):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "sha string")
    none = rows.limit(0)
    sketch = Sketch.of(none, "sha")
    assert sorted(map(str, anti_join(rows, none, "sha", sketch).collect())) == sorted(map(str, rows.collect()))
    own = Sketch.of(rows, "sha")
    assert [r.sha for r in anti_join(rows, rows, "sha", own).collect()] == [None]
    assert Sketch.of(rows, "sha", most_bytes=1) is None
    assert [r.sha for r in anti_join(rows, rows, "sha", None).collect()] == [None]
    sketch.save(str(tmp_path / "none"))
    assert Sketch.load(spark, str(tmp_path / "none")) is None
