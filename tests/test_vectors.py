"""Search and inner products against brute force, by broadcast and in tiles."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chalkline.operators import vectors


@pytest.mark.parametrize("few", [vectors.FEW_QUERIES, 0])
def test_pairwise_reaches_rows_outside_the_set(spark, few):
    rows = [(i, [float(i % 5), float(i % 7), 1.0]) for i in range(0, 330, 11)] + [(100, [1.0, 0.0, 2.0]), (200, [0.0, 1.0, 2.0]), (300, [2.0, 2.0, 0.0]), (301, None), (302, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    own = table.where("vec_id % 100 = 0")
    got = sorted(tuple(r) for r in vectors.pairwise(own, table, few=few).collect())
    usable = [(i, v) for i, v in rows if v and len(v) == 3]
    every = [(a, b, sum(x * y for x, y in zip(u, v))) for a, u in usable for b, v in usable if a % 100 == 0 and (a < b or (a > b and b % 100))]
    assert got == sorted(every)
    assert sorted(tuple(r) for r in vectors.pairwise(own, few=few).collect()) == sorted(p for p in every if p[1] % 100 == 0)
    assert vectors.pairwise(own.limit(0), table).count() == 0 and vectors.pairwise(own, table.limit(0)).count() == 0


def brute(asked, index, k, by, threshold):
    out = []
    for q, u in asked:
        groups = {}
        for r in index:
            v = r[-1]
            if u and v and len(u) == len(v) and None not in v and None not in u:
                s = float(np.dot(u, v))
                if threshold is None or s >= threshold:
                    groups.setdefault(r[1] if by else None, []).append((-s, r[0], str(r[2]), r))
        for rows in groups.values():
            out += [(q, r[0], -s, i) for i, (s, _, _, r) in enumerate(sorted(rows, key=lambda x: x[:2])[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("few", [vectors.FEW_QUERIES, 0])
@pytest.mark.parametrize(("k", "by", "threshold"), [(3, (), None), (5, ("kind",), None), (4, ("kind",), 2.0), (1000, (), None)])
def test_top_k_with_ties_repeats_nulls_and_other_lengths(spark, monkeypatch, few, k, by, threshold):
    for name, value in (("QUERY_BLOCK", 4), ("INDEX_BLOCK", 16), ("QUERY_TILE", 8), ("INDEX_TILE", 40)):
        monkeypatch.setattr(vectors, name, value)
    rng = random.Random(k)
    vector = lambda: [float(rng.randrange(-2, 3)) for _ in range(4)]
    index = [(i, rng.choice(["a", "b", None]), f"text {i}", vector()) for i in range(150)]
    index += [(200, "a", "x", None), (201, "a", "x", [1.0]), (202, "b", "x", [None, 1.0, 1.0, 1.0]), (203, "b", "x", [])]
    asked = [(i, vector()) for i in range(20)] + [(90, None), (91, [1.0]), (92, [])]
    table = spark.createDataFrame(index, "pos long, kind string, content string, embedding array<double>").repartition(5)
    queries = spark.createDataFrame(asked, "query_id long, embedding array<double>").repartition(3)
    got = vectors.top_k(queries, table, k, by=by, threshold=threshold, few=few)
    assert got.columns == ["query_id", "pos", "kind", "content", "score", "rank_in_group"]
    rows = got.collect()
    assert all(r.content == ("x" if r.pos >= 200 else f"text {r.pos}") for r in rows)
    assert sorted(((r.query_id, r.pos, r.score, r.rank_in_group) for r in rows), key=str) == brute(asked, index, k, by, threshold)


def test_rows_that_differ_in_their_payload_only_are_all_found(spark):
    rows = [(1, f"t{i // 2}", [1.0, 0.0]) for i in range(6)] + [(2, "u", [0.5, 0.0])]
    table = spark.createDataFrame(rows, "pos long, content string, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0])], "query_id long, embedding array<double>")
    got = vectors.top_k(queries, table, 4).collect()
    assert sorted((r.query_id, r.pos, r.rank_in_group) for r in got) == [(q, 1, i) for q in (1, 2) for i in (1, 2, 3, 4)]
    whole = vectors.top_k(queries, table, 10).where("query_id = 1").groupBy("content").count().collect()
    assert sorted(map(tuple, whole)) == [("t0", 2), ("t1", 2), ("t2", 2), ("u", 1)]


def test_fifty_thousand_queries_in_one_plan(spark):
    """The plan is that of a few queries in tiles, and no query is on the driver."""
    n = 50_000
    unit = lambda c: F.array(*(F.sin(c * (j + 1) * 1.7) for j in range(8)))
    queries = spark.range(n).select(F.col("id").alias("query_id"), unit(F.col("id")).alias("embedding"))
    index = spark.range(3000).select(F.col("id").alias("pos"), F.concat(F.lit("c"), "id").alias("content"), unit(F.col("id") + 0.5).alias("embedding"))
    hits = vectors.top_k(queries, index, 3)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoop" not in plan and "CartesianProduct" not in plan and plan.count("MapInArrow") < 6
    got = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("rank_in_group", "pos"))).alias("rows"))
    assert got.where("n = 3").count() == n
    x = np.array([r.embedding for r in index.orderBy("pos").collect()])
    for r in got.where("query_id % 4999 = 0").join(queries, "query_id").collect():
        s = x @ np.array(r.embedding)
        assert [h.pos for h in r.rows] == np.lexsort((np.arange(len(s)), -s))[:3].tolist()
