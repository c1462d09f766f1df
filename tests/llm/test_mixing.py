"""The mix of sources: targets by plain resharing, rounding by its invariants, reruns, chances and odd rows."""

import collections
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from chalkline.llm import mixing, shared

WORDS = re.compile(mixing.WORD)


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """Shares by weight; whoever is above the limit stays there and the excess is shared anew."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, held = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in held]
        left = total - sum(held.values())
        target = {s: Fraction(left * weight[s], sum(weight[r] for r in rest)) for s in rest}
        above = [s for s in rest if target[s] > most * sizes[s]]
        if not above:
            return held | target
        held |= {s: Fraction(most * sizes[s]) for s in above}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 10, "d": 2, None: 50}, {"a": 0, "b": 7}, {"a": 0}, {"é": 5, "z": 500, "A": 1, "𝒜": 3, "￿": 9}])
def test_targets_match_plain_resharing(spark, sizes):
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = plain_targets(sizes)
    assert {r.source: pytest.approx(float(want[r.source]), rel=1e-12) for r in got} == {r.source: r.target for r in got}


def rows_of(n=400):
    rows = [(i if i % 9 else None, f"s{i % 3}" if i % 50 else None, "w " * (i * 7919 % 97 + 1) if i % 11 else None) for i in range(n)]
    rows += [(5, "s2", "same words here")] * 40 + [(None, "s2", "")] * 3 + [(9, "s0", "long " * 9000)]
    return rows


def test_every_row_once_near_its_target_and_the_same_in_a_rerun(spark):
    rows = rows_of()
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    one = mixing.report(mixing.copies(docs)).collect()
    two = mixing.report(mixing.copies(docs.repartition(7, "text").select("*", F.lit(1).alias("rows"), F.lit(2).alias("copies"), F.lit("x").alias("hash")))).collect()
    assert sorted(map(repr, one)) == sorted(map(repr, two))
    size = lambda t: len(WORDS.findall(t or ""))
    assert collections.Counter((r.doc_id, r.size) for r in one) == collections.Counter((d, size(t)) for d, _, t in rows)
    sizes = collections.Counter()
    for _, s, t in rows:
        sizes[s] += size(t)
    want = plain_targets(dict(sizes))
    assert all(0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in one)
    by_target = collections.Counter()
    for r in one:
        by_target[round(r.target, 6)] += r.taken
    for s, t in want.items():
        # s0 has a document that is longer than the target; it comes whole or not at all
        assert abs(by_target[round(float(t), 6)] - t) <= (9000 if s == "s0" else 97), s


def test_rounding_has_no_bias(spark):
    sizes = [2100] * 3 + [400] * 20 + [100] * 30 + [20] * 30  # the shorter ones can make up for a longer one
    docs = spark.createDataFrame([(i, f"{s:04d}", "w " * n) for s in range(200) for i, n in enumerate(sizes)], "doc_id long, source string, text string")
    got = mixing.copies(docs, weights=(1, 2)).groupBy("size", "target").agg(F.avg("copies").alias("mean"), F.count("*").alias("n")).collect()
    assert len(got) == 8
    for r in got:
        want = r.target / sum(sizes)
        assert abs(r["mean"] - want) < 4.5 * 0.5 / r.n**0.5, r


def test_fold_settles_all_but_one_and_keeps_the_sum(spark):
    unit = "struct<size:bigint,words:double,chance:double,id:int>"
    blocks = spark.sql(f"SELECT b, collect_list(named_struct('size', cast(id % 17 + 1 as bigint), 'words', (id % 17 + 1) * pmod(hash(id, b), 1000) / 1001D + 0.0005D, 'chance', pmod(hash(b, id, 1), 1000) / 1000D, 'id', cast(id as int))) AS u FROM (SELECT id, explode(sequence(1, 30)) AS b FROM range(40)) GROUP BY b")
    assert blocks.schema["u"].dataType.elementType.simpleString() == unit
    for r in blocks.select("u", mixing._fold(F.col("u")).alias("f")).collect():
        assert sorted(x.unit.id for x in r.f) == list(range(40))
        assert [x.up for x in r.f].count(None) == 1
        left = [x.unit for x in r.f if x.up is None][0]
        assert -1e-9 <= left.words <= left.size + 1e-9
        assert sum(x.unit.size for x in r.f if x.up) + left.words == pytest.approx(sum(u.words for u in r.u))


def test_mixed_repeats_whole_rows(spark):
    docs = spark.createDataFrame(rows_of(120), "doc_id long, source string, text string").select("*", F.lit("own").alias("copies"), F.lit(7).alias("row"))
    taken = mixing.copies(docs)
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    assert got.count() == taken.agg(F.sum("copies")).first()[0]
    assert got.where("copies <> 'own' or row <> 7").count() == 0


def test_empty_tables_and_sources_without_words(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.report(mixing.copies(docs)).columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert mixing.report(mixing.copies(docs)).collect() == [] == mixing.mixed(docs).collect()
    docs = spark.createDataFrame([(1, "a", None), (2, None, " ")], docs.schema)
    assert sorted(map(tuple, mixing.report(mixing.copies(docs)).collect())) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_a_large_side_meets_in_parts_with_the_same_rows(spark):
    rows = spark.createDataFrame([("a" if i % 2 else None, i) for i in range(50)], "source string, x int")
    params = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "source string, y int")
    few, many = (shared.joined_small(rows, params, ["source"], most) for most in (10, 0))
    assert sorted(map(tuple, few.collect()), key=str) == sorted(map(tuple, many.collect()), key=str)
    assert few.columns == many.columns == ["source", "x", "y"]
