"""Many words in one pass: bits against plain substring tests."""

import random

import pytest
from pyspark.sql import functions as F

from chalkline.functions.matcher import BITS, Lexicon


def test_bits_equal_plain_substring_tests(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abé日") for _ in range(rng.randrange(1, 5))) for _ in range(500)})  # one inside another, and overlapping
    assert len(words) > 2 * BITS and any(a in b for a in words for b in words if a != b)
    texts = ["".join(rng.choice("abé日 ") for _ in range(rng.randrange(0, 60))) for _ in range(300)] + [None, "", "x" * 30_000 + words[3], words[-1]] * 3
    groups = [words[:5], words[BITS - 2 : BITS + 2], words, words[100:101], [words[7], words[7]]]
    lexicon = Lexicon(words)
    hits = lexicon.hits(F.col("t"))
    asked = [x for i, g in enumerate(groups) for x in (lexicon.any_of(F.col("h"), g).alias(f"any{i}"), lexicon.count_of(F.col("h"), g).alias(f"n{i}"))]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", hits.alias("h")).select("t", *asked).collect():
        for i, g in enumerate(groups):
            found = None if r.t is None else len({w for w in g if w in r.t})
            assert (r[f"any{i}"], r[f"n{i}"]) == (None if found is None else found > 0, found or 0)


def test_predicates_may_come_before_the_hits(spark):
    lexicon = Lexicon()
    has = lexicon.any_of(F.col("h"), ["asid", "si"])
    table = spark.createDataFrame([("asid",), ("basic",), ("x",)], "t string").withColumn("h", lexicon.hits(F.col("t")))
    assert [r[0] for r in table.select(has).collect()] == [True, True, False]
    assert Lexicon().hits(F.col("t")) is not None
    with pytest.raises(ValueError):
        Lexicon([""])
