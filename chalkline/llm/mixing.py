"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a target in words, and each of its documents the same number of
copies, a fraction. Its whole part is taken as it is. The rest of it is rounded
in pairs: of two documents, words go from one to the other, at random and
without bias, until one has no fraction of a copy or a whole one; the sum of
both stays. Blocks of BLOCK documents are folded so, in parallel, and what is
left of each block goes to the next level of a tree, up to one for a source.

Long documents (see LEAST_WORDS) go through a tree of their own first. What is
left there is paired with all shorter documents of the source as one, whose
common share rises or falls by the words that it gives or takes. In the end the
words of a source are off its target by less than one short document, unless a
long one is more than all shorter ones can make up for; but for such ones, each
row is taken `target / source_size` times on average. Randomness is a hash of
the row, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import joined_small, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MOST_COPIES, SEED = (1, 2, 3), 3, 11
#: Documents of a block (on average in the first level, at most in the others).
BLOCK = 64
#: Documents of so many words and more are rounded before shorter ones, class by class.
LEAST_WORDS = (2048, 256, 32, 0)
#: What tells rows apart; rows equal in all of it are one unit with a count.
UNIT = ("source", "doc_id", "size", "hash")


def units(docs: DataFrame) -> DataFrame:
    """source, doc_id, size (words of the text), hash (of the text) and rows: how many rows are equal in these."""
    rows = docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return rows.select("source", "doc_id", size.alias("size"), F.xxhash64("text").alias("hash")).groupBy(*UNIT).agg(F.count("*").alias("rows"))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """sizes (source, source_size) with a column target: shares of all words by weight, at most `most` times a source's size.

    Sources by code point, null last, have the weights in turn. In ascending
    order of limit by weight, a source has its limit as long as that is below
    its share of what those before it leave; the others share the rest. Windows
    run over one row for each source.
    """
    place = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(place) - 1) % len(weights) + 1)
    own = sizes.withColumn("weight", weight.cast("long")).withColumn("limit", F.col("source_size") * most)
    up = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    left = F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("limit").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = own.withColumn("left", left).withColumn("share", F.sum("weight").over(up.rowsBetween(0, W.unboundedFollowing)))
    level = F.col("left") / F.col("share")
    free = F.col("limit") >= level * F.col("weight")
    # the first that its limit does not bind sets the level of all after it
    first = F.first(F.when(free, F.struct("left", "share")), ignorenulls=True).over(up.rowsBetween(W.unboundedPreceding, 0))
    target = F.when(first.isNull(), F.col("limit").cast("double")).otherwise(first["left"].cast("double") * F.col("weight") / first["share"])
    return own.select("source", "source_size", target.alias("target"))


def _chance(level: int, seed: int) -> Column:
    """From 0 to 1, by the unit, the level and the seed."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(level), *UNIT), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _fold(block: Column) -> Column:
    """Array of units with words to round -> the same units, each with up (false or true; null for one whose words are left)."""

    def step(acc: Column, j: Column) -> Column:
        i = acc["last"]
        give = F.least(i["size"] - i["words"], j["words"])  # from j to i
        take = F.least(i["words"], j["size"] - j["words"])
        to_i = j["chance"] * (give + take) < take
        # i is whole or empty, and j goes on; or the other way round
        i_ends = F.when(to_i, give == i["size"] - i["words"]).otherwise(take == i["words"])
        i_words = F.when(to_i, i["words"] + give).otherwise(i["words"] - take)
        j_words = F.when(to_i, j["words"] - give).otherwise(j["words"] + take)
        ended = F.when(i_ends, i).otherwise(j)
        goes_on = F.when(i_ends, j.withField("words", j_words)).otherwise(i.withField("words", i_words))
        up = F.when(i_ends, to_i).otherwise(~to_i)
        return F.struct(F.concat(acc["done"], F.array(F.struct(ended.alias("unit"), up.alias("up")))).alias("done"), goes_on.alias("last"))

    rest = F.slice(block, 2, F.greatest(F.size(block) - 1, F.lit(0)))
    done = F.filter(F.array(F.struct(block[0].alias("unit"), F.lit(True).alias("up"))), lambda _: F.lit(False))
    start = F.struct(done.alias("done"), block[0].alias("last"))
    return F.aggregate(rest, start, step, lambda a: F.concat(a["done"], F.array(F.struct(a["last"].alias("unit"), F.lit(None).cast("boolean").alias("up")))))


def _rounded(rows: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """The tree of one class of length, for rows with UNIT, rows, whole, words (of a fraction of a copy) and block.

    Returns the settled units with copies, and what is left: a unit of each source at most.
    """
    payload = [*UNIT[1:], "rows", "whole"]
    done = [rows.where("words = 0").select(*UNIT, "rows", F.col("whole").alias("copies"))]
    rows = rows.where("words > 0")
    level = 0
    while True:
        # longest first; ties by a hash that the chance does not depend on
        unit = F.struct((-F.col("size")).alias("order"), F.xxhash64(F.lit("order"), F.lit(seed), F.lit(level), *UNIT).alias("tie"), _chance(level, seed).alias("chance"), *payload, "words")
        blocks = rows.groupBy("source", "block").agg(F.sort_array(F.collect_list(unit)).alias("units"))
        folded = blocks.select("source", "block", F.explode(_fold(F.col("units"))).alias("x"))
        folded = written(folded.select("source", "block", *(f"x.unit.{c}" for c in [*payload, "words"]), "x.up"), "mix-level")
        done.append(folded.where("up is not null").select(*UNIT, "rows", (F.col("whole") + F.col("up").cast("long")).alias("copies")))
        rows = folded.where("up is null").drop("up")
        level += 1
        if not rows.where("block > 0").limit(1).count():  # one block for each source at most
            break
        rows = rows.withColumn("block", F.floor(F.col("block") / BLOCK))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out, rows.drop("block")


def _shared(state: DataFrame, left: DataFrame, most: int, seed: int, last: bool) -> DataFrame:
    """The units left of a class with copies, and the share of shorter documents after it.

    The unit and all shorter documents of its source are a pair as well: words
    go from one to the other until the unit is whole or empty, at random and
    without bias. Where the shorter ones could make up for only one of both, it
    is that; where for none, what is nearer to the target. A unit of the last
    class has none shorter, and chance alone decides.
    """
    left = left.alias("l")
    both = state.alias("s").join(left, F.col("s.source").eqNullSafe(F.col("l.source")), "left").select("s.*", *(F.col(f"l.{c}").alias(f"left_{c}") for c in [*UNIT, "rows", "whole", "words"]))
    words, size, pool = F.col("left_words"), F.col("left_size"), F.col("share") * F.col("rest")
    fill, room = size - words, most * F.col("rest") - pool
    chance = F.pmod(F.xxhash64(F.lit("pool"), F.lit(seed), *(F.col(f"left_{c}") for c in UNIT)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    by_chance = (fill <= pool) & (words <= room) | F.lit(last)
    up = F.when(by_chance, chance * size < words).otherwise(fill - pool <= words - room)
    to_unit = F.when(size.isNull(), 0.0).when(up, F.least(fill, pool)).otherwise(-F.least(words, room))
    share = F.when(F.col("rest") > 0, F.least(F.greatest((pool - to_unit) / F.col("rest"), F.lit(0.0)), F.lit(float(most)))).otherwise(0.0)
    return both.withColumn("left_copies", F.col("left_whole") + up.cast("long")).withColumn("share", share)


def copies(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """UNIT, rows, copies (of all rows of the unit), source_size and target.

    docs has source, doc_id and text; others are not read. A null text has no
    words; null sources are one source and null ids ordinary ones. Rows equal in
    source, id and text are one unit, whose copies are dealt out evenly. An
    empty table gives none. No row has more than `most` copies on average of its
    unit, rounded up.
    """
    class_of = F.lit(len(LEAST_WORDS) - 1)
    for i, least in reversed(list(enumerate(LEAST_WORDS))):
        class_of = F.when(F.col("size") >= least, F.lit(i)).otherwise(class_of)
    own = written(units(docs).withColumn("class", class_of), "mix-units")
    words = F.sum(F.col("size") * F.col("rows"))
    by_class = own.groupBy("source").pivot("class", list(range(len(LEAST_WORDS)))).agg(words.alias("words"), F.count("size").alias("n")).na.fill(0)
    total = sum((F.col(f"{i}_words") for i in range(len(LEAST_WORDS))), F.lit(0))
    by_class = written(by_class.withColumn("source_size", total), "mix-classes").alias("c")
    state = targets(by_class.select("source", "source_size"), weights, most).alias("t")
    state = by_class.join(state, F.col("c.source").eqNullSafe(F.col("t.source"))).select("c.*", "t.target")
    share = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    state = written(state.withColumn("share", share).withColumn("rest", F.col("source_size")), "mix-sources")
    columns, out = state.columns, None
    for i in range(len(LEAST_WORDS)):
        params = state.select("source", "share", F.greatest(F.ceil(F.col(f"{i}_n") / BLOCK), F.lit(1)).alias("blocks"))
        rows = joined_small(own.where(F.col("class") == i), params, ["source"])
        exact = F.col("share") * F.col("rows")
        rows = rows.withColumn("whole", F.floor(exact)).withColumn("words", (exact - F.col("whole")) * F.col("size"))
        rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), *UNIT), F.col("blocks")))
        settled, left = _rounded(rows.select(*UNIT, "rows", "whole", "words", "block"), seed)
        state = written(_shared(state.withColumn("rest", F.col("rest") - F.col(f"{i}_words")), left, most, seed, i + 1 == len(LEAST_WORDS)), "mix-sources")
        last = state.where("left_size is not null").select(*(F.col(f"left_{c}").alias(c) for c in [*UNIT, "rows", "copies"]))
        state = state.select(*columns)
        settled = settled.unionByName(last)
        out = settled if out is None else out.unionByName(settled)
    return joined_small(out, state.select("source", "source_size", "target"), ["source"])


def report(taken: DataFrame) -> DataFrame:
    """One row for each row of the documents: doc_id, size, source_size, target and taken (words, repeats counted)."""
    rows = taken.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    own = F.floor(F.col("copies") / F.col("rows")) + (F.col("row") < F.col("copies") % F.col("rows")).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", (own * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """docs, each row as often as the mix takes it, with all its columns.

    Of rows equal in source, id and text, one stands for all.
    """
    taken = copies(docs, weights, most, seed).where("copies > 0").select(*UNIT, "copies").alias("t")
    size = F.coalesce(F.regexp_count(F.col("row.text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.struct("*").alias("row"))
    rows = rows.select("row", F.col("row.source").cast("string").alias("source"), F.col("row.doc_id").alias("doc_id"), size.alias("size"), F.xxhash64(F.col("row.text").cast("string")).alias("hash"))
    rows = rows.groupBy(*UNIT).agg(F.first("row").alias("row")).alias("d")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"t.{c}")) for c in UNIT]
    met = rows.join(taken, same).select("d.row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("t.copies"))))
    return met.select("row.*")
