"""SimHash near-duplicates with pivot distance tables.

Each distinct fingerprint gets a row of Hamming distances to fixed reference
fingerprints (its pivots). Fingerprints that agree in two of four 16-bit blocks
meet; a pair whose distances to some pivot differ by more than RADIUS cannot be
within RADIUS (triangle inequality) and is discarded; survivors are verified.
Where many fingerprints meet, no pairs are made: there every fingerprint is
tabled against the references at distance 0 or 1 from it. Two fingerprints are
within 2 exactly if they share such a reference, so linking each to the
smallest of its reference loses no link and adds none.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import LongType

from .shared import text_bytes, written

RADIUS = 2
WORDS = 3
SEED = 42
N_PIVOTS = 8
#: Fingerprints that may meet in pairs; larger meetings go by near references, exactly.
PAIRED = 32
#: Parts of the rows of one fingerprint.
SALTS = 8
PIVOTS = tuple(xxhash.xxh64_intdigest(b"pivot %d" % i, SEED) for i in range(N_PIVOTS))


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def simhash(text: bytes) -> int:
    """The fingerprint of a text, unsigned."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.append(0, ends[:-1])
    k = min(WORDS, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


@F.arrow_udf(LongType())
def _fingerprint(text: pa.Array) -> pa.Array:
    return pa.array([signed(simhash(x.as_py() or b"")) for x in text], pa.int64())


def fingerprint(text: str = "text") -> Column:
    """The fingerprint of every whole text as a signed long; null and wordless texts have 0."""
    return _fingerprint(text_bytes(text))


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b), a < b, that connect exactly the fingerprints within RADIUS; prints has distinct column fp."""
    blocks = [0xFFFF << (16 * i) for i in range(4)]
    masks = [signed(x | y) for x, y in combinations(blocks, 2)]
    pivots = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(p)))).cast("byte").alias(f"p{i}") for i, p in enumerate(PIVOTS)]
    meets = F.explode(F.array(*(F.struct(F.lit(i).cast("byte").alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(masks))))
    met = prints.select("fp", *pivots).select("*", meets.alias("meet")).select("fp", *(f"p{i}" for i in range(N_PIVOTS)), "meet.*")
    met = met.withColumn("n", F.count("*").over(W.partitionBy("mask", "part"))).where("n > 1")
    met = written(met, "pivot-table")
    few, many = met.where(F.col("n") <= PAIRED), met.where(F.col("n") > PAIRED)

    a, b = few.alias("a"), few.alias("b")
    apart = F.greatest(*(F.abs(F.col(f"a.p{i}") - F.col(f"b.p{i}")) for i in range(N_PIVOTS)))
    pairs = a.join(b, (F.col("a.mask") == F.col("b.mask")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.fp") < F.col("b.fp")))
    pairs = pairs.where(apart <= RADIUS).where(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= RADIUS)
    pairs = pairs.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))

    near = F.explode(F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(64))))
    stars = many.select("fp").distinct().select("fp", near.alias("reference"))
    stars = stars.select(F.min("fp").over(W.partitionBy("reference")).alias("a"), F.col("fp").alias("b")).where("a < b")
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable, for nodes that have an edge (a, b).

    Alternating large and small stars; every round is written to the shared
    folder, and only its row count and checksum come to the driver.
    """

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b"), "links")
    before = state(edges)
    for _ in range(most_rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b")
        edges = written(small.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct(), "stars")
        now = state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))


def _classes(rows: DataFrame, *ids: str) -> DataFrame:
    """(fp, and the smallest of `ids` in the component of fp); rows has fp and ids."""
    own = F.min(F.struct(*ids)) if len(ids) > 1 else F.min(ids[0])
    prints = written(rows.groupBy("fp").agg(own.alias("least")), "fingerprints")
    roots = components(links(prints.select("fp")))
    joined = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    linked = joined.groupBy("root").agg(F.min("least").alias("least"))
    return joined.select("fp", "root").join(linked, "root").select("fp", "least")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, one row for each row of docs.

    Fingerprints link at RADIUS or fewer differing bits; component_id is the
    smallest doc_id reachable, null ids aside (null if there is no other).
    Null and wordless texts have fingerprint zero and link like any other. Other
    columns are not read; an empty table gives none.
    """
    rows = written(docs.select("doc_id", fingerprint().alias("fp")), "fingerprint-rows")
    classes = _classes(rows, "doc_id").withColumnRenamed("least", "component_id")
    # a fingerprint that many rows have meets its class in SALTS parts
    classes = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return rows.join(classes, ["fp", "salt"]).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of linked texts, with all columns of docs.

    It is the row with the smallest doc_id (null ids last), then the smallest
    hash of the text; of rows equal in both, any one. Other columns may have any
    names; an empty table stays empty.
    """
    key = F.xxhash64("text")
    rows = docs.select("doc_id", key.alias("hash"), fingerprint().alias("fp"))
    rows = written(rows.select("fp", F.col("doc_id").isNull().alias("void"), "doc_id", "hash"), "fingerprint-rows")
    winners = _classes(rows, "void", "doc_id", "hash").select("least.doc_id", "least.hash").distinct()
    kept = docs.join(winners, docs["doc_id"].eqNullSafe(winners["doc_id"]) & F.xxhash64(docs["text"]).eqNullSafe(winners["hash"]), "left_semi")
    twins = rows.groupBy("doc_id", "hash").count().where("count > 1").limit(1).count()
    if twins:  # rows that repeat id and text
        kept = kept.select(F.struct("*").alias("row"), key.alias("hash")).groupBy("row.doc_id", "hash").agg(F.first("row").alias("row")).select("row.*")
    return kept
