"""A Bloom filter of keys that a cache has, saved beside it: what it surely lacks needs no join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a key (about 1 % of false positives), hashes of a key, bytes of a segment, and most bytes of a filter that is broadcast.
KEY_BITS, HASHES, SEGMENT, MOST_BYTES = 10, 7, 1 << 16, 64 << 20


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The HASHES bits of each 64-bit hash, one row each, by double hashing; bits is a power of two."""
    h = hashes.astype(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + np.arange(HASHES, dtype=np.uint64) * high[:, None]) & np.uint64(bits - 1)).astype(np.int64)


class Sketch:
    """Segments of a filter as a table (segment, bits); keys are hashed with xxhash64."""

    def __init__(self, segments: DataFrame, bits: int):
        self.segments, self.bits = segments, bits

    @staticmethod
    def of(keys: DataFrame, key: str, most_bytes: int = MOST_BYTES) -> Sketch | None:
        """The filter of a column (nulls aside); None if it would be too large to broadcast. Tasks fill segments, which are then joined by OR."""
        n = keys.count()
        bits = max(SEGMENT * 8, 1 << max(0, n * KEY_BITS - 1).bit_length())
        if bits // 8 > most_bytes:
            return None

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own: dict[int, np.ndarray] = {}
            for b in batches:
                at = np.unique(places(b.column(0).to_numpy().view(np.uint64), bits))
                for s in np.unique(at // (SEGMENT * 8)).tolist():
                    mine = at[at // (SEGMENT * 8) == s] % (SEGMENT * 8)
                    np.bitwise_or.at(own.setdefault(s, np.zeros(SEGMENT, np.uint8)), mine // 8, (1 << (mine % 8)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array([x.tobytes() for x in own.values()], pa.binary())], names=["segment", "bits"])

        def merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, segment = np.zeros(SEGMENT, np.uint8), 0
            for b in parts:
                for s, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    segment = s
                    total |= np.frombuffer(x.as_buffer(), np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["segment", "bits"])

        hashed = keys.where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("h"))
        return Sketch(hashed.mapInArrow(fill, "segment long, bits binary").groupBy("segment").applyInArrow(merge, "segment long, bits binary"), bits)

    def save(self, path: str) -> None:
        self.segments.withColumn("of", F.lit(self.bits)).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Sketch | None:
        """The saved filter; None for one of no keys."""
        saved = spark.read.parquet(path)
        first = saved.select("of").first()
        return Sketch(saved.select("segment", "bits"), first[0]) if first else None

    def might_have(self, key: Column) -> Column:
        """False where the keys surely lack this one; null is in none."""
        whole = np.zeros(self.bits // 8, np.uint8)
        for r in self.segments.toLocalIterator():  # at most MOST_BYTES
            whole[r.segment * SEGMENT : (r.segment + 1) * SEGMENT] = np.frombuffer(r.bits, np.uint8)
        held, bits = self.segments.sparkSession.sparkContext.broadcast(whole.tobytes()), self.bits

        @F.arrow_udf("boolean")
        def probe(hashes: pa.Array) -> pa.Array:
            own = np.frombuffer(held.value, np.uint8)
            at = places(hashes.to_numpy(zero_copy_only=False).view(np.uint64), bits)
            return pa.array(((own[at // 8] >> (at % 8).astype(np.uint8)) & 1).all(axis=1))

        return probe(F.xxhash64(key)) & key.isNotNull()


def anti_join(rows: DataFrame, keys: DataFrame, key: str, sketch: Sketch | None) -> DataFrame:
    """Rows whose key is not among keys: those that the sketch rules out as they lie, the others by the join."""
    if sketch is None:
        return rows.join(keys.select(key), key, "left_anti")
    marked = rows.withColumn("__maybe", sketch.might_have(F.col(key)))
    sure = marked.where(~F.col("__maybe")).drop("__maybe")
    return sure.unionByName(marked.where("__maybe").drop("__maybe").join(keys.select(key), key, "left_anti"))
