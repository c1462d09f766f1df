"""Centroid clustering of integer vectors with Hamerly's bounds.

Vectors lie in blocks, in a table bucketed by block. Beside them is a table of
the same buckets with one cluster, one upper bound of the distance to its
centroid and one lower bound of that to any other, for each vector; a round
joins both without a shuffle and writes the second anew. Between rounds the
bounds are loosened by the way that centroids went. A vector whose upper bound
is below its lower bound (or below half the way to the next centroid) stays;
others get their true distance, and if that does not settle it, an exact integer
scan of all centroids. Bounds are rounded away from each other, so none decides
what integers would not.
"""

from __future__ import annotations

import contextlib
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import shared_folder, written

CLUSTERS, ROUNDS, DIMENSIONS, SCALE = 8, 10, 64, 1024
#: Vectors of a block, about so many of a bucket, and most buckets.
BLOCK, BUCKET, MOST_BUCKETS = 512, 1 << 18, 50_000
#: Components whose squared distances are exact as doubles in 64 dimensions, and as 64-bit integers.
EXACT_FLOAT, EXACT_INT = 1 << 22, 1 << 27
BLOCKS = "block long, ids array<{id}>, vectors binary"
STATE = "block long, clusters binary, upper binary, lower binary, sums binary, scanned long"


def quantised(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of doubles; exact, since SCALE is a power of two."""
    out = np.floor(vectors * SCALE)
    if len(out) and np.abs(out).max() >= EXACT_INT:
        raise ArithmeticError("a component is too large for distances of 64 bits")
    return out.astype(np.int64)


def packed(x: np.ndarray) -> bytes:
    """The rows of a block; four bytes a component, or two where they do."""
    small = not len(x) or np.abs(x).max() < 1 << 15
    return (b"\2" if small else b"\4") + x.astype("<i2" if small else "<i4").tobytes()


def unpacked(data, dimensions: int) -> np.ndarray:
    kind = "<i2" if bytes(data[:1]) == b"\2" else "<i4"
    return np.frombuffer(data, kind, offset=1).reshape(-1, dimensions).astype(np.int64)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, a row for each vector and a column for each centroid."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT_FLOAT:
        x, c = x.astype(np.float64), centroids.astype(np.float64)  # every sum is an integer below 2^53
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], axis=1)


def above(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.asarray(x, np.float64).astype(np.float32), np.float32(np.inf))


def below(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.asarray(x, np.float64).astype(np.float32), np.float32(-np.inf)), np.float32(0))


class Round:
    """What a round needs to know: the centroids, and how far each went (rounded up)."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        self.centroids = centroids
        self.went = np.zeros(len(centroids)) if before is None else above(np.sqrt(((centroids - before).astype(np.float64) ** 2).sum(1)))
        #: The way of the farthest other centroid, for each.
        self.others = np.array([max(np.delete(self.went, i), default=0.0) for i in range(len(centroids))])
        apart = distances(centroids, centroids).astype(np.float64) if len(centroids) else np.zeros((0, 0))
        np.fill_diagonal(apart, np.inf)
        #: Half the way to the next centroid: a vector nearer than that has no other as near.
        self.half = below(np.sqrt(apart.min(1)) / 2) if len(centroids) else np.zeros(0, np.float32)

    def scan(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cluster, upper, lower) by all distances; of equal ones, the smaller number."""
        d = distances(x, self.centroids)
        cluster = d.argmin(1)
        nearest = d[np.arange(len(x)), cluster]
        d[np.arange(len(x)), cluster] = np.iinfo(np.int64).max
        second = np.full(len(x), np.inf) if d.shape[1] == 1 else np.sqrt(d.min(1).astype(np.float64))
        return cluster, above(np.sqrt(nearest.astype(np.float64))), below(second)

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The same after this round, and how many vectors were scanned."""
        cluster, upper, lower = cluster.copy(), above(upper.astype(np.float64) + self.went[cluster]), below(lower.astype(np.float64) - self.others[cluster])
        open_ = np.flatnonzero(upper >= np.maximum(lower, self.half[cluster]))
        if len(open_):
            own = cluster[open_]
            upper[open_] = above(np.sqrt(((x[open_] - self.centroids[own]) ** 2).sum(1).astype(np.float64)))
            open_ = open_[upper[open_] >= np.maximum(lower[open_], self.half[own])]
        if len(open_):
            cluster[open_], upper[open_], lower[open_] = self.scan(x[open_])
        return cluster, upper, lower, len(open_)


def sums_of(x: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """For each cluster, the number of its vectors and their sum."""
    out = np.zeros((k, x.shape[1] + 1), np.int64)
    order = np.argsort(cluster, kind="stable")
    own, starts = np.unique(cluster[order], return_index=True)
    if len(own):
        out[own, 0] = np.diff(np.append(starts, len(order)))
        out[own, 1:] = np.add.reduceat(x[order], starts, axis=0)
    return out


def usable(vectors: DataFrame, vector: str, dimensions: int) -> DataFrame:
    """Rows whose vector has `dimensions` components, none of them null, infinite or no number."""
    x = F.col(vector)
    real = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return vectors.where((F.size(x) == dimensions) & F.forall(x, lambda v: F.coalesce(real(v.cast("double")), F.lit(False))))


def first_centroids(vectors: DataFrame, vec_id: str, vector: str, k: int) -> np.ndarray:
    """The k rows with the smallest SHA-256 of 3:<vec_id>; ties go by vector, null ids last."""
    key = F.sha2(F.concat(F.lit("3:"), F.col(vec_id).cast("string")), 256)
    rows = vectors.select(key.alias("key"), F.col(vector).cast("array<double>").alias("x")).orderBy(F.col("key").asc_nulls_last(), "x").limit(k)
    return quantised(np.array([r.x for r in rows.collect()], np.float64))


class Buckets:
    """Tables bucketed by block, in the shared folder, for the time of a job."""

    def __init__(self, spark, n: int):
        self.spark, self.n, self.names = spark, n, []

    def write(self, df: DataFrame) -> DataFrame:
        name = f"chalkline_{uuid.uuid4().hex}"
        self.names.append(name)
        df.write.option("path", shared_folder(self.spark, "buckets")).bucketBy(self.n, "block").saveAsTable(name)
        return self.spark.table(name)

    def drop(self) -> None:
        for name in self.names:
            with contextlib.suppress(Exception):  # the files are in a folder that is cleared anyway
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _blocks(vectors: DataFrame, id_type) -> DataFrame:
    kind = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                columns = [pa.array([number], pa.int64()), pa.array([part.column(0).to_pylist()], pa.list_(kind)), pa.array([packed(quantised(x))], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "ids", "vectors"])
                number += 1

    return vectors.mapInArrow(run, BLOCKS.format(id=id_type.simpleString()))


def _assigned(blocks: DataFrame, state: DataFrame | None, now: Round, dimensions: int) -> DataFrame:
    k = len(now.centroids)
    kind = np.uint8 if k <= 256 else np.uint32
    first = state is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = unpacked(b.column(1)[i].as_buffer(), dimensions)
                if first:
                    cluster, upper, lower = now.scan(x)
                    scanned = len(x)
                else:
                    held = [np.frombuffer(b.column(j)[i].as_buffer(), t) for j, t in ((2, kind), (3, np.float32), (4, np.float32))]
                    cluster, upper, lower, scanned = now.assign(x, held[0].astype(np.int64), *held[1:])
                values = [b.column(0)[i].as_py(), cluster.astype(kind).tobytes(), upper.astype(np.float32).tobytes(), lower.astype(np.float32).tobytes(), sums_of(x, cluster, k).tobytes(), scanned]
                kinds = [pa.int64(), *[pa.binary()] * 4, pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=["block", "clusters", "upper", "lower", "sums", "scanned"])

    rows = blocks.select("block", "vectors")
    if not first:
        rows = rows.join(state.select("block", "clusters", "upper", "lower").hint("shuffle_hash"), "block")
    return rows.mapInArrow(run, STATE)


def _moved(state: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """The componentwise floor of each cluster's mean (an empty cluster's centroid stays), and how many vectors were scanned."""
    k, d = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, scanned = np.zeros(k * (d + 1) + 1, np.int64), 0
        for b in batches:
            for x in b.column(0):
                total[:-1] += np.frombuffer(x.as_buffer(), np.int64)
            total[-1] += int(np.sum(b.column(1).to_numpy()))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], names=["sums"])

    parts = state.select("sums", "scanned").mapInArrow(run, "sums array<bigint>")
    rows = parts.select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    total = {r.at: int(r.x) for r in rows}
    out = centroids.copy()
    for c in range(k):
        n = total.get(c * (d + 1), 0)
        if n:
            out[c] = [total[c * (d + 1) + 1 + i] // n for i in range(d)]
    return out, total.get(k * (d + 1), 0)


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, vec_id: str = "vec_id", vector: str = "embedding", scanned: list | None = None) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every usable vector.

    Vectors of another length, or with a component that is null, infinite or no
    number, have no row. Repeated rows and ids count each; null ids are kept. Of
    fewer vectors than k, each is a centroid; an empty table gives none. Ties go
    to the smaller number. Other columns are not read. Only k centroids and
    their sums come to the driver. `scanned` is given the number of vectors that
    each round scanned in full. A component of 2^17 or more in size, whose
    distances 64 bits might not hold, is an error.
    """
    spark, id_field = vectors.sparkSession, vectors.schema[vec_id]
    rows = usable(vectors, vector, dimensions).select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    out_schema = f"vec_id {id_field.dataType.simpleString()}, cluster int, distance long"
    centroids = first_centroids(rows, "vec_id", "x", k)
    if not len(centroids):
        empty = spark.createDataFrame([], out_schema)
        return empty.select("*", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    n = vectors.count()
    buckets = Buckets(spark, max(1, min(MOST_BUCKETS, max(-(-n // BUCKET), min(-(-n // BLOCK), spark.sparkContext.defaultParallelism)))))
    try:
        blocks = buckets.write(_blocks(rows, id_field.dataType).repartition(buckets.n, "block"))
        state, now = None, Round(centroids)
        for _ in range(rounds):
            state = buckets.write(_assigned(blocks, state, now, dimensions))
            moved, n_scanned = _moved(state, now.centroids)
            if scanned is not None:
                scanned.append(n_scanned)
            now = Round(moved, now.centroids)
        state = buckets.write(_assigned(blocks, state, now, dimensions))
        found = written(_distances(blocks, state, now.centroids, out_schema, id_field.dataType), "clusters")
    finally:
        buckets.drop()
    of = {r.cluster: int(r.inertia) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
    own = F.array(*(F.lit(of.get(i, 0)).cast("long") for i in range(len(centroids))))
    names = F.array(*(F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in now.centroids.tolist()))
    return found.select("*", own[F.col("cluster")].alias("cluster_inertia"), F.lit(sum(of.values())).cast("long").alias("inertia"), names[F.col("cluster")].alias("centroid_sha256"))


def _distances(blocks: DataFrame, state: DataFrame, centroids: np.ndarray, schema: str, id_type) -> DataFrame:
    kind = np.uint8 if len(centroids) <= 256 else np.uint32
    arrow_kind = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = unpacked(b.column(1)[i].as_buffer(), centroids.shape[1])
                own = np.frombuffer(b.column(2)[i].as_buffer(), kind)
                d = ((x - centroids[own]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(b.column(0)[i].as_py(), arrow_kind), pa.array(own.astype(np.int32)), pa.array(d)], names=["vec_id", "cluster", "distance"])

    rows = blocks.join(state.select("block", "clusters").hint("shuffle_hash"), "block")
    return rows.select("ids", "vectors", "clusters").mapInArrow(run, schema)


def _sql() -> str:
    """The same as a chain of rounds, each a cross product of the vectors with the centroids."""
    nearest = "SELECT v.row, v.vec_id, v.x, c.cluster, list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(v.x, c.x)]) AS d FROM v, {c} c"
    pick = "SELECT row, any_value(vec_id) AS vec_id, any_value(x) AS x, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM ({}) GROUP BY row"
    steps = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, [floor({SCALE} * y::DOUBLE)::BIGINT for y in embedding] AS x
  FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND list_bool_and([y IS NOT NULL AND isfinite(y::DOUBLE) for y in embedding]))""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR), x) - 1 AS cluster, x FROM v
  QUALIFY cluster < {CLUSTERS})""",
    ]
    for i in range(ROUNDS):
        steps.append(f"a{i} AS MATERIALIZED ({pick.format(nearest.format(c=f'c{i}'))})")
        means = "SELECT cluster, list(m ORDER BY pos) AS x FROM (SELECT cluster, pos, (s // n) - CASE WHEN s % n < 0 THEN 1 ELSE 0 END AS m FROM (SELECT cluster, pos, sum(y)::HUGEINT AS s, count(*) AS n FROM (SELECT cluster, unnest(x) AS y, generate_subscripts(x, 1) AS pos FROM a{i}) GROUP BY cluster, pos)) GROUP BY cluster"
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.x::BIGINT[], c.x) AS x FROM c{i} c LEFT JOIN ({means.format(i=i)}) m USING (cluster))")
    steps.append(f"a AS MATERIALIZED ({pick.format(nearest.format(c=f'c{ROUNDS}'))})")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, cluster::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a JOIN c{ROUNDS} c USING (cluster)"""


SQL = _sql()
