"""Exact inner-product search over a partitioned vector table, and what follows it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vectors of a block of queries and of a block of the index.
QUERY_BLOCK, INDEX_BLOCK = 512, 4096
#: Queries and index rows that meet in one task, and queries that are few enough to be broadcast.
QUERY_TILE, INDEX_TILE, FEW_QUERIES = 8192, 1 << 17, 4096
#: Scores that inner_products holds at once.
BLOCK_PAIRS = 1 << 18


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles; null if the lengths differ or an element is null."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def l2_normalise(vector: Column) -> Column:
    """A vector of length one; a zero vector stays as it is."""
    norm = F.sqrt(dot(vector, vector))
    return F.transform(vector, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))


def blocks(rows: DataFrame, vector: str, size: int) -> DataFrame:
    """Rows with a vector in blocks: block (a number), dims, rows (an array of the other columns) and vectors (doubles, one after the other).

    A block has `size` rows at most, all with vectors of one length. Rows
    without a vector, or with one that has nulls, are in none.
    """
    kept = [c for c in rows.columns if c != vector]
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("dims", T.IntegerType()), T.StructField("rows", T.ArrayType(T.StructType([rows.schema[c] for c in kept]))), T.StructField("vectors", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for b in batches:
            lists = b.column(vector)
            lengths = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
            for dims in np.unique(lengths[lengths > 0]).tolist():
                own = np.flatnonzero(lengths == dims)
                x = lists.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), dims)
                real = ~np.isnan(x).any(1)
                own, x = own[real], x[real]
                for at in range(0, len(own), size):
                    columns = b.select(kept).take(pa.array(own[at : at + size])).columns
                    part = pa.StructArray.from_arrays(columns, names=kept)
                    row = [pa.array([number], pa.int64()), pa.array([dims], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), pa.array([x[at : at + size].tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(row, names=["block", "dims", "rows", "vectors"])
                    number += 1

    return rows.mapInArrow(run, schema)


def tiles(queries: DataFrame, index: DataFrame, *, vector: str, query_block: int = QUERY_BLOCK, few: int = FEW_QUERIES) -> DataFrame:
    """Every block of queries beside every block of index: q_rows, q_vectors, i_rows, i_vectors and dims.

    Up to `few` queries are broadcast, and the index stays where it is. More of
    them are dealt out in tiles: a group of query blocks and a group of index
    blocks meet in one task, so a query block is sent once for each group of the
    index and an index block once for each QUERY_TILE queries.
    """
    q = blocks(queries, vector, query_block).select("dims", F.col("block").alias("q_block"), F.col("rows").alias("q_rows"), F.col("vectors").alias("q_vectors"))
    i = blocks(index, vector, INDEX_BLOCK).select("dims", F.col("block").alias("i_block"), F.col("rows").alias("i_rows"), F.col("vectors").alias("i_vectors"))
    n = queries.count()
    if n <= few:
        return i.join(F.broadcast(q), "dims").drop("q_block", "i_block")
    across, down = -(-n // QUERY_TILE), max(1, -(-index.count() // INDEX_TILE))
    q = q.withColumn("across", F.pmod(F.xxhash64("q_block"), F.lit(across))).withColumn("down", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))))
    i = i.withColumn("down", F.pmod(F.xxhash64("i_block"), F.lit(down))).withColumn("across", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))))
    return i.join(q, ["dims", "across", "down"]).drop("q_block", "i_block", "across", "down")


def _pairs(b: pa.RecordBatch) -> Iterator[tuple[pa.StructArray, pa.StructArray, np.ndarray]]:
    """The query rows, index rows and scores of each pair of blocks in a batch."""
    for row in range(b.num_rows):
        dims = b.column("dims")[row].as_py()
        x, y = (np.frombuffer(b.column(c)[row].as_buffer(), np.float64).reshape(-1, dims) for c in ("q_vectors", "i_vectors"))
        yield b.column("q_rows")[row].values, b.column("i_rows")[row].values, x @ y.T


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest scores of each row; of equal ones, the leftmost."""
    if scores.shape[1] > k:
        least = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        row, column = np.nonzero(scores >= least[:, None])
    else:
        row, column = (x.ravel() for x in np.indices(scores.shape))
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    first = np.searchsorted(row, np.arange(scores.shape[0]))
    near = np.arange(len(row)) - first[row] < k
    return row[near], column[near]


def top_k(
    queries: DataFrame, index: DataFrame, k: int, *, by: Sequence[str] = (), query_id: str = "query_id", vector: str = "embedding", position: str = "pos", threshold: float | None = None, few: int = FEW_QUERIES
) -> DataFrame:
    """For each query, the k best rows of index in each group of `by` columns.

    Adds query_id, score and rank_in_group to the columns of index (without the
    vector). Queries may be as many as the index has rows; they meet it in tiles
    of blocks. A task keeps the best k of each pair of blocks, Spark the best k
    of each of its partitions before it sends them, and the rest once more.
    Only vector, position and `by` of the index go through this; the other
    columns of the hits are read afterwards. Ties go by position (null first). A
    row scores at least `threshold` (inclusive). Index rows without a vector, or
    of another length, are never found, and queries without one find nothing.
    """
    by, kept = list(by), [c for c in index.columns if c != vector]
    same = [*by, position]
    asked = queries.select(F.col(query_id).alias("__query"), F.col(vector).alias("__vector"))
    lean = index.select(*(F.col(c).alias(f"__{i}") for i, c in enumerate(same)), F.xxhash64(vector).alias("__hash"), F.col(vector).alias("__vector"))
    fields = [T.StructField("__query", asked.schema["__query"].dataType), *(T.StructField(f.name, f.dataType) for f in lean.schema if f.name != "__vector"), T.StructField("score", T.DoubleType())]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for asked, found, scores in _pairs(b):
                place = pc.sort_indices(found.field(len(same) - 1), null_placement="at_start").to_numpy()
                if by:
                    groups: dict[tuple, list[int]] = {}
                    for i, g in zip(place.tolist(), zip(*(found.field(j).take(pa.array(place)).to_pylist() for j in range(len(by))), strict=True), strict=True):
                        groups.setdefault(g, []).append(i)
                    parts = [np.array(x) for x in groups.values()]
                else:
                    parts = [place]
                for own in parts:
                    s = scores[:, own]
                    row, column = best(s, k)
                    value = s[row, column]
                    if threshold is not None:
                        row, column, value = (x[value >= threshold] for x in (row, column, value))
                    hits = found.take(pa.array(own[column]))
                    yield pa.RecordBatch.from_arrays([asked.field(0).take(pa.array(row)), *hits.flatten(), pa.array(value)], names=names)

    near = tiles(asked, lean, vector="__vector", few=few).mapInArrow(run, T.StructType(fields))
    order = W.partitionBy("__query", *(f"__{i}" for i in range(len(by)))).orderBy(F.desc("score"), f"__{len(by)}")
    near = near.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= k)
    # rows that are equal in all of this are told apart by their other columns
    key = F.struct(*(f"__{i}" for i in range(len(same))), "__hash").alias("__key")
    hits = near.groupBy("__query", key).agg(F.first("score").alias("__score"), F.min("__rank").alias("__rank"), F.count("*").alias("__n"))
    # one struct through a generator: as plain columns, their aliases would swell the optimizer's constraints
    key = F.struct(*(F.col(c).alias(f"__{i}") for i, c in enumerate(same)), F.xxhash64(vector).alias("__hash")).alias("key")
    full = index.select(F.explode(F.array(F.struct(key, F.struct(*kept).alias("row"), F.xxhash64(*kept).alias("content")))).alias("f"))
    out = hits.join(full, F.col("__key") == F.col("f.key")).select("__query", "__score", "__rank", "__n", F.col("f.row").alias("__row"), F.col("f.content").alias("__content"))
    place = F.row_number().over(W.partitionBy("__query", *(F.col("__row")[c] for c in by), "__rank").orderBy("__content"))
    out = out.withColumn("__place", place).where(F.col("__place") <= F.col("__n"))
    return out.select(F.col("__query").alias(query_id), *(F.col("__row")[c].alias(c) for c in kept), F.col("__score").alias("score"), (F.col("__rank") + F.col("__place") - 1).cast("int").alias("rank_in_group"))


def merge_hits(hits: DataFrame, k: int, *, query_id: str = "query_id", index_order: str = "index_ord", position: str = "pos", chunk_id: str = "chunk_id") -> DataFrame:
    """Hits of several indexes as one ranking: best first, each chunk once, cut to k, with rank 1..n.

    Ties go by index order, then position. Hits without a chunk id count as one chunk.
    """
    order = [F.desc("score"), F.col(index_order), F.col(position)]
    once = W.partitionBy(query_id, F.coalesce(F.col(chunk_id).cast("string"), F.lit(""))).orderBy(*order)
    best = hits.withColumn("__n", F.row_number().over(once)).where("__n = 1").drop("__n")
    return best.withColumn("rank", F.row_number().over(W.partitionBy(query_id).orderBy(*order))).where(F.col("rank") <= k)


def sufficient(hits: DataFrame, *, query_id: str = "query_id", min_score: float = 0.45, min_results: int = 1) -> DataFrame:
    """Per query: whether it has min_results hits and one of min_score or more."""
    enough = (F.count("*") >= min_results) & F.coalesce(F.max("score") >= min_score, F.lit(False))
    return hits.groupBy(query_id).agg(F.count("*").alias("n_hits"), enough.alias("sufficient"))


def inner_products(queries: DataFrame, index: DataFrame, *, query_id: str = "query_id", vector: str = "embedding", few: int = FEW_QUERIES) -> DataFrame:
    """Every query with every row of index: query_id, the columns of index without the vector, and score.

    Both meet in tiles of blocks. Rows without a vector, or of another length,
    have no score.
    """
    kept = [c for c in index.columns if c != vector]
    asked = queries.select(F.col(query_id).alias("__query"), F.col(vector).alias("__vector"))
    given = index.select(*(F.col(c).alias(f"__{i}") for i, c in enumerate(kept)), F.col(vector).alias("__vector"))
    schema = T.StructType([T.StructField(query_id, asked.schema["__query"].dataType), *(T.StructField(c, index.schema[c].dataType) for c in kept), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for asked, found, scores in _pairs(b):
                step = max(1, BLOCK_PAIRS // max(1, scores.shape[1]))
                for at in range(0, len(scores), step):
                    part = scores[at : at + step]
                    row, column = (pa.array(x.ravel()) for x in np.indices(part.shape))
                    yield pa.RecordBatch.from_arrays([asked.field(0).slice(at, len(part)).take(row), *found.take(column).flatten(), pa.array(part.ravel())], names=[query_id, *kept, "score"])

    return tiles(asked, given, vector="__vector", few=few).mapInArrow(run, schema)


def pairwise(vectors: DataFrame, index: DataFrame | None = None, *, key: str = "vec_id", vector: str = "embedding", few: int = FEW_QUERIES) -> DataFrame:
    """Inner products (a, b, score) of a stated set of vectors with all of index, or among themselves; a pair of two of the set comes once, the lesser key first."""
    index = vectors if index is None else index
    left = vectors.select(F.col(key).alias("query_id"), vector)
    stated = vectors.select(F.col(key).alias("pos")).distinct().withColumn("__stated", F.lit(True))
    right = index.select(F.col(key).alias("pos"), vector).join(stated, "pos", "left")
    pairs = inner_products(left, right, vector=vector, few=few).where("query_id < pos OR (query_id > pos AND __stated IS NULL)")
    return pairs.select(F.col("query_id").alias("a"), F.col("pos").alias("b"), "score")


def index_counts(index: DataFrame, by: str = "index_name") -> DataFrame:
    """Rows of each index, and in the row without a name of all."""
    return index.rollup(by).agg(F.count("*").alias("n"))
