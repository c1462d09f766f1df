"""Helpers that every training-data operator uses."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    The cluster names that folder in spark.checkpoint.dir, or the program by
    setCheckpointDir. Where neither is set, as in tests, a local master uses a
    folder of this machine; others have none that all executors see.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="chalkline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a small side that may be broadcast, and the parts of the large side beyond that.
BROADCAST_ROWS, SPREAD = 20_000, 64


def joined_small(rows: DataFrame, params: DataFrame, keys: list[str], most: int = BROADCAST_ROWS) -> DataFrame:
    """rows with the columns of params, which has one row for each value of keys (nulls are values).

    params is counted: up to `most` rows are broadcast; of more, a hot key meets
    its row in SPREAD parts. Rows without params go.
    """
    kept = [c for c in params.columns if c not in keys]
    few = params.count() <= most
    if few:
        a, b = rows.alias("a"), F.broadcast(params.alias("b"))
        same = F.lit(True)
    else:
        a = rows.withColumn("__part", F.pmod(F.xxhash64(*rows.columns), F.lit(SPREAD)).cast("int")).alias("a")
        b = params.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))).alias("b")
        same = F.col("a.__part") == F.col("b.__part")
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, same).select(*(F.col(f"a.{c}") for c in rows.columns), *(F.col(f"b.{c}") for c in kept))


def text_bytes(name: str = "text") -> Column:
    """The whole text as bytes; null is empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def fold_of(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def lower_ascii(value: Column) -> Column:
    return F.translate(value, UPPER, LOWER)


def bounded_labels(labels: DataFrame, column: str, limit: int) -> DataFrame:
    """At most `limit` labelled ids outside fold 0, one row each, chosen by a hash of the id.

    Conflicting labels of one id become the smaller one. The result has at most
    `limit` rows of two numbers, so it may be broadcast.
    """
    own = labels.select(F.col("doc_id").alias("doc_id"), F.col(column).cast("int").alias("label"))
    own = own.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (fold_of() != 0))
    return own.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
