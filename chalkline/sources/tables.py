"""Indexes, caches, stores and logs as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import KeyedStore


def write_index(chunks: DataFrame, path: str, index: str = "index_name") -> None:
    """Replace the index table; a rebuild gives the same table and repeats no vector."""
    chunks.write.mode("overwrite").partitionBy(index).parquet(path)


def read_index(spark: SparkSession, path: str, names: list[str] | None = None, index: str = "index_name") -> DataFrame:
    """The table, or only the partitions of some indexes. Names that do not exist have no rows."""
    table = spark.read.parquet(path)
    return table.where(F.col(index).isin(names)) if names is not None else table


#: Bytes of a table that is small enough to be spread.
SMALL_TABLE = 256 << 20


def read_spread(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table for heavy work on each row: a small one, of which a file may be a single row group, is dealt out to all cores; a larger one is read as it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
    table = spark.read.parquet(path)
    return table.repartition(spark.sparkContext.defaultParallelism) if size <= SMALL_TABLE else table


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of records, one row each."""
    return spark.read.option("multiLine", True).json(path)


def append_new(rows: DataFrame, path: str, key: str) -> DataFrame:
    """Append to a keyed table those rows whose key it lacks; returns the table."""
    spark = rows.sparkSession
    try:
        known = spark.read.parquet(path).select(key)
        rows = rows.join(known, key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows.dropDuplicates([key]).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def upsert_batches(path: str, key: str, at: str, name: str = "stream", **options):
    """A foreachBatch function that keeps the latest row of each key in a KeyedStore; a repeated batch changes nothing."""

    def run(batch: DataFrame, number: int) -> None:
        KeyedStore(batch.sparkSession, path, key, at, **options).batches(name)(batch, number)

    return run


#: Fields of a log record that are its own; everything else is an extra.
LOG_FIELDS = ("ts", "level", "logger", "msg")


def log_lines(events: DataFrame, reserved: tuple[str, ...] = ()) -> DataFrame:
    """One JSON line for each event: the log's own fields, then all extras but the reserved ones; nulls are left out."""
    names = [c for c in LOG_FIELDS if c in events.columns]
    names += [c for c in events.columns if c not in names and c not in reserved]
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    fields = [stamp.alias(c) if c == "ts" else F.col(c) for c in names]
    return events.select(F.to_json(F.struct(*fields)).alias("value"))


def write_log(events: DataFrame, path: str) -> None:
    log_lines(events).write.mode("append").text(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All fields that any line has."""
    return spark.read.json(path)


def latency_by_event(log: DataFrame, event: str = "event", millis: str = "elapsed_ms") -> DataFrame:
    return log.groupBy(event).agg(F.count("*").alias("n"), F.avg(millis).alias("mean_ms"), F.max(millis).alias("max_ms"))


def by_level(log: DataFrame, level: Column | str = "level") -> DataFrame:
    return log.groupBy(level).agg(F.count("*").alias("n"))
