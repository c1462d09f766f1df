"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir, or the program by setCheckpointDir.

    Where neither is set, a local master uses a folder of this machine; other
    masters have none that all executors see.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="chalkline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read from there: computed once, and not again when an executor is lost."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_distinct(rows: DataFrame, keys: list[str], of: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """rows with the columns that of() adds to a table of their distinct keys, nulls among them.

    For heavy work on values that many rows repeat: each is worked on once. The
    result is staged, so its size is known beforehand: a small one is broadcast
    and rows stay where they are, a large one is joined by a shuffle.
    """
    # few bytes, but much work for each: they are spread anew, or adaptive execution would put them into one task
    each = rows.select(*keys).distinct().repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    known = {k: f"__key_{i}" for i, k in enumerate(keys)}
    own = staged(of(each).withColumnsRenamed(known), name)
    same = reduce(Column.__and__, (rows[k].eqNullSafe(own[c]) for k, c in known.items()))
    return rows.join(own, same, "left").drop(*known.values())
