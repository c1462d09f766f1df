"""Errors of single rows: every row has a status and a reason, and none stops its batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

OK, FAILED = "ok", "failed"
DETAIL_CHARS = 200


def checked(rows: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """rows with status and reason: the first check (name -> condition of a bad row) that applies; a null condition does not."""
    reason = F.coalesce(*(F.when(bad, F.lit(name)) for name, bad in checks.items()), F.lit(None).cast("string"))
    return rows.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), OK).otherwise(FAILED))


def attempted(rows: DataFrame, f: Callable[[dict], dict[str, Any]], schema: str) -> DataFrame:
    """rows with the columns that f gives for each (schema), status, reason and detail.

    f gets a row as a dictionary. Where it raises, or gives what its columns
    cannot hold, they are null, reason is the kind of the exception and detail
    the start of its message. Rows that came with status failed are handed on
    as they are, so steps can follow one another.
    """
    own = T._parse_datatype_string(schema)
    before = [x for x in rows.schema if x.name not in ("status", "reason", "detail")]
    had_status = "status" in rows.columns
    notes = [T.StructField(n, T.StringType()) for n in ("status", "reason", "detail")]
    names, kinds = [x.name for x in own], [to_arrow_type(x.dataType) for x in own]
    out_schema = T.StructType([*before, *own, *notes])
    target = to_arrow_schema(out_schema)

    def one(row: dict) -> tuple:
        if had_status and row["status"] == FAILED:
            return (*[None] * len(names), FAILED, row.get("reason"), row.get("detail"))
        try:
            found = f(row)
            values = [pa.scalar(found.get(n), k).as_py() for n, k in zip(names, kinds, strict=True)]
        except Exception as e:  # the row's error, whatever it is
            return (*[None] * len(names), FAILED, type(e).__name__, str(e)[:DETAIL_CHARS])
        return (*values, OK, None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [one(r) for r in b.to_pylist()]
            columns = [b.column(x.name) for x in before]
            columns += [pa.array([r[i] for r in found], k) for i, k in enumerate([*kinds, *[pa.string()] * 3])]
            yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(columns, target, strict=True)], schema=target)

    return rows.mapInArrow(run, out_schema)


def good(rows: DataFrame) -> DataFrame:
    """Rows without an error, without the notes."""
    return rows.where(F.col("status") == OK).drop("status", "reason", "detail")


def dead_letters(rows: DataFrame) -> DataFrame:
    """Rows with an error, as JSON, so that those of any table go to one place: payload, reason and detail."""
    notes = [c for c in ("status", "reason", "detail") if c in rows.columns]
    detail = F.col("detail") if "detail" in notes else F.lit(None).cast("string")
    return rows.where(F.col("status") == FAILED).select(F.to_json(F.struct(*(c for c in rows.columns if c not in notes))).alias("payload"), "reason", detail.alias("detail"))


def split(rows: DataFrame, dead_path: str, source: str) -> DataFrame:
    """Append the dead letters, with the name of their source, to a table, and return the good rows. rows are computed for each of both."""
    dead_letters(rows).withColumn("source", F.lit(source)).write.mode("append").partitionBy("source").parquet(dead_path)
    return good(rows)


def by_reason(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status", F.col("reason").alias("reason")).agg(F.count("*").alias("n"))


