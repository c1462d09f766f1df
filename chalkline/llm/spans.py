"""Character spans of pattern matches, in built-in functions only.

Spark's regular expression functions return what matched, not where. The place
follows from the lengths of the matches and of the text between them, so one
fold over both gives code point offsets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,ord:int,end:int,kind:string,match:string>>"


def find_spans(text: Column, pattern: str, matches: Column, kind: str, order: int, keep: Callable[[Column], Column]) -> Column:
    """Spans of those of `matches` (all of `pattern` in text, in turn) that `keep` holds for."""
    none = F.expr(f"cast(array() as {SPAN})")

    def step(acc: Column, z: Column) -> Column:
        start = acc["at"] + F.length(z["gap"])
        end = start + F.length(z["match"])
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(kind).alias("kind"), z["match"].alias("match"))
        out = F.when(keep(z["match"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.when(z["match"].isNull(), acc).otherwise(F.struct(end.alias("at"), out.alias("out")))

    zipped = F.arrays_zip(matches.alias("match"), F.split(text, pattern, -1).alias("gap"))
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    return F.when(F.size(matches) > 0, F.aggregate(zipped, start, step, lambda acc: acc["out"])).otherwise(none)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
