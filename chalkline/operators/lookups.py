"""Lookups by containment, where the first entry of an ordered table that fits wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions.text import let


def first_contained(text: Column, entries: Sequence[tuple[str, Column]], otherwise: Column | None = None) -> Column:
    """The value of the first entry whose key text contains. The table is small and fixed, so no join is needed."""
    out = otherwise if otherwise is not None else F.lit(None)
    for key, value in reversed(list(entries)):
        out = F.when(F.contains(text, F.lit(key)), value).otherwise(out)
    return out


def file_topic(source_file: Column) -> Column:
    """struct(chapter, tingkatan, topic) of a file name: by the table, else by BAB_<n>, else nulls."""
    name = F.upper(F.regexp_replace(F.regexp_extract(source_file, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", ""))

    def info(chapter: Column, form: Column, topic: Column) -> Column:
        return F.struct(chapter.cast("int").alias("chapter"), form.cast("int").alias("tingkatan"), topic.alias("topic"))

    def of(stem: Column) -> Column:
        number = F.regexp_extract(stem, r"BAB_?([0-9]+)", 1).try_cast("int")
        fallback = F.when(number.isNotNull(), info(number, F.when(number <= 5, 4).otherwise(5), F.lit(""))).otherwise(info(F.lit(None), F.lit(None), F.lit("")))
        return first_contained(stem, [(k, info(F.lit(c), F.lit(t), F.lit(topic))) for k, c, t, topic in L.FILE_TOPICS], fallback)

    return let(name, of)


def english_keywords(keywords: Column) -> Column:
    """English terms of Malay keywords: for each, its own entry, then those of all keys in it, each once."""
    known = F.create_map(*(F.lit(x) for pair in L.SYNONYMS.items() for x in pair))
    pairs = F.map_entries(known)

    def of(k: Column) -> Column:
        word = F.lower(F.trim(k))
        own = F.filter(F.array(F.try_element_at(known, word)), lambda x: x.isNotNull())
        return F.concat(own, F.transform(F.filter(pairs, lambda p: F.contains(word, p["key"])), lambda p: p["value"]))

    return F.array_distinct(F.flatten(F.transform(keywords, of)))


def described(references: DataFrame, library: DataFrame, *, stem: str = "stem", key: str = "key", text: str = "description") -> DataFrame:
    """references with the description of their stem: the exact key, else the first key that contains it or that it contains.

    library (ord, key, description) is a dimension table; its rows meet each
    distinct stem once.
    """
    stems = references.select(stem).distinct()
    exact = F.col(stem) == F.col(key)
    near = exact | F.contains(F.col(stem), F.col(key)) | F.contains(F.col(key), F.col(stem))
    best = stems.join(library, near).groupBy(stem).agg(F.min_by(text, F.struct((~exact).alias("far"), F.col("ord"))).alias(text))
    return references.join(best, stem, "left")
