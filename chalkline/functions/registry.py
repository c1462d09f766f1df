"""The library's own functions under names that SQL can use."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import formulas, messages, questions


def _each(values: pa.Array, f: Callable, kind: pa.DataType) -> pa.Array:
    """f of each value, equal values of a batch once; null for a null."""
    distinct = values.dictionary_encode()
    return pa.array([f(x) for x in distinct.dictionary.to_pylist()], kind).take(distinct.indices)


@F.arrow_udf(T.DoubleType())
def molar_mass(formula: pa.Array) -> pa.Array:
    """The mass of one mole of a formula as text; null if it cannot be read."""
    return _each(formula, questions._mass, pa.float64())


@F.arrow_udf(T.ArrayType(T.StringType()))
def extract_valid_formulas(question: pa.Array) -> pa.Array:
    """The formulas in a normalised question."""
    return _each(question, questions.find_formulas, pa.list_(pa.string()))


@F.arrow_udf(T.StringType())
def extract_equation(question: pa.Array) -> pa.Array:
    """The equation in a normalised question; null without one."""
    return _each(question, questions.find_equation, pa.string())


@F.arrow_udf(T.StringType())
def fmt_num(x: pa.Array) -> pa.Array:
    """A number as text with three places, scientific if it is large or small."""
    return _each(x.cast(pa.float64()), messages.number_text, pa.string())


FUNCTIONS = {
    "formula_counts": formulas.formula_counts, "parse_formula": formulas.formula_counts, "formulas_counts": formulas.formulas_counts, "equation_sides": formulas.equation_sides, "parse_equation": formulas.equation_sides,
    "canonical_formula": formulas.canonical_formula, "molar_mass": molar_mass, "extract_valid_formulas": extract_valid_formulas, "extract_equation": extract_equation, "fmt_num": fmt_num,
}

CHUNK = [("idx", T.IntegerType()), *((c, T.StringType()) for c in ("heading_h1", "heading_h2", "heading_h3", "content"))]


class ChunkMarkdown:
    """chunk_markdown(TABLE(files) [PARTITION BY source_file ORDER BY ...], min_chars): chunks of the column text.

    The result has all other columns of the table, whatever they are, and the
    chunk. Chunks are numbered from 0 in a source_file; its parts, in the
    partition's order, are numbered on. A null text has none.
    """

    @staticmethod
    def analyze(files: AnalyzeArgument, min_chars: AnalyzeArgument = AnalyzeArgument(T.IntegerType(), None, False, True)) -> AnalyzeResult:  # noqa: B008
        if not files.isTable:
            raise ValueError("chunk_markdown takes a table: chunk_markdown(TABLE(files))")
        columns = {f.name: f.dataType for f in files.dataType.fields}
        if not isinstance(columns.get("text"), T.StringType) or "source_file" not in columns:
            raise ValueError("the table needs the columns source_file and text (a string)")
        clash = sorted(set(columns) & {c for c, _ in CHUNK})
        if clash:
            raise ValueError(f"columns of a chunk that the table has already: {', '.join(clash)}")
        own = [T.StructField(c, k) for c, k in CHUNK]
        return AnalyzeResult(T.StructType([*(f for f in files.dataType.fields if f.name != "text"), *own]))

    def __init__(self):
        self.source, self.number = object(), 0

    def eval(self, row: Row, min_chars: int = 150) -> Iterator[tuple]:
        from ..operators.documents import LEAST_CHARS, chunks_of

        if row["source_file"] != self.source:
            self.source, self.number = row["source_file"], 0
        others = [row[c] for c in row.__fields__ if c != "text"]
        for chunk in chunks_of((row["text"] or "").replace("\r\n", "\n").replace("\r", "\n"), min_chars):
            if len(chunk[3]) >= LEAST_CHARS:
                yield (*others, self.number, *chunk)
                self.number += 1


TABLE_FUNCTIONS = {"split_message": messages.split_message, "chunk_markdown": udtf(ChunkMarkdown)}


def register(spark: SparkSession, embedder: Callable[[Column], Column] | None = None) -> None:
    """Scalar functions, and the table functions split_message(text, most) and chunk_markdown(TABLE(files), min_chars).

    embedder: a function of an Arrow UDF kind, registered as embed(text).
    Everything else is built in and needs no name.
    """
    for name, f in FUNCTIONS.items():
        spark.udf.register(name, f)
    if embedder is not None:
        spark.udf.register("embed", embedder)
    for name, f in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, f)
