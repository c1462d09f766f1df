"""The engine's entry points, as functions of DataFrames: build an index, retrieve, answer."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbers, questions, text
from ..operators import context, documents, memory, validation, vectors
from ..operators.rules import has_severity
from ..sources.staging import staged, with_distinct

Embedder = Callable[[Column], Column]
INDEX_ORDER = ("index_theory", "index_calculations", "index_qa")


def hashed_embedder(dimensions: int = 384) -> Embedder:
    """A vector of hashed tokens, of length one: a deterministic stand-in where no model is at hand."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pa.Array) -> pa.Array:
        out = np.zeros((len(texts), dimensions), np.float32)
        for row, t in zip(out, texts.to_pylist(), strict=True):
            for word in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % dimensions] += 1 if h >> 63 else -1
            row /= max(np.linalg.norm(row), 1e-9)
        return pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), dimensions).cast(pa.list_(pa.float32()))

    return embed


def embed_new(chunks: DataFrame, cache: DataFrame | None, embedder: Embedder, text_column: str = "embed_text") -> DataFrame:
    """chunks with embedding; texts that cache (sha, embedding) has are not embedded again, and equal texts once."""
    keyed = chunks.withColumn("sha", F.sha2(F.coalesce(F.col(text_column), F.lit("")), 256))
    distinct = keyed.groupBy("sha").agg(F.first(text_column).alias("text"))
    if cache is None:
        vectors_of = distinct.select("sha", embedder(F.col("text")).alias("embedding"))
    else:
        new = distinct.join(cache.select("sha"), "sha", "left_anti").select("sha", embedder(F.col("text")).alias("embedding"))
        vectors_of = cache.select("sha", "embedding").unionByName(new)
    return keyed.join(vectors_of, "sha")


def build_index(files: DataFrame, embedder: Embedder, cache: DataFrame | None = None, extra: list[DataFrame] = ()) -> DataFrame:
    """Markdown files (and chunks of other kinds) -> index rows with index_name, a position and an embedding."""
    chunks = documents.build_corpus([documents.tag(documents.chunk_markdown(files)), *extra])
    return embed_new(chunks, cache, embedder).withColumn("index_name", text.content_index(F.col("content_type"))).withColumn("pos", F.xxhash64("chunk_id", "sha"))


def retrieve(
    requests: DataFrame, index: DataFrame, embedder: Embedder, *, k: int = 5, threshold: float = 0.3, filters: dict[str, Column] | None = None, filter_mode: str = "post", force_index: str | None = None
) -> DataFrame:
    """requests (query_id, query) -> ranked chunks.

    The question's words choose the indexes; the expanded question is embedded.
    k hits of each index are filtered by metadata afterwards (post) or beforehand
    (pre), merged, each chunk once, cut to k and ranked.
    """
    asked = requests.withColumn("indexes", F.array(F.lit(force_index)) if force_index else text.route_indexes(F.col("query")))
    asked = staged(asked.select("query_id", "indexes", embedder(text.augment_query(F.col("query"))).alias("embedding")), "questions")
    wanted = F.lit(True)
    for c in (filters or {}).values():
        wanted = wanted & c
    rows = index.where(wanted) if filter_mode == "pre" else index
    found = []
    # an index is one partition of the table, and only the questions that go to it search it
    for order, name in enumerate([force_index] if force_index else INDEX_ORDER, 1):
        own = asked.where(F.array_contains("indexes", name)).select("query_id", "embedding")
        found.append(vectors.top_k(own, rows.where(F.col("index_name") == name), k, by=["index_name"], threshold=threshold).withColumn("index_ord", F.lit(order)))
    hits = reduce(DataFrame.unionByName, found)
    return vectors.merge_hits(hits.where(wanted) if filter_mode == "post" else hits, k)


def retrieve_for_calculation(requests: DataFrame, index: DataFrame, embedder: Embedder, k: int = 3, **more) -> DataFrame:
    """retrieve() from the calculations alone."""
    return retrieve(requests, index, embedder, k=k, force_index="index_calculations", **more)


def retrieve_for_theory(requests: DataFrame, index: DataFrame, embedder: Embedder, k: int = 5, **more) -> DataFrame:
    """retrieve() from the theory alone."""
    return retrieve(requests, index, embedder, k=k, force_index="index_theory", **more)


def diagnose(requests: DataFrame, index: DataFrame, embedder: Embedder, k: int = 10, threshold: float = 0.3) -> DataFrame:
    """All hits, with whether each reaches the threshold."""
    return retrieve(requests, index, embedder, k=k, threshold=-1.0).withColumn("passes", F.col("score") >= threshold)


def preview(hits: DataFrame, chars: int = 300) -> DataFrame:
    """What an interface shows: rounded scores and the start of the content, missing values filled."""
    return hits.select(
        "query_id", "rank", F.bround("score", 4).alias("score"), F.coalesce("chunk_id", F.lit("")).alias("chunk_id"), F.coalesce("topic", F.lit("")).alias("topic"), F.coalesce("subtopic", F.lit("")).alias("subtopic"), "index_name",
        F.substring(F.coalesce("content", F.lit("")), 1, chars).alias("preview"),
    )


def contexts(hits: DataFrame, budget: int = 3000) -> DataFrame:
    """One context for each query from its hits."""
    block = context.block(F.coalesce("topic", F.lit("")), F.coalesce("subtopic", F.lit("")), F.col("diagrams"), F.col("content"))
    return context.assemble(hits.withColumn("block", block), budget, text="block")


def solve(asked: DataFrame, question: str = "question") -> DataFrame:
    """Questions to task records, validated, evaluated; records with a critical issue have no answer."""
    return _solved(questions.task_records(asked, question))


def answers(asked: DataFrame, question: str = "question", columns: Sequence[str] = ("task", "answer_value", "answer_unit", "status")) -> DataFrame:
    """asked with those columns of solve(). A question that many rows ask, with equal fields of a record if rows have such, is solved once."""
    fields = [c for c in asked.columns if c != question and (c in numbers.FIELDS or c in validation.FORMULA_FIELDS)]
    keys = [question, *fields]

    def of(each: DataFrame) -> DataFrame:
        # staged, or the optimizer would put the rules into the evaluators, and both into the checks
        records = staged(questions.records_of(each, question), "task-records")
        return _solved(records).select(*keys, *columns)

    return with_distinct(asked, keys, of, "answers")


def _solved(records: DataFrame) -> DataFrame:
    records = questions.with_masses(records)
    out = validation.validated(numbers.evaluate(records))
    blocked = has_severity(F.col("issues"), "critical")
    return out.withColumn("status", F.when(blocked, "invalid").otherwise(F.col("status"))).withColumn("answer_value", F.when(~blocked, F.col("answer_value")))


def answer_lookup(asked: DataFrame, cache: DataFrame, messages: DataFrame) -> DataFrame:
    """Questions with language, history and, unless they are personal, the cached answer."""
    found = memory.smart_lookup(asked, cache, messages)
    return found.withColumn("lang", text.language_by_tokens(F.col("question")))
