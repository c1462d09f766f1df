"""Budgeted context from ranked hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def within_budget(blocks: DataFrame, budget: int, *, group: str = "query_id", order: str = "rank", text: str = "content") -> DataFrame:
    """The leading blocks of each group whose lengths sum to at most budget; the first that does not fit ends it."""
    used = F.sum(F.length(text)).over(W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return blocks.withColumn("used_chars", used).where(F.col("used_chars") <= budget)


def block(topic: Column, subtopic: Column, diagrams: Column, content: Column) -> Column:
    """The lines above a hit that are not empty, then its content. diagrams: array of struct(alt, path)."""
    names = F.array_join(F.transform(diagrams, lambda d: F.coalesce(d["alt"], d["path"])), ", ")
    return F.concat_ws(
        "\n",
        F.when(topic != "", F.concat(F.lit("[Topik: "), topic, F.lit("]"))),
        F.when(subtopic != "", F.concat(F.lit("[Subtopik: "), subtopic, F.lit("]"))),
        F.when(F.size(diagrams) > 0, F.concat(F.lit("[Rajah: "), names, F.lit("]"))),
        content,
    )


def assemble(blocks: DataFrame, budget: int, *, group: str = "query_id", order: str = "rank", text: str = "content", separator: str = "\n\n---\n\n") -> DataFrame:
    """One context for each group; a group is the few hits of one query."""
    fit = within_budget(blocks, budget, group=group, order=order, text=text)
    listed = F.array_sort(F.collect_list(F.struct(order, text)))
    return fit.groupBy(group).agg(F.count("*").alias("n_blocks"), F.array_join(F.transform(listed, lambda b: b[text]), separator).alias("context"))


def prompt(question: Column, context: Column, template: str, empty: str) -> Column:
    """template with {context} and {question} filled in; `empty` stands for no context."""
    return F.replace(F.replace(F.lit(template), F.lit("{context}"), F.coalesce(F.when(context != "", context), F.lit(empty))), F.lit("{question}"), question)
