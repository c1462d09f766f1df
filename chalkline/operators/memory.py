"""Answer cache, conversation history and retention as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..lexicons import HISTORY_FRAMES, PERSONAL_WORDS
from .sketch import Sketch, anti_join


def normalised_question(question: Column) -> Column:
    """Lower case, outer white space off, inner runs of it one blank."""
    return F.regexp_replace(F.regexp_replace(F.lower(question), r"^\s+|\s+$", ""), r"\s+", " ")


def question_hash(question: Column) -> Column:
    return F.substring(F.sha2(normalised_question(question), 256), 1, 16)


def first_of_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key. Spark keeps the best rows of each task before it shuffles."""
    w = W.partitionBy(key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(table: DataFrame, changes: DataFrame, key: str, at: str) -> DataFrame:
    """Latest row of each key; a change beats the table at equal times."""
    both = table.withColumn("__from", F.lit(0)).unionByName(changes.withColumn("__from", F.lit(1)))
    w = W.partitionBy(key).orderBy(F.desc(at), F.desc("__from"))
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__from")


def merge_upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Full outer merge in which a change's columns win unless they are null; other columns stay."""
    both = table.alias("t").join(changes.alias("c"), key, "full")
    own = [F.coalesce(F.col(f"c.{c}"), F.col(f"t.{c}")).alias(c) if c in changes.columns else F.col(f"t.{c}") for c in table.columns if c != key]
    return both.select(key, *own)


def increment(table: DataFrame, deltas: DataFrame, key: str, column: str) -> DataFrame:
    """table with the sum of the deltas of each key added to column."""
    total = deltas.groupBy(key).agg(F.sum(column).alias("__d"))
    return table.join(total, key, "left").withColumn(column, F.coalesce(column, F.lit(0)) + F.coalesce("__d", F.lit(0))).drop("__d")


def cache_lookup(questions: DataFrame, cache: DataFrame, question: str = "question") -> DataFrame:
    """questions with q_hash and the columns of cache (unique by q_hash), null on a miss; hit says which."""
    asked = questions.withColumn("q_hash", question_hash(F.col(question)))
    return asked.join(cache.withColumn("hit", F.lit(True)), "q_hash", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def unseen(texts: DataFrame, cache: DataFrame, text: str = "text", key: str = "sha", sketch: Sketch | None = None) -> DataFrame:
    """Distinct texts, by SHA-256, that cache has no row for.

    With a sketch of the cache's keys, only texts that it may have go through the join.
    """
    return anti_join(texts.select(F.sha2(text, 256).alias(key), text).dropDuplicates([key]), cache, key, sketch)


def should_cache(answer_type: Column, task: Column) -> Column:
    return (answer_type != "fallback") & (task != "unknown")


def is_personal(question: Column) -> Column:
    q = F.lower(question)
    return F.exists(F.array(*map(F.lit, PERSONAL_WORDS)), lambda w: F.contains(q, w))


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("n"), F.sum(F.coalesce("hit_count", F.lit(0))).alias("hits"))


def overview(sessions: DataFrame, cache: DataFrame) -> DataFrame:
    """One row: sessions, cached questions and their hits."""
    own = sessions.select(F.lit(1).alias("sessions"), F.lit(0).alias("cached"), F.lit(0).cast("bigint").alias("hits"))
    held = cache.select(F.lit(0).alias("sessions"), F.lit(1).alias("cached"), F.coalesce(F.col("hit_count").cast("bigint"), F.lit(0)).alias("hits"))
    return own.unionByName(held).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("sessions", "cached", "hits")))


def top_hits(cache: DataFrame, k: int = 5, preview: int = 60) -> DataFrame:
    """The k questions with most hits, missing counts as 0, cut to a preview; ties by question."""
    hits = F.coalesce("hit_count", F.lit(0))
    return cache.select(F.substring("question", 1, preview).alias("question"), hits.alias("hits"), F.col("question").alias("__q")).orderBy(F.desc("hits"), "__q").limit(k).drop("__q")


def last_n(messages: DataFrame, n: int, *, session: str = "session_id", order: str = "timestamp") -> DataFrame:
    """The newest n messages of each session, numbered chronologically from 1."""
    newest = W.partitionBy(session).orderBy(F.desc(order))
    kept = messages.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= n)
    return kept.withColumn("place", F.row_number().over(W.partitionBy(session).orderBy(order))).drop("__n")


def history_context(messages: DataFrame, n: int = 4, lang: str = "EN", *, session: str = "session_id", order: str = "timestamp", chars: int = 200) -> DataFrame:
    """One text for each session from its last n messages."""
    head, user, other, foot = HISTORY_FRAMES[lang]
    line = F.concat(F.when(F.col("role") == "user", user).otherwise(other), F.lit(": "), F.substring("content", 1, chars))
    rows = last_n(messages, n, session=session, order=order).select(session, "place", line.alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"])
    return rows.groupBy(session).agg(F.concat_ws("\n", F.lit(head), F.array_join(lines, "\n"), F.lit(foot)).alias("context"))


def older_than(sessions: DataFrame, days: float, now: Column, at: str = "updated_at") -> DataFrame:
    """Sessions last updated more than `days` before now."""
    return sessions.where(F.col(at) < now - F.expr(f"interval {int(days * 86400)} seconds"))


def drop_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def smart_lookup(questions: DataFrame, cache: DataFrame, messages: DataFrame, lang: str = "BM") -> DataFrame:
    """questions (session_id, question) with the history of their session, and the cached row unless the question is personal."""
    found = cache_lookup(questions, cache)
    personal = is_personal(F.col("question"))
    for c in (*cache.columns, "hit"):
        if c not in ("q_hash", *questions.columns):
            found = found.withColumn(c, F.when(~personal, F.col(c)))
    history = history_context(messages, 4, lang).withColumnRenamed("context", "history")
    return found.join(history, "session_id", "left").withColumn("history", F.coalesce("history", F.lit("")))
