"""Learned decision lists over text statistics.

Sequential covering: a rule is a conjunction of thresholds that is grown on two
thirds of the labelled documents by information gain and pruned on the rest;
covered documents are set aside and the next rule is grown. The list becomes an
ordered Spark CASE expression.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bounded_labels, text_bytes

#: Most labelled documents that a fit reads.
FIT_DOCUMENTS = 8000
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper")
STATS = pa.struct([(c, pa.int64()) for c in COUNTS])


def statistics(text: bytes) -> tuple[int, ...]:
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    chars = np.frombuffer(joined, np.uint8)
    word_chars = int(np.count_nonzero((chars & 0xC0) != 0x80))
    upper = int(np.count_nonzero((chars >= 65) & (chars <= 90)))
    symbols = sum(joined.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        times, end = Counter(windows), 0
        for i, x in enumerate(windows):
            if times[x] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return n, word_chars, symbols, len(lines) - len(set(lines)), repeated, upper


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def _statistics(text: pa.Array) -> pa.Array:
    rows = [statistics(x.as_py() or b"") for x in text]
    columns = np.array(rows, np.int64).reshape(-1, len(COUNTS)).T
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(STATS))


def text_statistics(docs: DataFrame) -> DataFrame:
    """docs with the columns of COUNTS, of every whole text; a null text has no words.

    Columns of docs with those names give way.
    """
    kept = [c for c in docs.columns if c not in COUNTS]
    out = docs.withColumn("__stats", _statistics(text_bytes()))
    return out.select(*kept, *(F.col(f"__stats.{c}").alias(c) for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> dict[str, Column]:
    """What conditions may test; shares are of words or of characters in words."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "chars_per_word": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "dup_lines_per_word": F.col("n_dup_lines") / n,
        "repeat_share": F.col("n_repeat_words") / n,
        "upper_share": F.col("n_upper") / chars,
    }


@dataclass(frozen=True)
class Rule:
    """Reject where all conditions (feature, sign, threshold) hold; sign 1 is >=, -1 is <=."""

    conditions: tuple[tuple[str, int, float], ...]
    covered: int
    right: int

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, sign, at in self.conditions:
            v = x[:, names.index(f)]
            out &= v >= at if sign > 0 else v <= at
        return out


def _best_condition(x, bad, names, most_cuts=40):
    p0, n0 = bad.sum(), len(bad)
    base, best = np.log2((p0 + 1e-9) / n0), (0.0, None)
    for j, name in enumerate(names):
        cuts = np.unique(np.quantile(x[:, j], np.linspace(0, 1, most_cuts)))
        cuts = np.unique(np.concatenate([cuts, np.quantile(x[bad, j], np.linspace(0, 1, most_cuts))]))
        for at in cuts:
            for sign in (1, -1):
                on = x[:, j] >= at if sign > 0 else x[:, j] <= at
                p = (on & bad).sum()
                if p and on.sum() < n0 and (gain := p * (np.log2(p / on.sum()) - base)) > best[0] + 1e-9:
                    best = (gain, (name, sign, float(at)))
    return best[1]


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], max_rules: int = 8, precision: float = 0.9, least: int = 5) -> list[Rule]:
    """Rules in order; a rule stays while it covers `least` documents of the prune set's size or more at that precision."""
    rules: list[Rule] = []
    prune = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), bool)
    while len(rules) < max_rules and (bad & left & ~prune).any():
        gx, gb = x[left & ~prune], bad[left & ~prune]
        conditions: list[tuple[str, int, float]] = []
        while gb.any() and not gb.all() and len(conditions) < 4 and (c := _best_condition(gx, gb, names)):
            conditions.append(c)
            on = Rule((c,), 0, 0).holds(gx, names)
            gx, gb = gx[on], gb[on]
        if not conditions:
            break
        px, pb = x[left & prune], bad[left & prune]

        def worth(k, conditions=conditions, px=px, pb=pb):
            on = Rule(tuple(conditions[:k]), 0, 0).holds(px, names)
            return ((pb & on).sum() - (~pb & on).sum()) / max(1, on.sum()), (pb & on).sum()

        k = max(range(1, len(conditions) + 1), key=worth)
        on = Rule(tuple(conditions[:k]), 0, 0).holds(x, names) & left
        n, right = int(on.sum()), int((on & bad).sum())
        if n < least or right < precision * n:
            break
        rules.append(Rule(tuple(conditions[:k]), n, right))
        left &= ~on
    return rules


def fit(docs: DataFrame, labels: DataFrame, limit: int = FIT_DOCUMENTS) -> list[Rule]:
    """Learn from at most `limit` labelled documents outside fold 0 that pass the base rules.

    Without labels, or with labels of one class, the list is empty and rejects nothing.
    """
    chosen = F.broadcast(bounded_labels(labels, "quality", limit))
    sample = docs.select("doc_id", "text").join(chosen, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(limit)
    own = features()
    sample = text_statistics(sample).select("label", base_failed().alias("base_failed"), *(own[k].alias(f"f_{k}") for k in own))
    rows = sample.toPandas()
    rows, names = rows[~rows["base_failed"]], list(own)
    x = rows[[f"f_{k}" for k in names]].to_numpy(np.float64).reshape(-1, len(names))
    return learn(x, rows["label"].to_numpy() == 0, names)


def verdict(rules: list[Rule]) -> Column:
    """The 1-based number of the first rule that rejects, else null."""
    own = features()
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        on = F.lit(True)
        for f, sign, at in rule.conditions:
            on = on & (own[f] >= at if sign > 0 else own[f] <= at)
        out = F.when(on, F.lit(i)).otherwise(out)
    return out


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """docs with statistics, base_failed, rule (that rejected) and kept. One row for each input row."""
    out = text_statistics(docs).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
