"""Personal data by boosted trees over candidate spans, in DataFrame functions only.

Strict rules give the base spans, which always stay. High-recall generators
propose further, overlapping spans; gradient-boosted trees score each from its
format and its context, and those over their kind's calibrated threshold are
added. Trees are fitted on a bounded sample: strict spans written as people
disguise or garble them, in their own contexts, against what the generators
propose elsewhere. They are applied as nested CASE expressions inside the span
arrays, so nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import SPAN, count, find_spans, joined

#: Documents whose candidates a fit may read, and candidates at most.
FIT_DOCUMENTS, FIT_CANDIDATES = 20_000, 50_000
ROUNDS, RATE = 24, 0.3
#: The share of right ones among what a kind adds, on held-out examples, and how many of these must be right at least.
PRECISION, LEAST_RIGHT = 0.98, 20
BASE = ("email", "ip", "card", "phone")

#: Possessive loops and the look-behind (or the end of the last match) find the same spans as
#: the plain forms, in linear time and without recursion.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: High recall: anything like an address, and digit groups with up to two separators between digits.
LOOSE_ADDRESS = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:@|[(\[]at[)\]])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]++)*+"
LOOSE_NUMBER = r"[+(]?[0-9](?:[\x20()./-]{0,2}+[0-9])++"


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Holds for a string of digits whose Luhn sum is a multiple of ten."""

    def add(acc: Column, i: Column) -> Column:
        x = F.substring(d, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def is_ip(m: Column) -> Column:
    return m.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")


def is_card(m: Column) -> Column:
    d = digits(m)
    return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)


def is_phone(m: Column) -> Column:
    return F.length(digits(m)).between(10, 15)


STRICT = (
    ("email", EMAIL, lambda m: F.lit(True), "@"),
    ("ip", IP, is_ip, "."),
    ("card", CARD, is_card, ""),
    ("phone", PHONE, is_phone, "+"),
)
LOOSE = (
    ("address", LOOSE_ADDRESS, lambda m: F.lit(True), "at"),
    ("number", LOOSE_NUMBER, lambda m: F.length(digits(m)) >= 7, ""),
)
CUES = r"(?i)(?:mail|contact|phone|tel|call|mobile|fax|card|visa|account|iban|server|host|addr)[^\n]{0,24}$"


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with base (strict spans) and loose (all proposed spans), by start. A null text is empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("__text", whole)
    kinds = (*STRICT, *LOOSE)
    empty = F.expr("cast(array() as array<string>)")
    for i, (_, pattern, _, hint) in enumerate(kinds):
        found = F.regexp_extract_all("__text", F.lit(pattern), F.lit(0))
        if hint == "at":
            found = F.when(F.col("__text").rlike(r"@|[(\[]at[)\]]"), found).otherwise(empty)
        elif hint:
            found = F.when(F.contains(F.col("__text"), F.lit(hint)), found).otherwise(empty)
        out = out.withColumn(f"__m{i}", found)
    spans = [find_spans(F.col("__text"), p, F.col(f"__m{i}"), k, i, keep) for i, (k, p, keep, _) in enumerate(kinds)]
    n = len(STRICT)
    out = out.withColumn("base", F.array_sort(F.concat(*spans[:n]))).withColumn("loose", F.array_sort(F.concat(*spans[n:])))
    return out.drop(*(f"__m{i}" for i in range(len(kinds))))


def overlaps(base: Column, s: Column) -> Column:
    return F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))


def context(s: Column, text: Column) -> tuple[Column, Column, Column]:
    """A span's match, and the text before and after it that the trees see."""
    return s["match"], F.substring(text, F.greatest(s["start"] - 31, F.lit(1)), F.least(s["start"], F.lit(32))), F.substring(text, s["end"] + 1, F.lit(1))


def features(m: Column, before: Column, after: Column) -> dict[str, Column]:
    """What the trees see of a candidate: its format, and the text around it. No strict rule is among them."""
    n = lambda p: F.regexp_count(m, F.lit(p))
    return {
        "length": F.length(m), "digits": n("[0-9]"), "letters": n("[A-Za-z]"), "dots": n(r"\."), "dashes": n("-"), "spaces": n(" "), "brackets": n(r"[()\[\]]"),
        "groups": n("[0-9]+"), "longest_lead": F.length(F.regexp_extract(m, r"^[+(]?([0-9]*)", 1)), "plus": m.startswith("+").cast("int"),
        "at": F.contains(m, F.lit("@")).cast("int"), "first": F.ascii(digits(m)), "cue": before.rlike(CUES).cast("int"),
        "glued": (before.rlike(r"[\p{L}\p{N}_.,/-]$") | after.rlike(r"[\p{L}\p{N}_/-]")).cast("int"),
    }


#: How strict spans are disguised or garbled: base kind, the generator that then proposes them, and the writing.
DISGUISES = (
    ("email", "address", lambda m: F.regexp_replace(F.replace(m, F.lit("@"), F.lit(" (at) ")), r"\.(?=[A-Za-z0-9-]+$)", " (dot) ")),
    ("email", "address", lambda m: F.replace(m, F.lit("@"), F.lit("[at]"))),
    ("email", "address", lambda m: F.replace(m, F.lit("@"), F.lit(" @ "))),
    ("card", "number", lambda m: F.regexp_replace(m, "[ -]", ".")),
    ("card", "number", lambda m: F.regexp_replace(m, "[ -]", "  ")),
    ("phone", "number", lambda m: F.regexp_replace(m, r"^\+", "")),
    ("phone", "number", lambda m: F.regexp_replace(m, r"^\+", "00")),
)


@dataclass(frozen=True)
class Trees:
    """Boosted trees of two levels: ((feature, cut), (feature, cut), (feature, cut), four values); the least score by kind."""

    start: float
    trees: tuple
    thresholds: dict[str, float]

    def raw(self, own: dict[str, Column]) -> Column:
        out = F.lit(self.start)
        for (f, a), (g, b), (h, c), (w, x, y, z) in self.trees:
            low, high = F.when(own[g] <= b, w).otherwise(x), F.when(own[h] <= c, y).otherwise(z)
            out = out + F.when(own[f] <= a, low).otherwise(high)
        return out


def _split(x, g, h, rows):
    best = (0.0, 0, np.inf)
    total = g[rows].sum() ** 2 / (h[rows].sum() + 1)
    for j in range(x.shape[1]):
        for cut in np.unique(x[rows, j])[:-1]:
            low = rows & (x[:, j] <= cut)
            high = rows & ~low
            gain = g[low].sum() ** 2 / (h[low].sum() + 1) + g[high].sum() ** 2 / (h[high].sum() + 1) - total
            if gain > best[0] + 1e-9:
                best = (gain, j, float(cut))
    return best[1:]


def boost(x: np.ndarray, y: np.ndarray, kinds: list[str], names: list[str]) -> Trees:
    """Newton boosting of the log loss. Every third row calibrates: a kind's threshold is the lowest score at which PRECISION still holds there.

    With fewer than 30 rows, or one class, nothing is ever selected, nor of a
    kind with fewer than LEAST_RIGHT right ones above its threshold.
    """
    if len(y) < 30 or y.all() or not y.any():
        return Trees(0.0, (), {})
    held = np.arange(len(y)) % 3 == 2
    start = float(np.log(y.mean() / (1 - y.mean())))
    f, trees, fit = np.full(len(y), start), [], ~held
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        j, a = _split(x, g, h, fit)
        low = x[:, j] <= a
        (k, b), (m, c) = _split(x, g, h, fit & low), _split(x, g, h, fit & ~low)
        parts = [low & (x[:, k] <= b), low & ~(x[:, k] <= b), ~low & (x[:, m] <= c), ~low & ~(x[:, m] <= c)]
        values = tuple(float(RATE * g[q & fit].sum() / (h[q & fit].sum() + 1)) for q in parts)
        for q, v in zip(parts, values, strict=True):
            f[q] += v
        trees.append(((names[j], a), (names[k], b), (names[m], c), values))
    thresholds = {}
    for kind in sorted(set(kinds)):
        own = held & (np.array(kinds) == kind)
        order = np.argsort(-f[own], kind="stable")
        right = np.cumsum(y[own][order])
        good = np.flatnonzero((right >= PRECISION * np.arange(1, own.sum() + 1)) & (right >= LEAST_RIGHT))
        if len(good):
            thresholds[kind] = max(0.0, float(f[own][order][good[-1]]))
    return Trees(start, tuple(trees), thresholds)


def examples(docs: DataFrame, text: str = "text") -> DataFrame:
    """kind, features and y: disguised strict spans (1) and candidates that overlap no strict span (0)."""
    found = candidates(docs.select("doc_id", text), text)

    def row(kind, parts: tuple[Column, Column, Column], y: int) -> Column:
        return F.struct(kind.alias("kind"), *(c.cast("double").alias(k) for k, c in features(*parts).items()), F.lit(float(y)).alias("y"))

    def disguised(base: str, kind: str, write) -> Column:
        def one(s: Column) -> Column:
            m, before, after = context(s, F.col("__text"))
            return row(F.lit(kind), (write(m), before, after), 1)

        return F.transform(F.filter("base", lambda s: (s["kind"] == base) & (write(s["match"]) != s["match"])), one)

    elsewhere = F.transform(F.filter("loose", lambda s: ~overlaps(F.col("base"), s)), lambda s: row(s["kind"], context(s, F.col("__text")), 0))
    return found.select(F.explode(F.concat(elsewhere, *(disguised(*d) for d in DISGUISES))).alias("c")).select("c.*")


def fit(docs: DataFrame, text: str = "text") -> Trees:
    """Fit on examples of at most FIT_DOCUMENTS texts with a digit or an at sign, chosen by a hash, FIT_CANDIDATES at most."""
    key = F.xxhash64("doc_id", text)
    pool = docs.where(F.col(text).rlike("[0-9]{3}|@|[(\\[]at[)\\]]"))
    last = pool.select(key.alias("k")).orderBy("k").limit(FIT_DOCUMENTS).agg(F.max("k")).first()[0]
    if last is None:
        return Trees(0.0, (), {})
    rows = examples(pool.where(key <= last), text)
    rows = rows.orderBy(F.xxhash64(*rows.columns), *rows.columns).limit(FIT_CANDIDATES).collect()
    if not rows:
        return Trees(0.0, (), {})
    data = np.array([tuple(r)[1:] for r in rows], np.float64)
    return boost(data[:, :-1], data[:, -1], [r["kind"] for r in rows], rows[0].__fields__[1:-1])


def find(docs: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """docs with spans: base spans, and selected candidates that overlap none of them, by start.

    One row for each input row, repeated ones too; a null text has no spans, an
    empty table no rows; texts may be of any length. A column of docs called
    spans, base or loose gives way.
    """
    found = candidates(docs.drop("spans", "base", "loose"), text)
    if not trees.thresholds:
        return found.withColumn("spans", F.col("base")).drop("__text", "base", "loose")
    def good(s: Column) -> Column:
        least = F.lit(None).cast("double")
        for kind, threshold in trees.thresholds.items():
            least = F.when(s["kind"] == kind, threshold).otherwise(least)
        return F.coalesce(trees.raw(features(*context(s, F.col("__text")))) >= least, F.lit(False))

    chosen = F.filter("loose", lambda s: ~overlaps(F.col("base"), s) & good(s))
    return found.withColumn("spans", F.array_sort(F.concat("base", chosen)).cast(SPAN)).drop("__text", "base", "loose")


def report(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", *(count(F.col("spans"), k).alias(f"n_{k}") for k in BASE),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )
