"""Text functions: Column in, Column out, no Python on the executors."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicons as L


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value evaluated once for a row."""
    return F.transform(F.array(value), body)[0]


def strings(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values))


def strip(text: Column) -> Column:
    """Without white space on either side."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Whether text has one of the words as a substring."""
    return reduce(Column.__or__, (F.contains(text, F.lit(w)) for w in words), F.lit(False))


def distinct_hits(text: Column, words: Sequence[str]) -> Column:
    """How many of the words text contains."""
    return sum((F.coalesce(F.contains(text, F.lit(w)).cast("int"), F.lit(0)) for w in words), F.lit(0))


def fold_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def language_by_markers(text: Column) -> Column:
    """BM or EN if one side has more than twice the markers of the other, else mixed."""

    def n(words: Sequence[str]) -> Column:
        return F.regexp_count(text, F.lit(r"(?i)\b(?:" + "|".join(words) + r")\b"))

    counts = F.struct(n(L.MALAY_MARKERS).alias("bm"), n(L.ENGLISH_MARKERS).alias("en"))
    return let(counts, lambda c: F.when(c["bm"] > c["en"] * 2, "BM").when(c["en"] > c["bm"] * 2, "EN").otherwise("mixed"))


def language_by_tokens(text: Column) -> Column:
    """EN if two or more white-space tokens are common English words, else BM."""
    tokens = F.split(F.lower(text), r"\s+")
    return F.when(F.size(F.filter(tokens, lambda t: t.isin(*L.ENGLISH_TOKENS))) >= 2, "EN").otherwise("BM")


def route_indexes(question: Column) -> Column:
    """Which indexes to search, in order, by the words of the question."""
    q = F.lower(question)
    calc, theory, qa = (contains_any(q, s) for s in (L.CALCULATION_SIGNALS, L.THEORY_SIGNALS, L.QA_SIGNALS))
    return (
        F.when(theory, strings(["index_theory", "index_qa"]))
        .when(calc & ~qa, strings(["index_calculations", "index_theory"]))
        .when(qa & ~calc, strings(["index_qa", "index_theory"]))
        .otherwise(strings(["index_theory", "index_calculations", "index_qa"]))
    )


def task_indexes(task: Column) -> Column:
    own = task.isin(*L.CALCULATION_TASKS)
    return F.when(own, strings(["index_calculations"])).otherwise(strings(["index_calculations", "index_theory"]))


def content_index(content_type: Column) -> Column:
    out = F.lit("index_theory")
    for kind, index in L.CONTENT_INDEX.items():
        out = F.when(content_type == kind, index).otherwise(out)
    return out


def augment_query(question: Column, most: int = 10) -> Column:
    """The question and up to `most` words of the expansions of its keys that it lacks.

    Keys are compared with the lower-cased question as they are, so a key with a
    capital never applies.
    """
    q = F.lower(question)
    words = [
        F.when(F.contains(q, F.lit(key)) & ~F.contains(q, F.lit(expansion)), strings(expansion.split())).otherwise(F.expr("cast(array() as array<string>)"))
        for key, expansion in L.QUERY_EXPANSIONS.items()
    ]
    extra = F.slice(F.filter(F.flatten(F.array(*words)), lambda w: ~F.contains(q, F.lower(w))), 1, most)
    return F.when(F.size(extra) > 0, F.concat(question, F.lit(" "), F.array_join(extra, " "))).otherwise(question)


def clean_recognised(text: Column) -> Column:
    """Text recognised from an image: mathematical markup, script digits, arrows, dashes and runs of white space made plain."""
    out = text
    for pattern, by in ((r"\$\\rm\s*", ""), (r"\$", ""), (r"\\text\{([^}]*)\}", "$1"), (r"\\rm\s*", ""), (r"_\{([0-9]+)\}", "$1"), (r"\^\{([^}]+)\}", "$1"), (r"_([0-9]+)", "$1"), (r"\^([0-9]+)", "$1")):
        out = F.regexp_replace(out, pattern, by)
    out = F.translate(out, "₀₁₂₃₄₅₆₇₈₉⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻−–—×", "01234567890123456789+----x")
    for old, new in (("→", "->"), ("⟶", "->"), ("⇌", "<->"), ("⇆", "<->")):
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.regexp_replace(F.regexp_replace(out, "\n{3,}", "\n\n"), " {2,}", " ")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def normalise_question(text: Column, *, repair: bool = True) -> Column:
    """A question made ready for extraction: markup, arrows, script digits and units in one plain form.

    repair: superscript digits and `x 10^n` with blanks become plain too; without
    it only the literal forms do.
    """
    out = F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s*\[[A-Za-z][A-Za-z0-9=,\s.]*\]", "")
    out = F.translate(F.replace(out, F.lit("\\text{"), F.lit("")), "\u00a0−⁻₀₁₂₃₄₅₆₇₈₉$}", " --0123456789")
    out = F.replace(out, F.lit("→"), F.lit("->"))
    if repair:
        out = F.regexp_replace(F.translate(out, "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789"), r"\s*[×x]\s*10\s*\^?\s*(-?[0-9]+)", "e$1")
    for old, new in (
        ("cm³", "cm3"), ("dm³", "dm3"), ("cm 3", "cm3"), ("dm 3", "dm3"), ("mℓ", "ml"), ("mol dm^-3", "mol dm3"), ("mol dm-3", "mol dm3"),
        ("×10^", "e"), ("x10^", "e"), ("× 10^", "e"), ("x 10^", "e"), ("×10", "e"), ("x10", "e"),
    ):
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.regexp_replace(out, r"\s+", " ")


def html_escape(text: Column) -> Column:
    out = text
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


ANSWER_PHRASES = (
    ("Diberi:", "Given:"), ("Pengiraan:", "Calculation:"), ("Jawapan:", "Answer:"), ("Bilangan mol", "Number of moles"), ("Isipadu", "Volume"),
    ("Jisim molar", "Molar mass"), ("Jisim", "Mass"), ("Kemolaran", "Molarity"), ("Nombor pengoksidaan", "Oxidation number"),
)


def translate_answer(text: Column, lang: Column) -> Column:
    """The headings of an answer in English where lang is EN."""
    out = text
    for old, new in ANSWER_PHRASES:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.when(lang == "EN", out).otherwise(text)


def numbers(text: Column, pattern: str) -> Column:
    """The numbers that group 1 of all matches holds."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).cast("array<double>")


NUMBER = r"([0-9]+(?:\.[0-9]+)?)"


def masses(text: Column) -> Column:
    """Masses in grams; milligrams are converted."""
    t = F.lower(text)
    pattern = NUMBER + r"\s*(mg|g)\b"
    units = F.regexp_extract_all(t, F.lit(pattern), F.lit(2))
    return F.zip_with(numbers(t, pattern), units, lambda v, u: F.when(u == "mg", v / 1000).otherwise(v))


def volumes_cm3(text: Column) -> Column:
    return numbers(F.lower(text), NUMBER + r"\s*(?:cm3|ml)\b")


def volumes_dm3(text: Column) -> Column:
    return numbers(F.lower(text), NUMBER + r"\s*dm3\b")


def moles(text: Column) -> Column:
    return numbers(F.lower(text), NUMBER + r"\s*mol\b")


def molarities(text: Column) -> Column:
    """Values in mol dm-3 as written, then those in mol dm3 that are not among them yet."""
    t = F.lower(text)
    first = numbers(t, NUMBER + r"\s*mol\s*dm[-−]?3")
    plain = F.when(F.contains(t, F.lit("dm3")), F.array_except(numbers(t, NUMBER + r"\s*mol\s*dm3"), first))
    return F.concat(first, F.coalesce(plain, F.when(t.isNotNull(), F.expr("cast(array() as array<double>)"))))


def temperatures(text: Column) -> Column:
    return numbers(F.lower(text), NUMBER + r"\s*°?\s*c\b")


def times(text: Column) -> Column:
    return numbers(F.lower(text), NUMBER + r"\s*(?:s|sec|second|seconds|min|minute|minutes)\b")


def ph(text: Column) -> Column:
    return F.regexp_extract(F.lower(text), r"\bph\s*=?\s*" + NUMBER, 1).try_cast("double")


def poh(text: Column) -> Column:
    return F.regexp_extract(F.lower(text), r"\bpoh\s*=?\s*" + NUMBER, 1).try_cast("double")


def gas_condition(text: Column) -> Column:
    t = F.lower(text)
    return F.when(F.contains(t, F.lit("stp")), "STP").when(contains_any(t, ["rtp", "room", "keadaan bilik"]), "RTP")


def collapse_json(text: Column) -> Column:
    """The outermost braces of a text, if there are any."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)
