"""How far recognised text can be trusted: weighted signals as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicons as L
from .matcher import Lexicon

HIGH, MEDIUM = 0.70, 0.45

#: Patterns that only noise has.
GARBAGE = (r"(.)\1{5,}", r"[^\x00-\x7F]{6,}", r"[|\\]{4,}", r"\b[A-Z]{10,}\b", r"[\x00-\x08\x0b-\x1f\x7f]")
#: What a formula looks like, and a number with its unit.
FORMULA = r"\b[A-Z][a-z]?[0-9]*(?:\([A-Za-z0-9]+\)[0-9]*)*[A-Za-z0-9]*\b"
MEASURE = r"(?i)\b[0-9]+(?:\.[0-9]+)?\s*(?:g|mol|dm3|cm3|kJ|J|°C|M|V|%|dm|cm|L|l)\b"
#: What only damaged text has.
DAMAGED = (r"\b[A-Z][0-9][A-Z](?![A-Za-z0-9_])", r"\b[0-9][A-Z][0-9]\b", r"\b[a-z]{4,}\b")


#: A symbol that is no known element.
_one, _two = (sorted(e for e in L.KNOWN_ELEMENTS if len(e) == n) for n in (1, 2))
UNKNOWN = rf"(?!(?:{'|'.join(_two)}))[A-Z][a-z]|(?![{''.join(_one)}])[A-Z](?![a-z])"


def plausible_formulas(text: Column) -> Column:
    """Tokens that consist of known elements."""
    tokens = F.regexp_extract_all(text, F.lit(FORMULA), F.lit(0))
    bare = lambda t: F.when(F.contains(t, F.lit("(")), F.regexp_replace(t, r"(?i)\((?:aq|s|l|g)\)", "")).otherwise(t)
    return F.filter(tokens, lambda t: ~bare(t).rlike(UNKNOWN))


def malformed(text: Column) -> Column:
    def unequal(a: str, b: str) -> Column:
        return F.length(F.replace(text, F.lit(a), F.lit(""))) != F.length(F.replace(text, F.lit(b), F.lit("")))

    out = unequal("(", ")") | unequal("[", "]")
    for p in DAMAGED:
        out = out | text.rlike(p)
    return out


LOW, UPPER = Lexicon([*L.MALAY_CHEMISTRY, *L.ENGLISH_CHEMISTRY, *L.CALCULATION_WORDS]), Lexicon(L.STRUCTURE_MARKERS)


def step(count: Column, *values: float) -> Column:
    """The value of a count: the first for 0, the last for as many or more; evaluates the count once."""
    return F.element_at(F.array(*map(F.lit, values)), F.greatest(F.least(count, F.lit(len(values) - 1)), F.lit(0)).cast("int") + 1)


def signals(text: Column, source: Column) -> dict[str, Column]:
    """Each signal and what it adds to the base of 0.5. The steps and what each adds."""
    n = F.length(text)
    low, upper = LOW.hits(F.lower(text)), UPPER.hits(F.upper(text))
    garbage = sum((text.rlike("(?d)" + p).cast("int") for p in GARBAGE), F.lit(0))
    markers = UPPER.count_of(upper, L.STRUCTURE_MARKERS)
    words = F.greatest(LOW.count_of(low, L.MALAY_CHEMISTRY), LOW.count_of(low, L.ENGLISH_CHEMISTRY))
    formulas, measures = F.size(plausible_formulas(text)), F.regexp_count(text, F.lit(MEASURE))
    return {
        "source": F.when(source == "local_ocr", -0.10).otherwise(0.0),
        "garbage": step(garbage, 0.0, -0.15, -0.30),
        "length": F.when(n < 10, -0.15).when(n < 20, -0.05).when(n <= 500, 0.05).when(n > 1500, -0.05).otherwise(0.0),
        "structure": step(markers, 0.0, 0.05, 0.05, 0.10),
        "words": step(words, -0.10, 0.08, 0.08, 0.15),
        "formulas": step(formulas, 0.0, 0.05, 0.10),
        "malformed": F.when(malformed(text), -0.20).otherwise(0.0),
        "measures": step(measures, 0.0, 0.05, 0.10),
        "equation": F.when(text.rlike(r"(?d).{2}\s*->\s*.{2}"), 0.08).otherwise(0.0),
        "calculation": F.when(LOW.any_of(low, L.CALCULATION_WORDS), 0.05).otherwise(0.0),
    }


def confidence(text: Column, source: Column | None = None) -> Column:
    """0 to 1, three decimals; 0 for null and blank text."""
    parts = signals(text, F.lit("unknown") if source is None else source)
    total = sum(parts.values(), F.lit(0.5))
    blank = text.isNull() | ~text.rlike(r"\S")
    return F.when(blank, 0.0).otherwise(F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 3))


def tier(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")


def gated(text: Column, score: Column) -> Column:
    """The text if trusted, marked if middling, null if not."""
    t = tier(score)
    return F.when(t == "high", text).when(t == "medium", F.concat(F.lit("__MEDIUM_CONF__"), text))


def quick_confidence(text: Column) -> Column:
    """A coarse value from 0 to 0.8 for a first gate."""
    n, words = F.length(text), F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))
    odd = F.length(F.regexp_replace(text, r"[\x00-\x7F°ΔΩμ→⇌⁺⁻₀₁₂₃₄₅₆₇₈₉αβγδ]", ""))
    return (
        F.when(F.coalesce(n, F.lit(0)) < 5, 0.0).when(n < 15, 0.15).when(words < 3, 0.20).when(odd > 0.30 * n, 0.10).when(text.rlike(r"(?d)(.)\1{5,}"), 0.20).when(text.rlike(r"\b[A-Z]{10,}\b"), 0.25).otherwise(0.80)
    )
