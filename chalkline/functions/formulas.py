"""Chemical formulas and equations. Grammars recurse, so these run as Arrow functions; what follows them is built in."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import lexicons as L

_PIECES = re.compile(r"[A-Z][a-z]?|\d+|[()]")
_STATE = re.compile(r"\((?:aq|s|l|g)\)\s*$", re.I)
#: A charge is set off by a caret or is a bare sign; digits before a bare sign belong to the formula.
_CHARGE = re.compile(r"\^\d*[+-]\d*$|[+-]$")
_ARROWS = re.compile("→|⇌|↔|⟶|=>|->")


class Unreadable(ValueError):
    """A formula or equation that the grammar does not have."""


def normalise_formula(text: str) -> str:
    """Without blanks, state, charge and leading coefficient; middle dots become points, brackets become parentheses."""
    f = re.sub("[·•∙]", ".", text.strip()).replace("−", "-").replace("[", "(").replace("]", ")").replace(" ", "")
    f = re.sub(r"^\d+(?=[A-Z(])", "", _CHARGE.sub("", _STATE.sub("", f)))
    if not f:
        raise Unreadable("empty formula")
    return f


def _group(pieces: list[str], at: int, inside: bool) -> tuple[dict[str, int], int]:
    """Counts of the elements from `at` to the end or the closing parenthesis, and where it ends."""
    counts: dict[str, int] = {}
    while at < len(pieces):
        p = pieces[at]
        at += 1
        if p == ")":
            if inside:
                return counts, at
            raise Unreadable("closing parenthesis without an opening one")
        if p == "(":
            own, at = _group(pieces, at, True)
        elif p in L.ATOMIC_MASS:
            own = {p: 1}
        else:
            raise Unreadable(f"unexpected {p}")
        times = 1
        if at < len(pieces) and pieces[at].isdigit():
            times, at = int(pieces[at]), at + 1
        for element, n in own.items():
            counts[element] = counts.get(element, 0) + n * times
    if inside:
        raise Unreadable("parenthesis without an end")
    return counts, at


def parse_formula(text: str) -> dict[str, int]:
    """Atoms of each element, in order of appearance; hydrate parts may have multipliers. Other characters are skipped."""
    total: dict[str, int] = {}
    parts = [p for p in normalise_formula(text).split(".") if p]
    if not parts:
        raise Unreadable("no parts")
    for part in parts:
        m = re.match(r"(\d+)(?=[A-Z(])", part)
        pieces = _PIECES.findall(part[m.end() :] if m else part)
        if not pieces:
            raise Unreadable("no elements")
        for element, n in _group(pieces, 0, False)[0].items():
            total[element] = total.get(element, 0) + n * (int(m[1]) if m else 1)
    return total


def is_formula(text: str) -> bool:
    try:
        return bool(re.search("[A-Z]", text)) and bool(parse_formula(text))
    except (Unreadable, RecursionError):
        return False


def parse_side(side: str) -> dict[str, int]:
    """Coefficients of the species of one side, repeated species summed."""
    out: dict[str, int] = {}
    for token in filter(None, (p.strip() for p in side.split("+"))):
        token = _STATE.sub("", token).strip()
        m = re.match(r"(\d+)\s*(?=\S)", token)
        formula = normalise_formula(token[m.end() :] if m else token)
        if not is_formula(formula):
            raise Unreadable(f"not a formula: {formula}")
        out[formula] = out.get(formula, 0) + (int(m[1]) if m else 1)
    if not out:
        raise Unreadable("an empty side")
    return out


def parse_equation(text: str) -> tuple[dict[str, int], dict[str, int]]:
    sides = _ARROWS.sub("->", text).split("->", 1)
    if len(sides) < 2:
        sides = text.split("=", 1)
    if len(sides) < 2:
        raise Unreadable("no arrow")
    return parse_side(sides[0]), parse_side(sides[1])


COUNTS = T.MapType(T.StringType(), T.IntegerType())
SIDES = T.StructType([T.StructField("reactants", COUNTS), T.StructField("products", COUNTS)])
_counts = pa.map_(pa.string(), pa.int32())


def _each(values: pa.Array, parse, kind: pa.DataType) -> pa.Array:
    """parse of each distinct value once; null where it cannot be read."""
    known: dict = {None: None}
    out = []
    for v in values.to_pylist():
        if v not in known:
            try:
                known[v] = parse(v)
            except (Unreadable, RecursionError, ValueError):
                known[v] = None
        out.append(known[v])
    return pa.array(out, kind)


@F.arrow_udf(COUNTS)
def formula_counts(formula: pa.Array) -> pa.Array:
    """The atoms of each element of a formula; null if it cannot be read."""
    return _each(formula, lambda f: list(parse_formula(f).items()), _counts)


@F.arrow_udf(T.ArrayType(COUNTS))
def formulas_counts(formulas: pa.Array) -> pa.Array:
    """formula_counts of each formula of an array."""

    def read(f):
        try:
            return list(parse_formula(f).items()) if f is not None else None
        except (Unreadable, RecursionError):
            return None

    return pa.array([None if a is None else [read(f) for f in a] for a in formulas.to_pylist()], pa.list_(_counts))


@F.arrow_udf(SIDES)
def equation_sides(equation: pa.Array) -> pa.Array:
    """The species of both sides with coefficients; null if it cannot be read."""

    def parse(e):
        left, right = parse_equation(e)
        return {"reactants": list(left.items()), "products": list(right.items())}

    return _each(equation, parse, pa.struct([("reactants", _counts), ("products", _counts)]))


@F.arrow_udf(T.StringType())
def canonical_formula(formula: pa.Array) -> pa.Array:
    return _each(formula, normalise_formula, pa.string())


def masses_by_element() -> Column:
    return F.create_map(*(F.lit(x) for pair in L.ATOMIC_MASS.items() for x in pair))


def molar_mass(counts: Column) -> Column:
    """The mass of one mole from formula_counts."""
    known = masses_by_element()
    return F.aggregate(F.map_entries(counts), F.lit(0.0), lambda s, e: s + e["value"] * F.try_element_at(known, e["key"]))


def formula_text(counts: Column) -> Column:
    """Elements in alphabetic order, counts of one left out."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat(e["key"], F.when(e["value"] > 1, e["value"].cast("string")).otherwise(""))), "")


def species_ratio(sides: Column, first: Column, second: Column) -> Column:
    """Coefficient of `second` by that of `first`, names being canonical; a product's beats a reactant's of the same name."""

    def coefficient(name: Column) -> Column:
        return F.coalesce(F.try_element_at(sides["products"], name), F.try_element_at(sides["reactants"], name)).cast("double")

    return F.try_divide(coefficient(second), coefficient(first))


#: Oxidation numbers of elements that are taken as known.
OXIDATION = {"O": -2, "H": 1, "Li": 1, "Na": 1, "K": 1, "Mg": 2, "Ca": 2, "Ba": 2}


def oxidation_parts(counts: Column, target: Column) -> tuple[Column, Column]:
    """(sum over the other elements, atoms of the target); the sum is null if one of the others is not known."""
    known = F.create_map(*(F.lit(x) for pair in OXIDATION.items() for x in pair))
    others = F.filter(F.map_entries(counts), lambda e: e["key"] != target)
    total = F.aggregate(others, F.lit(0.0), lambda s, e: s + e["value"] * F.try_element_at(known, e["key"]))
    return total, F.try_element_at(counts, target)


#: Salts of acids and bases, in either order.
SALTS = (
    ("HCl", "NaOH", "NaCl + H2O"), ("HCl", "KOH", "KCl + H2O"), ("HCl", "Ca(OH)2", "CaCl2 + H2O"), ("HCl", "NH3", "NH4Cl"), ("H2SO4", "NaOH", "Na2SO4 + H2O"),
    ("H2SO4", "KOH", "K2SO4 + H2O"), ("HNO3", "NaOH", "NaNO3 + H2O"), ("CH3COOH", "NaOH", "CH3COONa + H2O"),
)


def salt_of(acid: Column, base: Column) -> Column:
    """The products of an acid and a base; both again if the pair is not in the table."""
    out = F.concat(acid, F.lit(" + "), base)
    pair = F.array_sort(F.array(F.trim(acid), F.trim(base)))
    for a, b, products in SALTS:
        out = F.when(pair == F.array(*map(F.lit, sorted((a, b)))), products).otherwise(out)
    return out


#: Atoms in one molecule of common gases whose formula need not be parsed.
GAS_ATOMS = {"Xe": 1}


def gas_with_atoms(options: Column, counts: Column, target: Column, volume: Column, molar: Column, tolerance: float = 1e-3) -> Column:
    """Of options (letter, formula, volume_dm3), the last whose amount of atoms is target; counts: formulas_counts of theirs."""

    def atoms(c: Column) -> Column:
        return F.coalesce(F.aggregate(F.map_values(c), F.lit(0), lambda s, n: s + n), F.lit(1))

    amounts = F.zip_with(options, counts, lambda o, c: F.struct(o.alias("option"), (F.coalesce(o["volume_dm3"], volume) / molar * atoms(c)).alias("amount")))
    fits = F.filter(amounts, lambda a: F.abs(a["amount"] - target) < tolerance)
    return F.when(F.size(fits) > 0, F.element_at(fits, -1)["option"])
