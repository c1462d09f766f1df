"""Checks of task records, formulas and answers, as tables of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formulas as G
from ..functions.text import NUMBER
from ..sources.staging import with_distinct
from .rules import Rule, issues

# ---- Fixed values: misread formulas and what they stand for

MISREAD = {
    "H20": "H2O", "Na0H": "NaOH", "KMn04": "KMnO4", "K2Cr207": "K2Cr2O7", "Fe203": "Fe2O3", "A1203": "Al2O3", "Cu0": "CuO", "Mg0": "MgO", "Zn0": "ZnO", "Ca0": "CaO", "N02": "NO2", "S02": "SO2", "C02": "CO2", "H2S04": "H2SO4",
    "HN03": "HNO3", "Ca(0H)2": "Ca(OH)2", "Ba(0H)2": "Ba(OH)2", "NH40H": "NH4OH", "Na2C03": "Na2CO3", "CaC03": "CaCO3", "Na2S03": "Na2SO3", "Na2S203": "Na2S2O3", "K2S04": "K2SO4", "Na2S04": "Na2SO4", "CuS04": "CuSO4",
    "ZnS04": "ZnSO4", "FeS04": "FeSO4", "Fe2(S04)3": "Fe2(SO4)3", "Al2(S04)3": "Al2(SO4)3", "Cu(N03)2": "Cu(NO3)2", "Fe(N03)3": "Fe(NO3)3", "Ca(N03)2": "Ca(NO3)2", "NaC1": "NaCl", "KC1": "KCl", "CaC12": "CaCl2", "MgC12": "MgCl2",
    "A1C13": "AlCl3", "A1Cl3": "AlCl3", "FeC13": "FeCl3", "ZnC12": "ZnCl2", "CuC12": "CuCl2", "BaC12": "BaCl2", "A1": "Al", "HCL": "HCl", "NACL": "NaCl", "NAOH": "NaOH", "NAHCO3": "NaHCO3", "MGSO4": "MgSO4", "CASO4": "CaSO4",
}
#: Patterns of misreadings, in order.
MISREAD_PATTERNS = ((r"([A-Za-z])0([A-Za-z0-9])", "$1O$2"), (r"([A-Za-z])0$", "$1O"), (r"\bA[1I](?=[A-Z(])", "Al"), (r"\bA[1I]\b", "Al"), (r"(?<=[A-Z])C1(?=[0-9]|$|\))", "Cl"))
#: The largest subscript that is plausible, 10 for others; formulas that may exceed it.
MOST_ATOMS = {
    "H": 22, "C": 12, "N": 10, "O": 12, "S": 4, "Cl": 6, "F": 6, "Br": 3, "I": 3, "Na": 3, "K": 4, "Ca": 3, "Mg": 3, "Al": 4, "Fe": 4, "Cu": 4, "Zn": 4, "Mn": 2, "Cr": 2, "Pb": 2, "Ag": 1, "Ba": 1,
}
LARGE_FORMULAS = ("K4Fe(CN)6", "K3Fe(CN)6", "K2Fe(CN)6", "Fe(CN)6", "C12H22O11", "C6H12O6", "C2H5OH", "CH3COOH")
#: Words that stand for a formula.
PLACEHOLDERS = ("salt", "gas", "precipitate", "water", "acid", "base", "product", "mendapan", "garam", "asid", "bes", "larutan", "hasil")


def corrected_formula(formula: Column) -> Column:
    """A misread formula as it should be: by the table, else by the patterns."""
    table = F.create_map(*(F.lit(x) for pair in MISREAD.items() for x in pair))
    out = formula
    for pattern, by in MISREAD_PATTERNS:
        out = F.regexp_replace(out, pattern, by)
    return F.coalesce(F.try_element_at(table, formula), out)


def impossible_count(formula: Column, counts: Column) -> Column:
    """Whether an element occurs more often than is plausible; counts: formula_counts of the formula."""
    most = F.create_map(*(F.lit(x) for pair in MOST_ATOMS.items() for x in pair))
    over = F.exists(F.map_entries(counts), lambda e: e["value"] > F.coalesce(F.try_element_at(most, e["key"]), F.lit(10)))
    return F.coalesce(~formula.isin(*LARGE_FORMULAS) & over, F.lit(False))


def balanced(text: Column) -> Column:
    """Whether parentheses close in order: no prefix has more closing than opening ones, and the whole as many."""
    steps = F.transform(F.regexp_extract_all(text, F.lit("[()]"), F.lit(0)), lambda p: F.when(p == "(", 1).otherwise(-1))
    depth = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit(0).alias("least")), lambda a, s: F.struct((a["at"] + s).alias("at"), F.least(a["least"], a["at"] + s).alias("least")))
    return (depth["at"] == 0) & (depth["least"] == 0)


def formula_rules(formula: Column, counts: Column, field: str = "formula") -> list[Rule]:
    """counts: formula_counts of the corrected formula."""
    fixed = corrected_formula(formula)
    return [
        ("critical", "FORMULA_EMPTY", "the formula is missing", field, formula.isNull() | (formula == "")),
        ("warning", "FORMULA_OCR_CORRECTED", "the formula looks misread and was corrected", field, fixed != formula),
        ("critical", "FORMULA_ANOMALOUS_COUNT", "an element occurs too often", field, impossible_count(fixed, counts)),
        ("critical", "FORMULA_BAD_START", "a formula starts with a capital letter", field, (formula != "") & ~fixed.rlike("^[0-9]*[A-Z]")),
        ("critical", "FORMULA_UNBALANCED_PARENS", "parentheses do not match", field, ~balanced(fixed)),
        ("warning", "FORMULA_UNKNOWN_ELEMENT", "an element is not in the table", field, balanced(fixed) & fixed.rlike("^[0-9]*[A-Z]") & counts.isNull()),
    ]


def equation_rules(equation: Column, sides: Column, field: str = "equation") -> list[Rule]:
    """sides: equation_sides of the equation."""
    plain = F.regexp_replace(equation, "→|⇌|⟶|=>", "->")
    parts = F.split(plain, "->", 2)
    left, right = F.trim(parts[0]), F.trim(F.try_element_at(parts, F.lit(2)))
    arrow = F.contains(plain, F.lit("->"))
    word = lambda side: F.exists(F.split(side, r"\+"), lambda t: F.lower(F.trim(F.regexp_replace(t, r"^\s*[0-9]+\s*", ""))).isin(*PLACEHOLDERS))
    return [
        ("critical", "EQUATION_EMPTY", "the equation is missing", field, equation.isNull() | (equation == "")),
        ("critical", "EQUATION_NO_ARROW", "the equation has no arrow", field, (equation != "") & ~arrow),
        ("critical", "EQUATION_EMPTY_LHS", "nothing stands before the arrow", field, arrow & (left == "")),
        ("critical", "EQUATION_EMPTY_RHS", "nothing stands after the arrow", field, arrow & (right == "")),
        ("critical", "EQUATION_UNBALANCED_PARENS", "parentheses do not match", field, arrow & (~balanced(left) | ~balanced(right))),
        ("warning", "EQUATION_PLACEHOLDER_WORD", "a word stands for a formula", field, arrow & (word(left) | word(right))),
        ("warning", "EQUATION_UNREADABLE", "a species cannot be read", field, arrow & (left != "") & (right != "") & sides.isNull()),
    ]


#: Fixed values: (fields, code below the range, least, whether the least itself is out, code above, most, severity above).
RANGES = (
    (("mass_g", "given_mass_g"), "NEGATIVE_MASS", 0, False, "LARGE_MASS", 10_000, "warning"),
    (("volume_cm3", "V2", "known_volume_cm3", "unknown_volume_cm3", "given_volume_cm3"), "NEGATIVE_VOLUME", 0, False, "LARGE_VOLUME", 10_000, "warning"),
    (("volume_dm3",), "NEGATIVE_VOLUME_DM3", 0, False, "LARGE_VOLUME_DM3", 10, "warning"),
    (("molarity", "M1", "M2", "known_molarity", "unknown_molarity"), "NEGATIVE_MOLARITY", 0, False, "HIGH_MOLARITY", 20, "warning"),
    (("moles",), "NEGATIVE_MOLES", 0, False, "LARGE_MOLES", 500, "warning"),
    (("ph",), "INVALID_PH", 0, False, "INVALID_PH", 14, "critical"),
    (("poh",), "INVALID_POH", 0, False, "INVALID_POH", 14, "critical"),
    (("h_plus",), "NON_POSITIVE_H_CONC", 0, True, "HIGH_H_CONC", 20, "warning"),
    (("oh_minus", "oh_conc"), "NON_POSITIVE_OH_CONC", 0, True, None, None, None),
    (("specific_heat",), "NON_POSITIVE_SPECIFIC_HEAT", 0, True, "HIGH_SPECIFIC_HEAT", 100, "warning"),
)


def range_rules(columns: list[str]) -> list[Rule]:
    """Range checks of those fields that a record has; a null field raises nothing."""
    out: list[Rule] = []
    for names, low, least, inclusive, high, most, severity in RANGES:
        for name in (n for n in names if n in columns):
            c = F.col(name)
            out.append(("critical", low, f"{name} is out of range", name, c <= least if inclusive else c < least))
            if high:
                out.append((severity, high, f"{name} is out of range", name, c > most))
    for name in (n for n in ("mass_g", "given_mass_g") if n in columns):
        out.append(("warning", "ZERO_MASS", f"{name} is zero", name, F.col(name) == 0))
    for name in (n for n in ("e0_cathode", "e0_anode") if n in columns):
        out.append(("warning", "EXTREME_ELECTRODE_POTENTIAL", f"{name} is beyond 10 V", name, F.abs(name) > 10))
    if "delta_h_kj_mol" in columns:
        out.append(("warning", "EXTREME_DELTA_H", "an enthalpy beyond 10000 kJ mol-1", "delta_h_kj_mol", F.abs("delta_h_kj_mol") > 10_000))
    return out


def task_rules() -> list[Rule]:
    """Checks that hold for one task. Records have all fields of evaluation."""
    task = F.col("task")
    percent = F.aggregate("abundances", F.lit(0.0), lambda s, x: s + x)
    return [
        ("critical", "GIVEN_IS_TARGET", "given and asked formula are the same", "target_formula", task.startswith("stoichiometry") & (F.col("given_formula") == F.col("target_formula"))),
        ("warning", "PERCENT_SUM", "percentages do not sum to 100", "abundances", (task == "ar_from_abundance") & percent.between(50, 200) & ~percent.between(95, 105)),
        ("critical", "TITRATION_VOLUME", "a titration needs a volume", "known_volume_cm3", task.startswith("titration") & (F.col("known_volume_cm3") <= 0)),
        ("warning", "ZERO_DELTA_T", "the temperature does not change", "temp_final", task.isin("calorimetry", "delta_h_from_calorimetry") & (F.col("temp_initial") == F.col("temp_final"))),
        ("warning", "CELL_SIGN", "the cell has no positive voltage", "e0_cathode", (task == "voltaic_cell") & (F.col("e0_cathode") <= F.col("e0_anode"))),
        ("warning", "NOT_A_DILUTION", "the diluted solution is stronger", "M2", (task == "dilution") & (F.col("M2") > F.col("M1"))),
    ]


FORMULA_FIELDS = ("formula", "given_formula", "target_formula", "species", "oxidant", "reductant")


def corrected_records(records: DataFrame) -> DataFrame:
    """records with every misread formula, also those of the list, as it should be."""
    out = records.withColumns({k: corrected_formula(F.col(k)) for k in FORMULA_FIELDS if k in records.columns})
    return out.withColumn("formulas", F.transform("formulas", corrected_formula)) if "formulas" in records.columns else out


def stated(rules: list[Rule], field: Column) -> list[Rule]:
    """Rules that hold only where the field has a text."""
    return [(severity, code, message, name, (field != "") & when) for severity, code, message, name, when in rules]


def with_formula_issues(rows: DataFrame, formula: str) -> DataFrame:
    """rows with <formula>_issues; each distinct formula is read once."""

    def checked(each: DataFrame) -> DataFrame:
        read = each.withColumn("__counts", G.formula_counts(corrected_formula(F.col(formula))))
        found = issues(stated(formula_rules(F.col(formula), F.col("__counts"), formula), F.col(formula)))
        return read.select(formula, found.alias(f"{formula}_issues"))

    return with_distinct(rows, [formula], checked, "formula-issues")


def with_equation_issues(rows: DataFrame, equation: str) -> DataFrame:
    """rows with <equation>_issues; each distinct equation is read once."""

    def checked(each: DataFrame) -> DataFrame:
        read = each.withColumn("__sides", G.equation_sides(F.col(equation)))
        found = issues(stated(equation_rules(F.col(equation), F.col("__sides"), equation), F.col(equation)))
        return read.select(equation, found.alias(f"{equation}_issues"))

    return with_distinct(rows, [equation], checked, "equation-issues")


def validated(records: DataFrame) -> DataFrame:
    """records with issues: formulas that they state, their equation, ranges of their fields, then checks of their task."""
    own = [k for k in FORMULA_FIELDS if k in records.columns]
    read = records.withColumns({f"__{k}": G.formula_counts(corrected_formula(F.col(k))) for k in own})
    found = [r for k in own for r in stated(formula_rules(F.col(k), F.col(f"__{k}"), k), F.col(k))]
    if "equation" in records.columns:
        read = read.withColumn("__equation", G.equation_sides(F.col("equation")))
        found += stated(equation_rules(F.col("equation"), F.col("__equation")), F.col("equation"))
    out = read.withColumn("issues", issues([*found, *range_rules(records.columns), *task_rules()]))
    return out.drop("__equation", *(f"__{k}" for k in own))


SIGNED = NUMBER.replace("([0-9]+", "([+-]?[0-9]+")
ANSWER_PATTERNS = {
    "ph": rf"(?i)pH\s*=\s*{SIGNED}", "poh": rf"(?i)pOH\s*=\s*{SIGNED}", "moles": rf"(?i)\bn\s*=\s*{SIGNED}\s*mol", "mass_g": rf"(?i)(?:Jisim|Mass)\s+\w+\s*=\s*{SIGNED}\s*g", "delta_h_kj_mol": rf"ΔH\s*=\s*{SIGNED}",
    "molarity": rf"(?i)Kemolaran\s+\w+\s*=\s*{SIGNED}", "volume_cm3": rf"(?i)(?:Isipadu|Volume)\s+\w+\s*=\s*{SIGNED}\s*cm",
}


def answer_issues(answers: DataFrame, text: str = "answer") -> DataFrame:
    """answers with issues from the ranges of the numbers that their text states."""
    kept = answers.columns
    read = answers.select("*", *(F.regexp_extract(text, p, 1).try_cast("double").alias(k) for k, p in ANSWER_PATTERNS.items() if k not in kept))
    return read.withColumn("issues", issues(range_rules(list(ANSWER_PATTERNS)))).select(*kept, "issues")
