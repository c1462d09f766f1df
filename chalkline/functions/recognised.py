"""Text that a recogniser made of an image: spelling of chemistry, labelled fields, numbers, and the kind of question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import contains_any, strip

# ---- Fixed values: corrections, in order

CORRECTIONS = (
    (r"\bAT\b", "ΔT"), (r"\bDT\b", "ΔT"), (r"\bAH\b", "ΔH"), (r"\bDH\b", "ΔH"),
    (r"(\d+)\s*0C\b", "$1°C"), (r"(\d+)\s*oC\b", "$1°C"),
    (r"\bH20\b", "H2O"), (r"\bNa0H\b", "NaOH"), (r"\bKMn04\b", "KMnO4"), (r"\bNaC1\b", "NaCl"), (r"\bCaC12\b", "CaCl2"), (r"\bFe203\b", "Fe2O3"),
    (r"\bCu0\b", "CuO"), (r"\bMg0\b", "MgO"), (r"\bZn0\b", "ZnO"),
    (r"\bA1\b(?=[A-Z0-9(])", "Al"), (r"\bA1C13\b", "AlCl3"), (r"\bA12O3\b", "Al2O3"),
    (r"\bHCL\b", "HCl"), (r"\bNACL\b", "NaCl"), (r"\bNAOH\b", "NaOH"), (r"\bH2S04\b", "H2SO4"),
    (r"\bH\s+2\s*O\b", "H2O"), (r"\bC\s*O\s*2\b", "CO2"), (r"\bN\s*H\s*3\b", "NH3"), (r"\bH\s*C\s*l\b", "HCl"), (r"\bN\s*a\s*O\s*H\b", "NaOH"),
    (r"\bmol\s*/\s*[lL]\b", "mol/dm3"), (r"\bmol\s*dm\s*-3\b", "mol/dm3"), (r"\bJg-1\b", "J g-1"), (r"\bkJmol-1\b", "kJ mol-1"),
    ("[→⟶⇒➔]", "->"), ("[⇌⇆]", "<->"),
)

#: Labels of each field.
LABELS = {
    "soalan": ("SOALAN", "QUESTION"),
    "pilihan": ("PILIHAN", "OPTIONS"),
    "data": ("DATA_NOMBOR", "DATA_NUMBERS", "DATA"),
    "formula_kimia": ("FORMULA_KIMIA", "FORMULA_CHEM"),
    "persamaan": ("PERSAMAAN_KIMIA", "EQUATION_CHEM"),
    "jenis": ("JENIS_PENGIRAAN", "CALCULATION_TYPE"),
}
#: How a number is written, by name; the first pattern of a name that gives a number wins.
DATA_PATTERNS = (
    ("volume_cm3", r"V(?:_\w+)?\s*=\s*([\d.]+)\s*cm"), ("volume_dm3", r"V(?:_\w+)?\s*=\s*([\d.]+)\s*dm"), ("molarity", r"M(?:_\w+|olarity)?\s*=\s*([\d.]+)"),
    ("delta_T", r"delta[_\s]?[Tt]\s*=\s*([+-]?[\d.]+)"), ("delta_T", r"[ΔδD][Tt]\s*=\s*([+-]?[\d.]+)"), ("Q_joules", r"Q\s*=\s*([\d.]+)\s*[Jj]"),
    ("delta_H", r"delta[_\s]?[Hh]\s*=\s*([+-]?[\d.]+)"), ("delta_H", r"[ΔδD][Hh]\s*=\s*([+-]?[\d.]+)"), ("E0", r"[Ee]0?[_\s]?\w*\s*=\s*([+-]?[\d.]+)\s*[Vv]"),
    ("c_specific_heat", r"[Cc]\s*=\s*([\d.]+)"), ("density", r"density\s*=\s*([\d.]+)"), ("density", r"ketumpatan\s*=\s*([\d.]+)"), ("Vm", r"[Vv]m\s*=\s*([\d.]+)"),
    ("pH", r"[Pp][Hh]\s*=\s*([\d.]+)"), ("mol", r"[Mm][Oo][Ll]\s*=\s*([\d.]+)"), ("jisim_g", r"jisim\s*=\s*([\d.]+)\s*g"), ("jisim_g", r"m\s*=\s*([\d.]+)\s*g"),
    ("volume_dm3", r"isipadu\s*=\s*([\d.]+)\s*dm"), ("volume_cm3", r"isipadu\s*=\s*([\d.]+)\s*cm"),
)
RELATIVE_MASS = r"(?iU)[Aa]r[_\s]?(\w+)\s*=\s*([\d.]+)"
#: What a clean question shows of the data, in order.
SHOWN = (("volume_cm3", "V=", "cm³"), ("volume_dm3", "V=", "dm³"), ("molarity", "M=", "mol/dm³"), ("delta_T", "ΔT=", "°C"), ("Q_joules", "Q=", "J"), ("delta_H", "ΔH=", "kJ/mol"), ("jisim_g", "m=", "g"))
NOTHING = ("TIADA", "NONE", "")
#: The solver's name for a recogniser's.
KINDS = {
    "stoich_mass": "stoichiometry", "stoich_mass_to_mass": "stoichiometry", "stoich_vol": "stoichiometry_vol", "stoich_mass_to_vol": "stoichiometry_vol", "stoich_vol_to_mass": "stoichiometry_vol_to_mass",
    "stoich_vol_to_vol": "stoichiometry_vol", "stoich_from_molarity": "stoichiometry_from_molarity", "thermochem_forward": "thermochemistry", "thermochem": "thermochemistry",
    "thermochem_reverse": "thermochemistry_reverse", "ph_from_h": "ph_calculation", "ph_from_oh": "ph_from_oh", "ph_calculation": "ph_calculation", "titration": "titration", "molarmass": "molar_mass",
    "molar_mass": "molar_mass", "empirical": "empirical_formula", "voltaic": "voltaic_cell", "voltaic_cell": "voltaic_cell", "rate": "rate_of_reaction", "rate_of_reaction": "rate_of_reaction", "teori": "theory", "theory": "theory",
}
#: Words that tell the kind of a question, in order; all groups of an entry must have a word.
KIND_WORDS = (
    ("voltaic_cell", (("keupayaan sel", "cell potential", "e0", "e⁰", "voltaic", "sel voltaik"),)),
    ("thermochemistry", (("entalpi", "enthalpy", "haba tindak", "heat of", "suhu naik", "suhu turun", "temperature rise", "temperature drop", "q = mc", "muatan haba"),)),
    ("titration", (("meneutralkan", "neutralis", "titrat", "buret"),)),
    ("ph_from_oh", (("oh-", "oh⁻", "hidroksida", "hydroxide"), ("ph",))),
    ("ph_calculation", (("ph",), ("hitung", "nilai", "calculate"))),
    ("empirical_formula", (("formula empirik", "empirical formula", "komposisi", "composition"),)),
    ("molar_mass", (("jisim molar", "relative molecular mass", "jisim atom relatif", "jmr"),)),
    ("rate_of_reaction", (("kadar tindak balas", "rate of reaction"),)),
    ("stoichiometry", (("→", "->", "dihasilkan", "produced", "terbakar", "burnt"),)),
    ("concentration", (("kepekatan", "kemolaran", "molarity", "concentration"),)),
)


def corrected(text: Column) -> Column:
    """Chemistry as it should be spelt, by CORRECTIONS in order."""
    for pattern, by in CORRECTIONS:
        text = F.regexp_replace(text, f"(?U){pattern}", by)
    return text


def labelled(text: Column) -> dict[str, Column]:
    """The text of each field of LABELS, empty without one. Lines without a label go on from the line above; a label that comes again starts anew."""
    lines = F.array_join(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != ""), "\n")
    for field, labels in LABELS.items():
        lines = F.regexp_replace(lines, rf"(?im)^(?:{'|'.join(labels)}):", f"\u0001{field}\u0002")
    parts = F.transform(F.split(lines, "\u0001"), lambda p: F.split(p, "\u0002", 2))

    def last(field: str) -> Column:
        own = F.try_element_at(F.filter(parts, lambda p: (F.size(p) == 2) & (p[0] == field)), F.lit(-1))
        return F.coalesce(strip(F.array_join(F.transform(F.split(own[1], "\n"), strip), " ")), F.lit(""))

    return {field: last(field) for field in LABELS}


def _map(keys: Column, values: Column, first: bool) -> Column:
    """A map of parallel arrays in which the first or the last of equal keys counts."""
    if not first:
        keys, values = F.reverse(keys), F.reverse(values)
    own = F.array_distinct(keys)
    return F.map_from_arrays(own, F.transform(own, lambda k: values[(F.array_position(keys, k) - 1).cast("int")]))


def options(text: Column) -> Column:
    """Choices by letter; no choice has one of the letters A to D in it."""
    pattern = r"([A-D])[.)]\s*([^A-D]*?)(?=\s*[A-D][.)]|$)"
    letters, words = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.when(F.upper(text).isin(*NOTHING), F.map_from_arrays(*[F.expr("cast(array() as array<string>)")] * 2)).otherwise(_map(letters, F.transform(words, strip), first=False))


def data_numbers(text: Column) -> Column:
    """Numbers by name: those of DATA_PATTERNS, then any other name=number under its name in small letters."""
    typed: dict[str, Column] = {}
    for name, pattern in DATA_PATTERNS:
        own = F.regexp_extract(text, f"(?iU){pattern}", 1).try_cast("double")
        typed[name] = F.coalesce(typed[name], own) if name in typed else own
    entries = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in typed.items())), lambda e: e["value"].isNotNull())
    keys, values = (F.regexp_extract_all(text, F.lit(r"(?U)(\w+)\s*=\s*([+-]?[\d.]+)"), F.lit(i)) for i in (1, 2))
    others = F.filter(F.zip_with(keys, values, lambda k, v: F.struct(F.lower(k).alias("key"), v.try_cast("double").alias("value"))), lambda e: e["value"].isNotNull() & (e["key"] != "ar"))
    every = F.concat(entries, others)
    none = F.expr("cast(array() as array<struct<key:string,value:double>>)")
    every = F.when(F.upper(text).isin(*NOTHING), none).otherwise(every)
    return _map(F.transform(every, lambda e: e["key"]), F.transform(every, lambda e: e["value"]), first=True)


def relative_masses(text: Column) -> Column:
    """Relative atomic masses given in the data, by element; the last of an element counts."""
    keys, values = (F.regexp_extract_all(text, F.lit(RELATIVE_MASS), F.lit(i)) for i in (1, 2))
    return _map(keys, F.transform(values, lambda v: v.try_cast("double")), first=False)


def formulas(text: Column) -> Column:
    tokens = F.filter(F.split(text, r"[,;\s]+"), lambda t: t.rlike(r"^[A-Z][a-zA-Z0-9()._·•]+$"))
    return F.when(F.upper(text) == "TIADA", F.expr("cast(array() as array<string>)")).otherwise(tokens)


def kind_by_words(question: Column) -> Column:
    """The kind of a question by its words, theory if none tells."""
    q, out = F.lower(question), F.lit("theory")
    for kind, groups in reversed(KIND_WORDS):
        fits = contains_any(q, groups[0])
        for words in groups[1:]:
            fits = fits & contains_any(q, words)
        out = F.when(fits, kind).otherwise(out)
    return out


def question_kind(named: Column, question: Column) -> Column:
    """The solver's name for the kind that the recogniser named; by words if it is none of KINDS."""
    table = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(strip(named))), kind_by_words(question))


def clean_question(question: Column, equation: Column, data: Column) -> Column:
    """Question, equation and main data in one line; what is empty, and numbers that are 0, are left out."""

    def part(name: str, head: str, unit: str) -> Column:
        v = F.try_element_at(data, F.lit(name))
        return F.when(v != 0, F.concat(F.lit(head), v.cast("string"), F.lit(unit)))

    shown = F.concat_ws(", ", *(part(*x) for x in SHOWN))
    return F.concat_ws(
        " | ", F.when(question != "", question), F.when(equation != "", F.concat(F.lit("Persamaan: "), equation)), F.when(shown != "", F.concat(F.lit("Data: "), shown))
    )


def parse_recognised(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with soalan, pilihan, data, ar_override, formula_kimia, persamaan, soalan_type and clean_question. A null text is empty."""
    own = labelled(F.coalesce(F.col(text), F.lit("")))
    out = rows.withColumns({f"__{k}": c for k, c in own.items()})
    equation = F.when(F.upper("__persamaan").isin(*NOTHING), "").otherwise(F.col("__persamaan"))
    out = out.withColumns(
        {
            "soalan": F.col("__soalan"), "pilihan": options(F.col("__pilihan")), "data": data_numbers(F.col("__data")), "ar_override": relative_masses(F.col("__data")), "formula_kimia": formulas(F.col("__formula_kimia")),
            "persamaan": equation, "soalan_type": question_kind(F.col("__jenis"), F.col("__soalan")),
        }
    )
    out = out.withColumn("clean_question", clean_question(F.col("soalan"), F.col("persamaan"), F.col("data")))
    return out.drop(*(f"__{k}" for k in own))
