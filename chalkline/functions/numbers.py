"""Units, and formula evaluation as columns: a value, its unit and a status, never an exception."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicons as L

# ---- units


def cm3_to_dm3(v: Column) -> Column:
    return v / 1000


def dm3_to_cm3(v: Column) -> Column:
    return v * 1000


def mg_to_g(m: Column) -> Column:
    return m / 1000


def kg_to_g(m: Column) -> Column:
    return m * 1000


def j_to_kj(q: Column) -> Column:
    return q / 1000


def kj_to_j(q: Column) -> Column:
    return q * 1000


def temperature_change(first: Column, last: Column) -> Column:
    return last - first


def in_dm3(dm3: Column, cm3: Column) -> Column:
    """A volume in dm3 from either; null if both are."""
    return F.coalesce(dm3.cast("double"), cm3.cast("double") / 1000)


def molar_volume(condition: Column) -> Column:
    """22.4 at standard conditions, else 24 dm3."""
    c = F.lower(F.coalesce(condition, F.lit("")))
    return F.when(c.isin("stp", "standard"), L.MOLAR_VOLUME_STANDARD).otherwise(L.MOLAR_VOLUME_ROOM)


def condition_label(condition: Column) -> Column:
    return F.when(molar_volume(condition) == L.MOLAR_VOLUME_STANDARD, "STP").otherwise("RTP")


def species_charge(species: Column) -> Column:
    """The charge that ends a species (2-, +, 3+), 0 without one."""
    size, sign = F.regexp_extract(species, r"\^?([0-9]*)([+-])$", 1), F.regexp_extract(species, r"\^?([0-9]*)([+-])$", 2)
    n = F.when(size == "", 1).otherwise(size.try_cast("int"))
    return F.when(sign == "+", n).when(sign == "-", -n).otherwise(0)


# ---- formulas


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def minus_log10(x: Column) -> Column:
    return F.when(x > 0, -F.log10(x))


def weighted_mean(values: Column, weights: Column) -> Column:
    """Sum of values times weights by the sum of weights."""
    total = F.aggregate(weights, F.lit(0.0), lambda s, w: s + w)
    return F.try_divide(F.aggregate(F.zip_with(values, weights, lambda v, w: v * w), F.lit(0.0), lambda s, x: s + x), total)


def whole_ratios(amounts: Column, tolerance: float = 0.15) -> Column:
    """Amounts by their least, as whole numbers; null if one is further than tolerance from whole."""
    scaled = F.transform(amounts, lambda a: F.try_divide(a, F.array_min(amounts)))
    off = F.exists(scaled, lambda s: F.abs(s - F.bround(s)) > tolerance)
    return F.when(~off, F.transform(scaled, lambda s: F.bround(s).cast("int")))


def sum_of_ratios(a: Column, b: Column) -> Column:
    """Sum of a[i] / b[i]; null if the lengths differ or a divisor is 0."""
    parts = F.zip_with(a, b, lambda x, y: F.try_divide(x, y))
    return F.when(F.size(a) == F.size(b), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x))


def _c(name: str) -> Column:
    return F.col(name).cast("double")


def _volume() -> Column:
    return in_dm3(F.col("volume_dm3"), F.col("volume_cm3"))


def _vm() -> Column:
    return molar_volume(F.col("condition"))


def _heat() -> Column:
    return _c("mass_g") * L.WATER_HEAT * F.abs(_c("temp_final") - _c("temp_initial"))


#: task -> (value, unit) over the fields of a task record. m_* are molar masses that the record was joined with.
EVALUATORS: dict[str, tuple[Callable[[], Column], str]] = {
    "jmr": (lambda: _c("m_formula"), "g mol-1"),
    "moles_from_mass": (lambda: ratio(_c("mass_g"), _c("m_formula")), "mol"),
    "moles_multi": (lambda: sum_of_ratios(F.col("masses"), F.col("m_formulas")), "mol"),
    "moles_from_volume": (lambda: ratio(_volume(), _vm()), "mol"),
    "particles_from_moles": (lambda: _c("moles") * L.AVOGADRO, "particles"),
    "volume_from_moles": (lambda: _c("moles") * _vm(), "dm3"),
    "mass_from_moles": (lambda: _c("moles") * _c("m_formula"), "g"),
    "particles_from_volume": (lambda: ratio(_volume(), _vm()) * L.AVOGADRO, "particles"),
    "particles_from_mass": (lambda: ratio(_c("mass_g"), _c("m_formula")) * L.AVOGADRO, "particles"),
    "mass_from_volume": (lambda: ratio(_volume(), _vm()) * _c("m_formula"), "g"),
    "volume_from_mass": (lambda: ratio(_c("mass_g"), _c("m_formula")) * _vm(), "dm3"),
    "stoichiometry_mass_to_mass": (lambda: ratio(_c("given_mass_g"), _c("m_given")) * _c("ratio") * _c("m_target"), "g"),
    "stoichiometry_mass_to_volume": (lambda: ratio(_c("given_mass_g"), _c("m_given")) * _c("ratio") * _vm(), "dm3"),
    "stoichiometry_volume_to_mass": (lambda: ratio(_c("given_volume_cm3") / 1000, _vm()) * _c("ratio") * _c("m_target"), "g"),
    "voltaic_cell": (lambda: _c("e0_cathode") - _c("e0_anode"), "V"),
    "molarity_from_delta_h": (
        lambda: ratio(
            ratio((_c("volume1_cm3") + _c("volume2_cm3")) * F.coalesce(_c("density"), F.lit(1.0)) * F.coalesce(_c("specific_heat"), F.lit(L.WATER_HEAT)) * _c("delta_t") / 1000, F.abs(_c("delta_h_kj_mol"))),
            _c("volume1_cm3") / 1000,
        ),
        "mol dm-3",
    ),
    "ar_from_abundance": (lambda: weighted_mean(F.col("isotope_masses"), F.col("abundances")), ""),
    "subatomic": (lambda: _c("A") - _c("Z"), "neutrons"),
    "concentration_g_dm3": (lambda: ratio(_c("mass_g"), _volume()), "g dm-3"),
    "molarity_from_mass": (lambda: ratio(ratio(_c("mass_g"), _c("m_formula")), _volume()), "mol dm-3"),
    "mass_from_molarity": (lambda: _c("molarity") * _volume() * _c("m_formula"), "g"),
    "dilution": (lambda: ratio(_c("M2") * _c("V2"), _c("M1")), "cm3"),
    "ph_from_h": (lambda: minus_log10(_c("h_plus")), "pH"),
    "h_from_ph": (lambda: F.pow(F.lit(10.0), -_c("ph")), "mol dm-3"),
    "poh_from_oh": (lambda: minus_log10(_c("oh_minus")), "pOH"),
    "oh_from_poh": (lambda: F.pow(F.lit(10.0), -_c("poh")), "mol dm-3"),
    "ph_from_poh": (lambda: 14 - F.coalesce(_c("poh"), minus_log10(_c("oh_conc"))), "pH"),
    "titration_find_volume": (lambda: ratio(_c("known_molarity") * _c("known_volume_cm3") * F.coalesce(_c("ratio"), F.lit(1.0)), _c("unknown_molarity")), "cm3"),
    "titration_find_molarity": (
        lambda: ratio(
            F.coalesce(ratio(_c("known_mass_g"), _c("m_known")), _c("known_molarity") * _c("known_volume_cm3") / 1000) * F.coalesce(_c("ratio"), F.lit(1.0)), _c("unknown_volume_cm3") / 1000
        ),
        "mol dm-3",
    ),
    "rate_average": (lambda: ratio(_c("change"), _c("time")), "per s"),
    "rate_from_points": (lambda: ratio(_c("value2") - _c("value1"), _c("time2") - _c("time1")), "per s"),
    "calorimetry": (_heat, "J"),
    "enthalpy": (lambda: -ratio(_c("Q_joule"), _c("moles")) / 1000, "kJ mol-1"),
    "thermochemistry_type": (lambda: F.signum(_c("temp_final") - _c("temp_initial")), "sign"),
    "delta_h_from_calorimetry": (lambda: -ratio(_c("mass_g") * L.WATER_HEAT * (_c("temp_final") - _c("temp_initial")), _c("moles")) / 1000, "kJ mol-1"),
    "oxidation_number": (lambda: ratio(_c("charge") - _c("known_sum"), _c("target_count")), ""),
    "redox_change": (lambda: F.signum(_c("after_ox") - _c("before_ox")), "sign"),
}
EVALUATORS["volume_from_mass_via_moles"] = EVALUATORS["volume_from_mass"]

#: Every field that an evaluator may read, with its type.
FIELDS = {
    **{n: "double" for n in (
        "mass_g given_mass_g given_volume_cm3 volume_dm3 volume_cm3 moles molarity M1 M2 V2 ph poh h_plus oh_minus oh_conc temp_initial temp_final Q_joule delta_t delta_h_kj_mol "
        "volume1_cm3 volume2_cm3 density specific_heat change time time1 value1 time2 value2 known_molarity known_volume_cm3 known_mass_g unknown_molarity unknown_volume_cm3 A Z "
        "charge before_ox after_ox e0_anode e0_cathode m_formula m_given m_target m_known ratio known_sum target_count"
    ).split()},
    **{n: "array<double>" for n in ("masses", "m_formulas", "isotope_masses", "abundances")},
    "condition": "string",
}


def empirical_text(elements: Column) -> Column:
    """The simplest formula from array of (el, mass); null if the amounts are not in whole ratios."""
    known = F.create_map(*(F.lit(x) for pair in L.ATOMIC_MASS.items() for x in pair))
    ratios = whole_ratios(F.transform(elements, lambda e: F.try_divide(e["mass"], F.try_element_at(known, e["el"]))))
    return F.array_join(F.zip_with(elements, ratios, lambda e, r: F.concat(e["el"], F.when(r > 1, r.cast("string")).otherwise(""))), "")


def evaluate(records: DataFrame, task: str = "task") -> DataFrame:
    """records with answer_value, answer_unit and status (ok, undefined, unknown_task). Fields that are missing are null."""
    missing = [F.lit(None).cast(kind).alias(name) for name, kind in FIELDS.items() if name not in records.columns]
    out = records.select("*", *missing)
    value = F.coalesce(*(F.when(F.col(task) == name, formula().cast("double")) for name, (formula, _) in EVALUATORS.items()))
    units = F.create_map(*(F.lit(x) for name, (_, unit) in EVALUATORS.items() for x in (name, unit)))
    known = F.coalesce(F.col(task).isin(*EVALUATORS), F.lit(False))
    out = out.select("*", value.alias("answer_value"), F.try_element_at(units, F.col(task)).alias("answer_unit"))
    return out.withColumn("status", F.when(~known, "unknown_task").when(F.col("answer_value").isNull() | F.isnan("answer_value"), "undefined").otherwise("ok"))
