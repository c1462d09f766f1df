"""More named queries with their SQL: evaluators, units, formulas, extraction, validation, lookups and message texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import formulas as G
from ..functions import messages as M
from ..functions import numbers as N
from ..functions import registry
from ..functions import text as T
from ..operators import lookups, validation
from .catalogue import query, read, read_wide

KEYS = ("l_orderkey", "l_linenumber")


def sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql_nest(call: str, inner: str, pairs) -> str:
    """call(call(inner, a1, b1), a2, b2) ..."""
    return reduce(lambda own, p: f"{call}({own}, {sql_text(p[0])}, {sql_text(p[1])})", pairs, inner)


def choose(values: list[str]) -> Column:
    """One of the values by the row's keys."""
    return F.array(*map(F.lit, values))[((F.col("l_orderkey") + F.col("l_linenumber")) % len(values)).cast("int")]


def sql_choose(values: list[str]) -> str:
    return "([" + ", ".join(map(sql_text, values)) + f"])[(l_orderkey + l_linenumber) % {len(values)} + 1]"


# ---- evaluators: a quantity, b discount * 100, c tax * 100, p price / 1000; even lines have what odd ones lack

VM = "(CASE WHEN l_linenumber % 3 = 0 THEN 22.4::DOUBLE ELSE 24.0::DOUBLE END)"
VOLUME = "(CASE WHEN even THEN b ELSE p / 1000 END)"


#: Sums and quotients of decimals end in ties of the sixth place; this far off, both sides round alike.
TIE = 3e-8


def over(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0)"


def log_of(x: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN -log10({x}) END)"


#: task -> its value in SQL
EVALUATED = {
    "jmr": "c", "moles_from_mass": over("a", "c"), "mass_from_moles": "b * c", "moles_multi": f"{over('a', 'b')} + {over('p', 'c')}", "poh_from_oh": log_of("b"), "oh_from_poh": "pow(10, -b)", "h_from_ph": "pow(10, -b)",
    "ph_from_poh": f"14 - CASE WHEN even THEN b ELSE {log_of('a')} END", "concentration_g_dm3": over("a", VOLUME), "molarity_from_mass": over(over("a", "c"), VOLUME), "mass_from_molarity": f"b * {VOLUME} * c",
    "titration_find_volume": over("b * a * CASE WHEN even THEN c ELSE 1 END", "c"),
    "titration_find_molarity": over(f"coalesce(CASE WHEN even THEN {over('a', 'c')} END, b * a / 1000) * CASE WHEN even THEN c ELSE 1 END", "p / 1000"),
    "rate_from_points": over("a - b", "p - c"), "thermochemistry_type": "sign(c - b)", "delta_h_from_calorimetry": f"-({over(f'a * {L.WATER_HEAT} * (c - b)', 'b')}) / 1000", "redox_change": "sign(c - b)", "voltaic_cell": "b - c",
    "subatomic": "a - b", "oxidation_number": over("b - a", "c"), "ar_from_abundance": over("a * b + p * c", "b + c"), "molarity_from_delta_h": over(over(f"(a + p) * CASE WHEN even THEN c ELSE 1 END * {L.WATER_HEAT} * b / 1000", "abs(c)"), "a / 1000"),
    "stoichiometry_mass_to_mass": f"{over('a', 'b')} * (CASE WHEN even THEN c END) * p", "stoichiometry_mass_to_volume": f"{over('a', 'b')} * (CASE WHEN even THEN c END) * {VM}", "stoichiometry_volume_to_mass": f"a / 1000 / {VM} * (CASE WHEN even THEN c END) * p",
    "particles_from_volume": f"{VOLUME} / {VM} * {L.AVOGADRO}", "particles_from_mass": f"{over('a', 'c')} * {L.AVOGADRO}", "mass_from_volume": f"{VOLUME} / {VM} * c", "volume_from_mass": f"{over('a', 'c')} * {VM}", "volume_from_mass_via_moles": f"{over('a', 'c')} * {VM}",
}
LI = "SELECT *, l_quantity::DOUBLE AS a, round(l_discount * 100) AS b, round(l_tax * 100) AS c, l_extendedprice::DOUBLE / 1000 AS p, l_linenumber % 2 = 0 AS even FROM lineitem"


def _sql_evaluated() -> str:
    cases = " ".join(f"WHEN {sql_text(t)} THEN {f'({e}) / 1e20' if t.startswith('particles') else e}" for t, e in EVALUATED.items())
    return f"""WITH li AS ({LI}), t AS (SELECT *, {sql_choose(list(EVALUATED))} AS task FROM li), v AS (SELECT *, CASE task {cases} END AS v FROM t)
SELECT l_orderkey, l_linenumber, task, round(v + {TIE}, 6) + 0.0 AS value, CASE WHEN v IS NULL THEN 'undefined' ELSE 'ok' END AS status FROM v"""


def _quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_wide(spark, sf_dir, "lineitem")
    a, b, c, p = F.col("l_quantity").cast("double"), F.round(F.col("l_discount") * 100), F.round(F.col("l_tax") * 100), F.col("l_extendedprice").cast("double") / 1000
    return li.select(*KEYS, a.alias("a"), b.alias("b"), c.alias("c"), p.alias("p"), (F.col("l_linenumber") % 2 == 0).alias("even"))


@query(_sql_evaluated())
def q58_evaluate_other_tasks(spark, sf_dir):
    a, b, c, p, even = (F.col(x) for x in ("a", "b", "c", "p", "even"))
    has = lambda x: F.when(even, x)
    fields = {
        "mass_g": a, "given_mass_g": a, "given_volume_cm3": a, "volume_dm3": has(b), "volume_cm3": p, "moles": b, "molarity": b, "m_formula": c, "m_given": b, "m_target": p, "ratio": has(c), "oh_minus": b, "poh": b, "ph": b, "oh_conc": a,
        "known_molarity": b, "known_volume_cm3": a, "unknown_molarity": c, "known_mass_g": has(a), "m_known": c, "unknown_volume_cm3": p, "value1": b, "value2": a, "time1": c, "time2": p, "temp_initial": b, "temp_final": c, "before_ox": b,
        "after_ox": c, "e0_cathode": b, "e0_anode": c, "A": a, "Z": b, "charge": b, "known_sum": a, "target_count": c, "volume1_cm3": a, "volume2_cm3": p, "density": has(c), "delta_t": b, "delta_h_kj_mol": c,
        "masses": F.array(a, p), "m_formulas": F.array(b, c), "isotope_masses": F.array(a, p), "abundances": F.array(b, c), "condition": F.when(F.col("l_linenumber") % 3 == 0, "STP"),
    }
    rows = _quantities(spark, sf_dir).withColumn("task", choose(list(EVALUATED)))
    # hydroxide stands in only where there is no pOH
    rows = rows.select(*KEYS, "task", *(F.when((F.col("task") == "ph_from_poh") & ~even, None).otherwise(b).alias(k) if k == "poh" else v.alias(k) for k, v in fields.items()))
    v = F.col("answer_value")
    return N.evaluate(rows).select(*KEYS, "task", (F.round(F.when(F.col("task").startswith("particles"), v / 1e20).otherwise(v) + TIE, 6) + 0.0).alias("value"), "status")


@query(f"""WITH li AS ({LI})
SELECT l_orderkey, l_linenumber, round(a / 1000, 9) AS dm3, round(p * 1000, 6) AS cm3, round(b / 1000, 9) AS g, round(c * 1000, 6) AS kg, round(a / 1000, 9) AS kj, round(b * 1000, 6) AS j, c - b AS change, {VM} AS vm,
  CASE WHEN l_linenumber % 3 = 0 THEN 'STP' ELSE 'RTP' END AS label, CASE l_linenumber % 4 WHEN 0 THEN b::INT WHEN 1 THEN -b::INT WHEN 2 THEN 1 ELSE 0 END AS charge FROM li""")
def q59_units(spark, sf_dir):
    a, b, c, p = (F.col(x) for x in ("a", "b", "c", "p"))
    n, condition = F.col("l_linenumber") % 4, F.when(F.col("l_linenumber") % 3 == 0, "stp").when(F.col("l_linenumber") % 3 == 1, "room")
    species = F.when(n == 0, F.concat(F.lit("Fe"), b.cast("int"), F.lit("+"))).when(n == 1, F.concat(F.lit("SO4^"), b.cast("int"), F.lit("-"))).when(n == 2, "Na+").otherwise("Ne")
    return _quantities(spark, sf_dir).select(
        *KEYS, F.round(N.cm3_to_dm3(a), 9).alias("dm3"), F.round(N.dm3_to_cm3(p), 6).alias("cm3"), F.round(N.mg_to_g(b), 9).alias("g"), F.round(N.kg_to_g(c), 6).alias("kg"), F.round(N.j_to_kj(a), 9).alias("kj"), F.round(N.kj_to_j(b), 6).alias("j"),
        N.temperature_change(b, c).alias("change"), N.molar_volume(condition).alias("vm"), N.condition_label(condition).alias("label"), N.species_charge(species).cast("int").alias("charge"),
    )


# ---- formulas and equations

MASS = {e: L.ATOMIC_MASS[e] for e in ("H", "C", "O", "N", "Ca", "Al", "S", "Na")}


@query(f"""WITH li AS (SELECT *, l_partkey % 9 + 2 AS n, l_suppkey % 7 + 2 AS m, l_linenumber % 4 AS kind FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE kind WHEN 0 THEN n * {MASS["C"]} + m * {MASS["H"]} + {MASS["O"]} WHEN 1 THEN {MASS["Ca"]} + n * ({MASS["O"]} + {MASS["H"]}) WHEN 2 THEN 2 * {MASS["Al"]} + n * ({MASS["S"]} + m * {MASS["O"]}) END, 4)::DOUBLE AS mass,
  CASE kind WHEN 0 THEN 1 WHEN 1 THEN n WHEN 2 THEN n * m END AS oxygen,
  round(CASE kind WHEN 0 THEN n * {MASS["C"]} / (n * {MASS["C"]} + m * {MASS["H"]} + {MASS["O"]}) END, 6)::DOUBLE AS carbon,
  n || 'H2 + O2 -> ' || m || 'H2O' AS equation, n AS hydrogen, m AS water, round(m / n::DOUBLE, 6) AS ratio FROM li""")
def q60_formulas_and_equations(spark, sf_dir):
    li = read_wide(spark, sf_dir, "lineitem")
    n, m, kind = F.col("l_partkey") % 9 + 2, F.col("l_suppkey") % 7 + 2, F.col("l_linenumber") % 4
    cat = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v for v in x))
    formula = F.when(kind == 0, cat("C", n, "H", m, "O")).when(kind == 1, cat("Ca(OH)", n)).when(kind == 2, cat("Al2(SO", m, ")", n)).otherwise("Xx2")
    rows = li.select(*KEYS, formula.alias("formula"), cat(n, "H2 + O2 -> ", m, "H2O").alias("equation"), n.alias("n"), m.alias("m"))
    rows = rows.select("*", G.formula_counts(F.col("formula")).alias("counts"), G.equation_sides(F.col("equation")).alias("sides"))
    mass, known = G.molar_mass(F.col("counts")), G.masses_by_element()
    carbon = F.try_divide(F.try_element_at(F.col("counts"), F.lit("C")) * F.try_element_at(known, F.lit("C")), mass)
    hydrogen, water = F.col("sides.reactants")["H2"], F.col("sides.products")["H2O"]
    return rows.select(
        *KEYS, F.round(mass, 4).alias("mass"), F.try_element_at(F.col("counts"), F.lit("O")).cast("long").alias("oxygen"), F.round(carbon, 6).alias("carbon"), "equation", hydrogen.cast("long").alias("hydrogen"), water.cast("long").alias("water"),
        F.round(N.ratio(water, hydrogen), 6).alias("ratio"),
    )


# ---- extraction


@query("""WITH li AS (SELECT *, l_quantity::INT AS q, l_partkey % 90 + 1 AS v, l_suppkey % 60 + 1 AS w, l_linenumber AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, [q::DOUBLE, (w / 1000.0)::DOUBLE] AS masses, [v::DOUBLE, (v + 1)::DOUBLE] AS cm3, [(n + 0.5)::DOUBLE] AS dm3, [n::DOUBLE, w::DOUBLE] AS moles, [n::DOUBLE, w::DOUBLE] AS molarities, [q::DOUBLE, (q + v)::DOUBLE] AS temps, [v::DOUBLE, 3.0] AS times,
  (n + 0.25)::DOUBLE AS ph, (v + 0.5)::DOUBLE AS poh, CASE WHEN n % 3 = 0 THEN 'STP' WHEN n % 3 = 1 THEN 'RTP' END AS condition FROM li""")
def q61_extract_quantities(spark, sf_dir):
    li = read_wide(spark, sf_dir, "lineitem")
    q, v, w, n = F.col("l_quantity").cast("int"), F.col("l_partkey") % 90 + 1, F.col("l_suppkey") % 60 + 1, F.col("l_linenumber")
    cat = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    quantities = cat("Jisim ", q, " g dan ", w, " mg, ", v, " cm3 atau ", v + 1, " ml, gas ", n, ".5 dm3")
    solutions = cat(n, " mol dm-3 HCl dan ", w, " mol dm-3 NaOH")
    rest = cat("suhu ", q, " °C hingga ", q + v, "C selama ", v, " s dan 3 min, pH = ", n, ".25, pOH ", v, ".5", F.when(n % 3 == 0, " pada STP").when(n % 3 == 1, " pada keadaan bilik").otherwise(""))
    # the texts stand in columns of their own, or each pattern would put them together anew
    li = li.select(*KEYS, quantities.alias("quantities"), solutions.alias("solutions"), rest.alias("rest"))
    quantities, solutions, rest = F.col("quantities"), F.col("solutions"), F.col("rest")
    return li.select(
        *KEYS, T.masses(quantities).alias("masses"), T.volumes_cm3(quantities).alias("cm3"), T.volumes_dm3(quantities).alias("dm3"), T.moles(solutions).alias("moles"), T.molarities(solutions).alias("molarities"), T.temperatures(rest).alias("temps"),
        T.times(rest).alias("times"), T.ph(rest).alias("ph"), T.poh(rest).alias("poh"), T.gas_condition(rest).alias("condition"),
    )


# ---- validation

#: A formula as stated, and the codes of its issues.
STATED = (
    ("NaOH", ""), ("H20", "FORMULA_OCR_CORRECTED"), ("Fe2(S04)3", "FORMULA_OCR_CORRECTED"), ("C6H12O6", ""), ("C20H2", "FORMULA_ANOMALOUS_COUNT"), ("naCl", "FORMULA_BAD_START"), ("Ca(OH", "FORMULA_UNBALANCED_PARENS"), ("Xx2", "FORMULA_UNKNOWN_ELEMENT"),
    ("(OH", "FORMULA_BAD_START,FORMULA_UNBALANCED_PARENS"), ("Na)OH(", "FORMULA_UNBALANCED_PARENS"), ("AgCl", ""),
)
EQUATIONS = (
    ("2H2 + O2 -> 2H2O", ""), ("2H2 + O2", "EQUATION_NO_ARROW"), ("-> H2O", "EQUATION_EMPTY_LHS"), ("H2 + O2 ->", "EQUATION_EMPTY_RHS"), ("Ca(OH -> CaO", "EQUATION_UNBALANCED_PARENS,EQUATION_UNREADABLE"), ("NaOH + HCl → NaCl + H2O", ""),
    ("2 acid + NaOH -> garam", "EQUATION_PLACEHOLDER_WORD,EQUATION_UNREADABLE"),
)


def _sql_codes() -> str:
    formula = "CASE " + sql_choose([f for f, _ in STATED]) + " " + " ".join(f"WHEN {sql_text(f)} THEN {sql_text(codes)}" for f, codes in STATED) + " END"
    equation = "CASE " + sql_choose([e for e, _ in EQUATIONS]) + " " + " ".join(f"WHEN {sql_text(e)} THEN {sql_text(codes)}" for e, codes in EQUATIONS) + " END"
    return f"""WITH c AS (SELECT l_orderkey, l_linenumber, list_filter(string_split({formula} || ',' || {equation}, ','), lambda x: x <> '') AS codes FROM lineitem)
SELECT l_orderkey, l_linenumber, array_to_string(list_sort(codes), ',') AS codes FROM c"""


@query(_sql_codes())
def q62_validate_formulas_and_equations(spark, sf_dir):
    li = read_wide(spark, sf_dir, "lineitem").select(*KEYS, choose([f for f, _ in STATED]).alias("formula"), choose([e for e, _ in EQUATIONS]).alias("equation"))
    found = validation.with_equation_issues(validation.with_formula_issues(li, "formula"), "equation")
    return found.select(*KEYS, F.array_join(F.array_sort(F.concat("formula_issues.code", "equation_issues.code")), ",").alias("codes"))


#: field -> (condition in SQL of a value v, code)
BOUNDS = {
    **{f: (("v < 0", "NEGATIVE_MASS"), ("v > 10000", "LARGE_MASS"), ("v = 0", "ZERO_MASS")) for f in ("mass_g", "given_mass_g")},
    **{f: (("v < 0", "NEGATIVE_VOLUME"), ("v > 10000", "LARGE_VOLUME")) for f in ("volume_cm3", "V2", "known_volume_cm3", "unknown_volume_cm3", "given_volume_cm3")},
    "volume_dm3": (("v < 0", "NEGATIVE_VOLUME_DM3"), ("v > 10", "LARGE_VOLUME_DM3")), **{f: (("v < 0", "NEGATIVE_MOLARITY"), ("v > 20", "HIGH_MOLARITY")) for f in ("molarity", "M1", "M2", "known_molarity", "unknown_molarity")},
    "moles": (("v < 0", "NEGATIVE_MOLES"), ("v > 500", "LARGE_MOLES")), "ph": (("v < 0 OR v > 14", "INVALID_PH"),), "poh": (("v < 0 OR v > 14", "INVALID_POH"),), "h_plus": (("v <= 0", "NON_POSITIVE_H_CONC"), ("v > 20", "HIGH_H_CONC")),
    **{f: (("v <= 0", "NON_POSITIVE_OH_CONC"),) for f in ("oh_minus", "oh_conc")}, "specific_heat": (("v <= 0", "NON_POSITIVE_SPECIFIC_HEAT"), ("v > 100", "HIGH_SPECIFIC_HEAT")),
    **{f: (("abs(v) > 10", "EXTREME_ELECTRODE_POTENTIAL"),) for f in ("e0_cathode", "e0_anode")}, "delta_h_kj_mol": (("abs(v) > 10000", "EXTREME_DELTA_H"),),
}
VALUE = "(l_extendedprice::DOUBLE / 3 - 300) / (CASE l_linenumber % 3 WHEN 0 THEN 1 WHEN 1 THEN 100 ELSE 3000 END)"


def _sql_bounds() -> str:
    every = " UNION ALL ".join(f"SELECT {sql_text(f)} AS field, {sql_text(code)} AS code, count(*) AS n FROM v WHERE field = {sql_text(f)} AND ({when})" for f, own in BOUNDS.items() for when, code in own)
    return f"WITH v AS (SELECT {sql_choose(list(BOUNDS))} AS field, {VALUE} AS v FROM lineitem) SELECT * FROM ({every}) WHERE n > 0"


@query(_sql_bounds())
def q63_issues_of_every_field(spark, sf_dir):
    from ..operators.rules import issues

    li = read_wide(spark, sf_dir, "lineitem").select(choose(list(BOUNDS)).alias("field"), F.expr(VALUE.replace("::DOUBLE", "")).cast("double").alias("v"))
    records = li.select("field", *(F.when(F.col("field") == f, F.col("v")).alias(f) for f in BOUNDS))
    found = records.select("field", F.explode(issues(validation.range_rules(records.columns))).alias("issue"))
    return found.groupBy("field", F.col("issue.code").alias("code")).agg(F.count("*").alias("n"))


# ---- lookups and texts

NAMES = [*(f"notes/{k.lower()}_extra.md" for k, *_ in L.FILE_TOPICS), "BAB_3_unknown.md", "bab7.txt", "BAB_12.md", "other.md"]


def _topic_case(values: list, fallback: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(stem, {sql_text(k)}) THEN {'NULL' if v is None else sql_text(v) if isinstance(v, str) else v}" for (k, *_), v in zip(L.FILE_TOPICS, values, strict=True)) + f" ELSE {fallback} END"


@query(f"""WITH f AS (SELECT {sql_choose(NAMES)} AS name FROM lineitem), s AS (SELECT name, upper(regexp_replace(regexp_extract(name, '([^/]*)$', 1), '[.][^.]*$', '')) AS stem FROM f),
b AS (SELECT *, TRY_CAST(nullif(regexp_extract(stem, 'BAB_?([0-9]+)', 1), '') AS INT) AS bab FROM s),
t AS (SELECT {_topic_case([c for _, c, _, _ in L.FILE_TOPICS], 'bab')} AS chapter, {_topic_case([t for _, _, t, _ in L.FILE_TOPICS], 'CASE WHEN bab <= 5 THEN 4 WHEN bab > 5 THEN 5 END')} AS tingkatan, {_topic_case([n for *_, n in L.FILE_TOPICS], "''")} AS topic FROM b)
SELECT chapter::INT AS chapter, tingkatan::INT AS tingkatan, topic, count(*) AS n FROM t GROUP BY ALL""")
def q64_file_topics(spark, sf_dir):
    # few names are on many rows: they are counted first
    names = read(spark, sf_dir, "lineitem").groupBy(choose(NAMES).alias("name")).agg(F.count("*").alias("n"))
    return names.select(lookups.file_topic(F.col("name")).alias("t"), "n").groupBy("t.chapter", "t.tingkatan", "t.topic").agg(F.sum("n").alias("n"))


@query(f"""WITH li AS ({LI}), x AS (SELECT *, CASE l_linenumber % 4 WHEN 0 THEN a WHEN 1 THEN p / 7 WHEN 2 THEN a * 1000 + b ELSE b / 100000 END AS x FROM li)
SELECT l_orderkey, l_linenumber, CASE WHEN abs(x) >= 1e4 OR (abs(x) > 0 AND abs(x) < 1e-3) THEN format('{{:.3e}}', x) ELSE rtrim(rtrim(format('{{:.3f}}', x), '0'), '.') END AS number,
  repeat('█', least(10, floor(a / 4))::INT) || repeat('░', 10 - least(10, floor(a / 4))::INT) AS bar FROM x""")
def q65_number_texts(spark, sf_dir):
    n, a = F.col("l_linenumber") % 4, F.col("a")
    x = F.when(n == 0, a).when(n == 1, F.col("p") / 7).when(n == 2, a * 1000 + F.col("b")).otherwise(F.col("b") / 100000)
    return _quantities(spark, sf_dir).select(*KEYS, registry.fmt_num(x).alias("number"), M.percent_bar(a.cast("int"), F.lit(40)).alias("bar"))


@query(f"""SELECT doc_id, sha256(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped, sha256({sql_nest("replace", "text", T.ANSWER_PHRASES)}) AS english,
  substr(text, 1, 40) || CASE WHEN length(text) > 40 THEN '...' ELSE '' END AS preview FROM documents""")
def q66_message_texts(spark, sf_dir):
    text = F.col("text")
    return read_wide(spark, sf_dir, "documents").select(
        "doc_id", F.sha2(T.html_escape(text), 256).alias("escaped"), F.sha2(T.translate_answer(text, F.lit("EN")), 256).alias("english"), M.preview(text, 40).alias("preview")
    )
