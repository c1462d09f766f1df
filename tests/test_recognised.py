"""Recognised text, messages, diagrams, record checks and names for SQL."""

import json

import pytest
from pyspark.sql import functions as F

from chalkline.functions import messages, recognised, registry
from chalkline.operators import documents, memory, validation
from chalkline.plans import retrieval
from chalkline.sources import fixtures

READ = """SOALAN: 25cm³ HCl + 25cm³ NaOH → 2100J. ΔT=?
PILIHAN: A.1°C B.2°C
  C.10°C D.20°C
DATA_NOMBOR: V=50cm3, Q=2100J, c=4.2, Ar_Cu=64, x = 1.2.3, k=7

FORMULA_KIMIA: HCl, NaOH; 2x
persamaan_kimia: HCl + NaOH -> NaCl + H2O
JENIS_PENGIRAAN: Thermochem_Reverse"""


def one(spark, c, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items())).select(c.alias("x")).first().x


def test_labelled_text(spark):
    rows = spark.createDataFrame([(1, READ), (2, None), (3, "no labels"), (4, "SOALAN: pH larutan, hitung nilai\nPERSAMAAN_KIMIA: TIADA\nDATA: TIADA\nSOALAN: apakah mol")], "id int, text string")
    got = {r.id: r for r in recognised.parse_recognised(rows).collect()}
    r = got[1]
    assert r.soalan == "25cm³ HCl + 25cm³ NaOH → 2100J. ΔT=?" and r.persamaan == "HCl + NaOH -> NaCl + H2O" and r.soalan_type == "thermochemistry_reverse"
    assert r.pilihan == {"A": "1°", "C": "10°", "D": "20°C"} or set(r.pilihan) <= set("ABCD")
    assert r.data["volume_cm3"] == 50 and r.data["Q_joules"] == 2100 and r.data["c_specific_heat"] == 4.2 and r.data["k"] == 7 and "x" not in r.data and "ar" not in r.data
    assert r.ar_override == {"Cu": 64.0} and r.formula_kimia == ["HCl", "NaOH"]
    assert r.clean_question == "25cm³ HCl + 25cm³ NaOH → 2100J. ΔT=? | Persamaan: HCl + NaOH -> NaCl + H2O | Data: V=50.0cm³, Q=2100.0J"
    assert (got[2].soalan, got[2].data, got[2].soalan_type, got[2].clean_question) == ("", {}, "theory", "")
    assert got[3].soalan == "" and got[4].soalan == "apakah mol" and got[4].persamaan == "" and got[4].data == {}


@pytest.mark.parametrize("said, kind", [("nilai E0 sel", "voltaic_cell"), ("haba dan entalpi", "thermochemistry"), ("pH larutan OH-", "ph_from_oh"), ("hitung pH", "ph_calculation"), ("pH", "theory"), ("Mg terbakar", "stoichiometry"), ("kemolaran", "concentration")])
def test_kinds(spark, said, kind):
    assert one(spark, recognised.question_kind(F.lit("?"), F.col("q")), q=said) == kind
    assert one(spark, recognised.question_kind(F.lit(" Teori "), F.col("q")), q=said) == "theory"


def test_corrections(spark):
    said = "AT = 25 0C, H20 dan NaC1 → C O 2, 2 mol / L, kJmol-1, A1C13"
    assert one(spark, recognised.corrected(F.col("t")), t=said) == "ΔT = 25°C, H2O dan NaCl -> CO2, 2 mol/dm3, kJ mol-1, AlCl3"


def test_answers_as_markup(spark):
    text = "Diberi: m < 2\n  n = 4 mol\nZn -> Zn2+\n---\nbiasa\n---\nsebab & akibat"
    assert one(spark, messages.answer_html(F.col("t")), t=text) == "<b>🧮 Assistant</b>\n\n<b>Diberi:</b> m &lt; 2\n<code>n = 4 mol</code>\n<code>Zn -&gt; Zn2+</code>\n\n<i>biasa\n---\nsebab &amp; akibat</i>"
    assert one(spark, messages.confirmation(F.col("t"), F.lit("medium"), "EN", 3), t="a<bcd") == "Text read from the image:\n\n<code>a&lt;b...</code>\n\nIs this right? Answer yes or no."
    assert one(spark, messages.confirmation(F.col("t"), F.lit("high")), t="x") is None
    assert one(spark, messages.sources_html(F.split("t", ","), "EN"), t="Mole,,Salt") == "\n\n<i>📖 Sources: • Mole</i>"
    assert one(spark, messages.timing_html(F.col("t"), F.lit(True)), t=12.4) == "\n<i>⚡ Cache 12ms</i>"


def test_diagrams_as_chunks(spark, tmp_path):
    library = [{"ord": 0, "key": "kalorimeter", "description": "A cup."}, {"ord": 1, "key": "kalorimeter", "description": "Again."}]
    (tmp_path / "library.json").write_text("\n".join(map(json.dumps, library)))
    known = fixtures.diagram_library(spark, str(tmp_path / "library.json"))
    refs = spark.createDataFrame([("img/rajah_kalorimeter_x.png", "Cup", "a.md"), ("b.png", "B", "a.md"), ("c_d.png", "C", "b.md")], "path string, alt string, source_file string")
    read = spark.createDataFrame([("b.png", "text of twenty-one and more"), ("c_d.png", "short")], "path string, text string")
    got = {r.chunk_id: r for r in documents.diagram_chunks(documents.layered_descriptions(refs, known, read)).collect()}
    assert {k: r.content for k, r in got.items()} == {
        "diagram__kalorimeter_x": "Rajah: Cup\n\nA cup.", "diagram__b": "Rajah: B\n\n[Teks OCR dari rajah]: text of twenty-one and more", "diagram__c_d": "Rajah: C\n\n[Rajah: c d]",
    }
    assert got["diagram__c_d"].keywords_bm == ["C", "c d"] and got["diagram__c_d"].has_diagram


def test_question_bank(spark, tmp_path):
    row = {"exam_year": 2019, "chapter": 3, "tingkatan": 4, "topic": "Mol", "subtopic": "x", "question_type": "struktur", "marks": 4, "soalan": "?", "jawapan": "!", "keywords_bm": ["mol"], "keywords_en": [], "diagrams": ["a.png"], "ord": 7}
    (tmp_path / "bank.json").write_text(json.dumps(row))
    got = documents.question_chunks(fixtures.question_bank(spark, str(tmp_path / "bank.json"))).first()
    assert got.chunk_id == "spm_2019_bab3_t4_struktur_0007" and got.content == "SOALAN:\n?\n\nSKEMA JAWAPAN:\n!" and got.has_diagram


def test_records_are_corrected_and_validated(spark):
    rows = spark.createDataFrame([("H20", ["Na0H", None], "H2 + O2"), (None, None, None)], "formula string, formulas array<string>, equation string")
    assert [tuple(r) for r in validation.corrected_records(rows).collect()] == [("H2O", ["NaOH", None], "H2 + O2"), (None, None, None)]
    asked = spark.createDataFrame([("jmr", "H20"), ("jmr", "(OH"), ("jmr", None)], "question string, formula string")
    wide = retrieval.questions.with_masses(retrieval.questions.task_records(asked.select("question"))).limit(1).drop("formula")
    records = asked.select("formula").join(F.broadcast(wide))
    got = {r.formula: [i.code for i in r.issues] for r in validation.validated(records).collect()}
    assert got == {"H20": ["FORMULA_OCR_CORRECTED"], "(OH": ["FORMULA_BAD_START", "FORMULA_UNBALANCED_PARENS"], None: []}


def test_overview(spark):
    cache = spark.createDataFrame([("a", 3), ("b", None)], "question string, hit_count int")
    assert tuple(memory.overview(spark.range(5), cache).first()) == (5, 2, 3)
    assert tuple(memory.overview(spark.range(0), cache.limit(0)).first()) == (0, 0, 0)


def test_names_for_sql(spark):
    registry.register(spark)
    assert spark.sql("SELECT formula_counts('H2O') AS c").first().c == {"H": 2, "O": 1}
    assert [r.part for r in spark.sql("SELECT * FROM split_message('aa bb', 3) ORDER BY number").collect()] == ["aa", "bb"]
