"""Operators that SQL cannot check, on small hand-made inputs with values worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from chalkline.functions import confidence, formulas, messages, numbers, questions, text
from chalkline.operators import documents, lookups, memory, quotas, validation, vectors
from chalkline.plans import retrieval
from chalkline.sources import markdown, tables
from chalkline.streaming import state


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


# ---- documents

MARKDOWN = """intro before any heading, long enough to be kept as a chunk of its own

# BAB 3: Mol
## 3.1 Konsep
Keywords: mol, jisim molar, mol
short
---
A longer block about the amount of substance that has far more than one hundred and fifty characters, so that it stands as a chunk by itself and takes the short block before it with it. ![a pic](images/rajah_mol.png)
### Contoh
diberi: 5 g
---
pengiraan: n = m / M
---
CaCO3 -> CaO + CO2 (s) and some words
| a | b |
"""


def test_chunks(spark):
    files = spark.createDataFrame([("BAB_3_KONSEP_MOL.md", MARKDOWN.replace("\n", "\r\n")), ("empty.md", ""), ("none.md", None), ("tiny.md", "too short")], "source_file string, text string")
    got = documents.tag(documents.chunk_markdown(files)).orderBy("idx").collect()
    assert [(c.heading_h1, c.heading_h2, c.heading_h3) for c in got] == [("", "", ""), ("BAB 3: Mol", "3.1 Konsep", ""), ("BAB 3: Mol", "3.1 Konsep", "Contoh")]
    assert got[1].chunk_id == "bab_3_konsep_mol__31_konsep__0001"
    assert got[1].content.startswith("Keywords: mol, jisim molar, mol\nshort\n\nA longer")
    assert got[1].keywords_bm == ["mol", "jisim molar"] and got[1].keywords_en == ["mole", "molar mass", "mass"]
    assert [(d.alt, d.path) for d in got[1].diagrams] == [("a pic", "images/rajah_mol.png")]
    assert got[2].content.split("\n\n---\n\n")[0] == "diberi: 5 g" and got[2].has_table and got[2].equations == ["CaCO3 -> CaO + CO2 (s) and some words"]
    assert got[2].formulas == ["CO2", "CaCO3", "CaO"]
    assert (got[2].chapter, got[2].tingkatan, got[2].subtopic, got[1].subtopic) == (3, 4, "Contoh", "Konsep")
    assert got[1].embed_text.startswith("Tajuk: BAB 3: Mol > 3.1 Konsep\n\nTopik: Konsep Mol, Formula & Persamaan Kimia\n\nKata kunci: mol, jisim molar, mole, molar mass, mass\n\n")


def test_no_text_is_lost():
    rng = random.Random(1)
    for _ in range(200):
        lines = [rng.choice(["# head", "## two", "### three", "---", "", "word one two", "diberi: x", "## Soalan 3", "text " * 40]) for _ in range(rng.randrange(30))]
        body = [x for x in lines if x.strip() and x != "---" and not x.startswith("#")]
        out = [x for c in documents.chunks_of("\n".join(lines)) for x in c[3].split("\n") if x.strip() and x != "---"]
        assert [x.strip() for x in out] == [x.strip() for x in body]


def test_markdown_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.md").write_bytes(b"x\r\ny ![p](q/rajah_1.png)")
    (tmp_path / "a.md").write_text("![first](q/rajah_1.png) ![n](z.png)")
    (tmp_path / "c.txt").write_text("no")
    files = markdown.read_markdown(spark, str(tmp_path))
    assert {r.source_file: r.text for r in files.collect()} == {"b.md": "x\ny ![p](q/rajah_1.png)", "a.md": "![first](q/rajah_1.png) ![n](z.png)"}
    assert sorted((r.path, r.alt, r.source_file) for r in markdown.diagram_references(files).collect()) == [("q/rajah_1.png", "first", "a.md"), ("z.png", "n", "a.md")]
    assert one(spark, documents.diagram_stem(F.col("p")), p="images/Rajah_Sel.png") == "sel"


def test_lookups(spark):
    assert tuple(one(spark, lookups.file_topic(F.col("f")), f="x/bab_9_lain.md")) == (9, 5, "")
    assert tuple(one(spark, lookups.file_topic(F.col("f")), f="nothing")) == (None, None, "")
    refs = spark.createDataFrame([("sel",), ("sel_kimia_2",), ("zzz",)], "stem string")
    library = spark.createDataFrame([(0, "sel_kimia", "near"), (1, "sel", "exact")], "ord int, key string, description string")
    assert {r.stem: r.description for r in lookups.described(refs, library).collect()} == {"sel": "exact", "sel_kimia_2": "near", "zzz": None}


# ---- formulas and questions


def test_formulas():
    assert formulas.parse_formula("K4[Fe(CN)6]") == {"K": 4, "Fe": 1, "C": 6, "N": 6}
    assert formulas.parse_formula("CuSO4·5H2O") == {"Cu": 1, "S": 1, "O": 9, "H": 10}
    assert formulas.parse_formula("SO4^2-") == {"S": 1, "O": 4} and formulas.parse_formula("NH4+") == {"N": 1, "H": 4}
    assert formulas.parse_formula("2HCl(aq)") == {"H": 1, "Cl": 1}
    for bad in ("", "Xx", "Ca(OH", "H)2", "3"):
        with pytest.raises(formulas.Unreadable):
            formulas.parse_formula(bad)
    assert formulas.parse_equation("2H2 + O2 → 2H2O(l)") == ({"H2": 2, "O2": 1}, {"H2O": 2})


def test_formula_columns(spark):
    rows = spark.createDataFrame([("K4Fe(CN)6", "Zn + 2HCl -> ZnCl2 + H2"), ("bad", "no arrow"), (None, None)], "f string, e string")
    counts, sides = formulas.formula_counts(F.col("f")), formulas.equation_sides(F.col("e"))
    got = rows.select(formulas.molar_mass(counts).alias("m"), formulas.formula_text(counts).alias("t"), formulas.species_ratio(sides, F.lit("HCl"), F.lit("H2")).alias("r")).collect()
    assert [(r.m, r.t, r.r) for r in got] == [(368.0, "C6FeK4N6", 0.5), (None, None, None), (None, None, None)]
    assert one(spark, formulas.salt_of(F.col("a"), F.col("b")), a="NaOH", b="HCl") == "NaCl + H2O"


ANSWERS = [
    ("Berapakah bilangan mol dalam 11.2 g Fe?", "moles_from_mass", 0.2),
    ("Hitungkan bilangan mol 4.7 g K2O", "moles_from_mass", 0.05),
    ("Apakah JMR K4Fe(CN)6?", "jmr", 368),
    ("5.6 g N2 dan 3.2 g O2, jumlah mol?", "moles_multi", 0.3),
    ("Isipadu 0.5 mol gas pada RTP", "volume_from_moles", 12),
    ("volume of 0.5 mol gas at STP", "volume_from_moles", 11.2),
    ("4 g H2, 2H2 + O2 -> 2H2O, berapakah jisim H2O terhasil?", "stoichiometry_mass_to_mass", 36),
    ("5 g CaCO3 -> CaO + CO2, berapakah isipadu CO2 pada RTP?", "stoichiometry_mass_to_volume", 1.2),
    ("Zn E0 = -0.76 V, Cu E0 = +0.34 V, berapakah voltan sel?", "voltaic_cell", 1.1),
    ("pH asid dengan [H+] = 0.01 mol dm⁻³", "ph_from_h", 2),
    ("25 cm3 0.1 mol dm-3 NaOH dititrat dengan 0.2 mol dm-3 HCl", "titration_find_volume", 12.5),
    ("Tentukan nombor pengoksidaan Mn dalam KMnO4", "oxidation_number", 7),
    ("Isotop Cl-35 (75%) dan Cl-37 (25%), jisim atom relatif?", "ar_from_abundance", 35.5),
    ("nombor proton Z = 11, nombor nukleon A = 23, bilangan neutron?", "subatomic", 12),
    ("2H2 + O2 - Hitungkan", "unknown", None),
    (None, "unknown", None),
]


def test_questions_end_to_end(spark):
    asked = spark.createDataFrame([(i, q) for i, (q, _, _) in enumerate(ANSWERS)], "id int, question string")
    got = {r.id: r for r in retrieval.solve(asked).select("id", "task", "answer_value", "status").collect()}
    for i, (_, task, value) in enumerate(ANSWERS):
        assert got[i].task == task
        assert got[i].answer_value is None if value is None else abs(got[i].answer_value - value) < 1e-9


def test_evaluators(spark):
    nine = {"volume1_cm3": 25.0, "volume2_cm3": 25.0, "delta_t": 7.0, "delta_h_kj_mol": -57.3}
    rows = spark.createDataFrame([("molarity_from_delta_h", *nine.values())], "task string, " + ", ".join(f"{k} double" for k in nine))
    assert abs(numbers.evaluate(rows).first()["answer_value"] - 1.026) < 1e-3
    parts = F.array(F.struct(F.lit("C").alias("el"), F.lit(40.0).alias("mass")), F.struct(F.lit("H").alias("el"), F.lit(6.7).alias("mass")), F.struct(F.lit("O").alias("el"), F.lit(53.3).alias("mass")))
    assert one(spark, numbers.empirical_text(parts)) == "CH2O"
    options = F.array(*(F.struct(F.lit(a).alias("letter"), F.lit(f).alias("formula"), F.lit(4.8).alias("volume_dm3")) for a, f in (("A", "Ne"), ("D", "CO2"))))
    counts = F.array(F.create_map(F.lit("Ne"), F.lit(1)), F.create_map(F.lit("C"), F.lit(1), F.lit("O"), F.lit(2)))
    assert one(spark, formulas.gas_with_atoms(options, counts, F.lit(0.6), F.lit(4.8), F.lit(24.0)))["formula"] == "CO2"


def test_text(spark):
    assert one(spark, text.normalise_question(F.col("q")), q=" 2 × 10^-3 mol dm⁻³  [Fe=56] H₂ → x") == "2e-3 mol dm3 H2 -> x"
    assert one(spark, text.augment_query(F.col("q")), q="haba") == "haba heat thermochemistry termokimia"
    assert one(spark, questions.from_recognised(F.col("q")), q="SOALAN: jisim relatif X?\nPILIHAN: A. 141 B. 256\nDATA: [H=1]") == "jisim relatif X? [H=1]"


# ---- quality


def test_validation(spark):
    assert one(spark, validation.corrected_formula(F.col("f")), f="Fe203") == "Fe2O3" and one(spark, validation.corrected_formula(F.col("f")), f="NaC1") == "NaCl"
    assert one(spark, validation.balanced(F.col("f")), f="Ca(OH)2") and not one(spark, validation.balanced(F.col("f")), f=")(")
    from chalkline.operators.rules import issues, summary

    rows = spark.createDataFrame([(-1.0, 15.0), (0.0, 14.0), (20000.0, None)], "mass_g double, ph double").withColumn("i", issues(validation.range_rules(["mass_g", "ph"])))
    assert [[i.code for i in r.i] for r in rows.collect()] == [["NEGATIVE_MASS", "INVALID_PH"], ["ZERO_MASS"], ["LARGE_MASS"]]
    assert [r.s for r in rows.select(summary(F.col("i")).alias("s")).collect()] == ["2 critical", "1 warning", "1 warning"]
    eq = spark.createDataFrame([("",), ("H2 O2",), ("-> H2O",), ("acid + Zn -> salt",), ("2H2 + O2 -> 2H2O",)], "e string")
    found = eq.withColumn("i", issues(validation.equation_rules(F.col("e"), formulas.equation_sides(F.col("e"))))).collect()
    assert [[i.code for i in r.i] for r in found] == [["EQUATION_EMPTY"], ["EQUATION_NO_ARROW"], ["EQUATION_EMPTY_LHS"], ["EQUATION_PLACEHOLDER_WORD", "EQUATION_UNREADABLE"], []]
    answer = spark.createDataFrame([("pH = 15.2\nJisim NaOH = -3 g",)], "answer string")
    assert [i.code for i in validation.answer_issues(answer).first().issues] == ["NEGATIVE_MASS", "INVALID_PH"]


def test_confidence(spark):
    assert one(spark, confidence.confidence(F.col("t")), t="   ") == 0.0
    # base .5, length +.05, words +.15, formulas +.10, measures +.10, calculation +.05, but a long lower-case word -.20
    assert one(spark, confidence.confidence(F.col("t")), t="Hitungkan mol asid 5 g NaOH dalam 2 dm3 H2SO4") == 0.75
    assert one(spark, confidence.tier(F.lit(0.45))) == "medium"


def test_messages(spark):
    assert [messages.number_text(x) for x in (12.0, 0.125, 12345.678, 0.0005, 0.0, -1.5)] == ["12", "0.125", "1.235e+04", "5.000e-04", "0", "-1.5"]
    long = "para one " * 300 + "\n\n" + "para two " * 300
    parts = list(messages.pieces(long, 3000))
    assert all(len(p) <= 3000 for p in parts) and " ".join(parts).split() == long.split()
    assert one(spark, messages.four_sections(F.array(F.lit("a")), F.expr("cast(array() as array<string>)"), F.array(F.lit("b"), F.lit("c")), F.array(F.lit("d")))) == "Diberi:\na\n\nPengiraan:\nb\nc\n\nJawapan:\nd"
    assert [r.part for r in messages.split_message(F.lit("ab cd"), F.lit(3)).collect()] == ["ab", "cd"]


# ---- retrieval and state


def test_index_and_retrieval(spark, tmp_path):
    files = spark.createDataFrame([("mol_calculations.md", "# A\n" + "alpha beta gamma delta " * 10), ("BAB_4_POLIMER.md", "# B\n" + "polimer monomer ikatan rantai " * 10)], "source_file string, text string")
    embed = retrieval.hashed_embedder(64)
    path = str(tmp_path / "index")
    tables.write_index(retrieval.build_index(files, embed), path)
    tables.write_index(retrieval.build_index(files, embed, tables.read_index(spark, path).select("sha", "embedding")), path + "2")
    index = tables.read_index(spark, path + "2")
    assert index.count() == 2 and set(r.index_name for r in index.collect()) == {"index_calculations", "index_theory"}
    asked = spark.createDataFrame([(1, "terangkan polimer monomer"), (2, "hitung alpha beta")], "query_id long, query string")
    got = retrieval.retrieve(asked, index, embed, threshold=0.1)
    assert [(r.query_id, r.rank, r.index_name) for r in got.orderBy("query_id", "rank").collect()] == [(1, 1, "index_theory"), (2, 1, "index_calculations")]
    assert retrieval.contexts(got).count() == 2 and retrieval.preview(got).count() == 2


def test_search_edges(spark):
    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [1.0, 0.0])], "pos long, embedding array<float>")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert [(r.pos, r.score) for r in vectors.top_k(asked, index, 10).orderBy("rank_in_group").collect()] == [(1, 1.0), (5, 1.0), (2, 0.0)]
    assert [r.pos for r in vectors.top_k(asked, index, 1, threshold=1.0).collect()] == [1]
    assert vectors.top_k(asked.limit(0), index, 3).count() == 0 and vectors.top_k(asked, index.limit(0), 3).count() == 0


def test_upserts(spark):
    table = spark.createDataFrame([("a", 1, 5), ("b", 1, 7)], "k string, at int, hits int")
    changes = spark.createDataFrame([("a", 2, 0), ("c", 1, 1)], table.schema)
    assert sorted(map(tuple, memory.upsert(table, changes, "k", "at").collect())) == [("a", 2, 0), ("b", 1, 7), ("c", 1, 1)]
    assert sorted((r.k, r.hits) for r in memory.increment(table, changes, "k", "hits").collect()) == [("a", 5), ("b", 7)]
    assert memory.is_personal is not None and one(spark, memory.is_personal(F.col("q")), q="What you SAID earlier")


@pytest.fixture(scope="module")
def calls(spark):
    rng = random.Random(2)
    rows, t = [], 0
    for i in range(400):
        t += rng.randrange(1, 40)
        rows.append((i, f"u{rng.randrange(3)}", t, rng.choice(["ok", "5xx", "5xx", "limited"])))
    return rows


def test_folds_against_a_loop(spark, calls):
    df = spark.createDataFrame(calls, "event_id long, user_id string, us long, outcome string")
    last, expected = {}, {}
    for i, u, t, _ in calls:
        expected[i] = u not in last or t - last[u] >= 60
        if expected[i]:
            last[u] = t
    assert {r.event_id: r.allowed for r in quotas.cooldown(df, 60).collect()} == expected
    got = {r.event_id: (r.allowed, r.state) for r in quotas.breaker(df, failures=2, reset=100, key="user_id").collect()}
    states, expected = {}, {}
    for i, u, t, o in calls:
        states[u], ok, name = quotas.breaker_step(states.get(u, ("closed", 0, 0)), t, o, 2, 100)
        expected[i] = (ok, name)
    assert got == expected and {s for _, s in got.values()} == {"closed", "open"}


def test_breaker_lets_one_probe_through():
    step = lambda s, t, o: quotas.breaker_step(s, t, o, 2, 100)
    s, ok, name = step(("closed", 0, 0), 0, "5xx")
    s, ok, name = step(s, 1, "5xx")
    assert name == "open"
    assert step(s, 50, "ok")[1:] == (False, "open")
    assert step(s, 101, "limited")[1:] == (True, "open") and step(s, 101, "ok")[1:] == (True, "closed")


def test_streams_equal_batches(spark, calls, tmp_path):
    schema = "event_id long, user_id string, us long, outcome string"
    for k in range(0, 400, 100):
        spark.createDataFrame(calls[k : k + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = spark.createDataFrame(calls, schema)
    pairs = [
        ("cooldown", lambda df: state.cooldown(df, 60), quotas.cooldown(batch, 60)),
        ("rate", lambda df: state.rate_limit(df, 2, 90), quotas.rate_limit(batch, 2, 90)),
        ("breaker", lambda df: state.breaker(df, failures=2, reset=100, key="user_id"), quotas.breaker(batch, failures=2, reset=100, key="user_id")),
    ]
    for name, stream, expected in pairs:
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = stream(source).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, expected.collect()))


def test_logs(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:00:00", "INFO", "m", "x", 5), ("2024-01-01 00:00:01", "ERROR", None, "y", 7)], "ts string, level string, msg string, event string, elapsed_ms int")
    tables.write_log(rows, str(tmp_path / "log"))
    back = tables.read_log(spark, str(tmp_path / "log"))
    assert sorted(r.ts for r in back.collect()) == ["2024-01-01T00:00:00.000Z", "2024-01-01T00:00:01.000Z"]
    assert {r.event: r.mean_ms for r in tables.latency_by_event(back).collect()} == {"x": 5.0, "y": 7.0}
