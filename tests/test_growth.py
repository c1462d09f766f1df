"""Work on repeated values is done once for each, and heavy expressions are evaluated once for a row."""

from pyspark.sql import functions as F

from chalkline.functions import text
from chalkline.operators import documents, lookups, validation
from chalkline.plans import catalogue_rules, retrieval


def plan(df) -> str:
    """The physical plan before it runs."""
    return df._jdf.queryExecution().sparkPlan().toString()


def test_equal_questions_are_solved_once(spark):
    asked = spark.range(3000).select("id", F.when(F.col("id") % 4 > 0, F.concat(F.lit("berapakah jisim "), F.col("id") % 4, F.lit(" mol NaCl"))).alias("question"))
    solved = retrieval.answers(asked)
    own = plan(solved)  # rows only meet the answers, without a shuffle and without Python
    assert "BroadcastHashJoin" in own and "Python" not in own and "InArrow" not in own
    assert {(r.q, r.n) for r in solved.groupBy(F.round("answer_value", 6).alias("q")).agg(F.count("*").alias("n")).collect()} == {(None, 750), (58.5, 750), (117.0, 750), (175.5, 750)}


def test_fields_of_asked_questions_count(spark):
    rows = [(1, "berapakah jisim 2 mol NaCl", 4.0), (2, "berapakah jisim 2 mol NaCl", -1.0), (3, "berapakah jisim 2 mol NaCl", None)]
    got = retrieval.answers(spark.createDataFrame(rows, "id int, question string, specific_heat double"))
    assert {r.id: r.answer_value for r in got.select("id", "answer_value").collect()} == {1: 117.0, 2: None, 3: 117.0}


def test_equal_formulas_and_equations_are_checked_once(spark):
    formula = F.element_at(F.array(*map(F.lit, ["NaOH", "H20", "Ca(OH", None])), (F.col("id") % 4 + 1).cast("int"))
    equation = F.element_at(F.array(*map(F.lit, ["2H2 + O2 -> 2H2O", "H2 + O2 ->"])), (F.col("id") % 2 + 1).cast("int"))
    rows = spark.range(400).select("id", formula.alias("formula"), equation.alias("equation"))
    found = validation.with_equation_issues(validation.with_formula_issues(rows, "formula"), "equation")
    own = plan(found)
    assert own.count("BroadcastHashJoin") == 2 and "Python" not in own
    codes = F.concat_ws(",", "formula_issues.code", "equation_issues.code").alias("codes")
    got = {(r.formula, r.codes): r.n for r in found.groupBy("formula", codes).agg(F.count("*").alias("n")).collect()}
    assert got == {("NaOH", ""): 100, ("H20", "FORMULA_OCR_CORRECTED,EQUATION_EMPTY_RHS"): 100, ("Ca(OH", "FORMULA_UNBALANCED_PARENS"): 100, (None, "EQUATION_EMPTY_RHS"): 100}


def test_a_file_name_is_cut_once(spark):
    names = spark.createDataFrame([("x/BAB_4_jadual_berkala_unsur_2.md",), ("bab_9.txt",), (None,)], "f string")
    topics = names.select(lookups.file_topic(F.col("f")).alias("t")).select("t.*")
    assert 1 <= plan(topics).count("[^/]*") <= 3  # once for each field at most, not for each key
    assert [tuple(r)[:2] for r in topics.collect()] == [(4, 4), (9, 5), (None, None)]


def test_file_names_are_counted_before_their_topics(spark):
    own = plan(catalogue_rules.q64_file_topics(spark, "/root/testdata/sf0.001"))
    assert own.count("HashAggregate") == 4  # by name, then by topic


def test_numbers_are_read_without_lambdas(spark):
    rows = spark.createDataFrame([("2 mol dm-3 HCl, 1 mol dm3 NaOH, 1.5 mol",), ("0.5 MOL dm−3",), ("suhu 25.5 °C",), (None,)], "t string")
    own = rows.select(*(f(F.col("t")).alias(f.__name__) for f in (text.moles, text.molarities, text.temperatures, text.times)))
    assert "lambda" not in plan(own)
    assert [tuple(r) for r in own.collect()] == [([2.0, 1.0, 1.5], [2.0, 1.0], [], []), ([0.5], [0.5], [], []), ([], [], [25.5], []), (None, None, None, None)]


def test_texts_of_quantities_are_put_together_once(spark):
    assert plan(catalogue_rules.q61_extract_quantities(spark, "/root/testdata/sf0.001")).count("concat(Jisim") <= 1


def test_markers_of_a_language_are_counted_once(spark):
    rows = spark.createDataFrame([("ialah yang untuk mass",), ("mass volume step ialah",), ("ialah mass",), (None,)], "t string")
    own = rows.select(text.language_by_markers(F.col("t")).alias("l"))
    assert plan(own).count("regexp_extract_all(") == 2
    assert [r.l for r in own.collect()][:3] == ["BM", "EN", "mixed"]


def test_lines_with_formulas_and_arrows(spark):
    rows = spark.createDataFrame([("H2O\n  NaCl \t\nNo formula\nKOH\u2028\n x",), ("2H2 + O2 -> 2H2O\nCaO",), ("plain",), (None,)], "t string")
    own = rows.select(documents.formula_candidates(F.col("t")).alias("f"), documents.equations(F.col("t")).alias("e"), documents.worked_example(F.col("t")).alias("w"))
    assert [(r.f, r.e, r.w) for r in own.collect()] == [(["H2O", "KOH\u2028", "NaCl"], [], False), (["2H2", "2H2O", "CaO", "O2"], ["2H2 + O2 -> 2H2O"], False), ([], [], False), (None, None, False)]
