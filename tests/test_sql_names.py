"""Functions and table functions by their SQL names."""

import pytest
from pyspark.errors import AnalysisException

from chalkline.functions import registry
from chalkline.operators import documents
from chalkline.plans.retrieval import hashed_embedder


@pytest.fixture(scope="module")
def sql(spark):
    registry.register(spark, hashed_embedder(8))
    files = [(f"f{i}.md", p, f"# H{i}\r\n" + f"alpha beta {i} {p} " * 15 + "\n---\nshort\n---\n" + "gamma delta " * 20, [i]) for i in range(6) for p in range(2)] + [("null.md", 0, None, None)]
    spark.createDataFrame(files, "source_file string, part int, text string, tags array<int>").createOrReplaceTempView("files")
    return spark.sql


def test_scalar_names(sql):
    row = sql("""SELECT parse_formula('H2SO4') AS c, molar_mass('H2O') AS m, molar_mass('xx') AS bad, extract_valid_formulas('mass of NaOH and H2SO4') AS f,
      extract_equation('Given 2H2 + O2 -> 2H2O') AS e, fmt_num(0.5) AS n, fmt_num(CAST(NULL AS DOUBLE)) AS nothing, size(embed('a b')) AS d, parse_equation('2H2 + O2 -> 2H2O').products AS p""").first()
    assert row.c == {"H": 2, "S": 1, "O": 4} and abs(row.m - 18) < 0.1 and row.bad is None and row.f == ["NaOH", "H2SO4"]
    assert row.e == "2H2 + O2 -> 2H2O" and row.n == "0.5" and row.nothing is None and row.d == 8 and row.p == {"H2O": 2}


def test_chunk_markdown_keeps_columns_and_equals_the_operator(spark, sql):
    got = sql("SELECT * FROM chunk_markdown(TABLE(SELECT * FROM files WHERE part = 0), 100)")
    assert got.columns == ["source_file", "part", "tags", "idx", "heading_h1", "heading_h2", "heading_h3", "content"]
    plain = documents.chunk_markdown(spark.table("files").where("part = 0"), 100).select("source_file", "idx", "heading_h1", "content")
    assert sorted(map(tuple, got.select("source_file", "idx", "heading_h1", "content").collect())) == sorted(map(tuple, plain.collect())) != []


def test_parts_of_a_file_are_numbered_on(sql):
    got = sql("SELECT source_file, part, idx FROM chunk_markdown(TABLE(files) PARTITION BY source_file ORDER BY part)").collect()
    by_file = {}
    for r in sorted(got, key=lambda r: (r.source_file, r.part, r.idx)):
        by_file.setdefault(r.source_file, []).append(r.idx)
    assert len(by_file) == 6 and all(ids == list(range(len(ids))) and len(ids) > 2 for ids in by_file.values())


@pytest.mark.parametrize("wrong", ["chunk_markdown('x')", "chunk_markdown(TABLE(SELECT 1 AS a))", "chunk_markdown(TABLE(SELECT 's' AS source_file, 't' AS text, 1 AS idx))"])
def test_analyze_says_what_is_wrong(sql, wrong):
    with pytest.raises(AnalysisException):
        sql(f"SELECT * FROM {wrong}").collect()
