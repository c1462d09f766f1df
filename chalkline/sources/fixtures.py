"""Literal tables that a user supplies as JSON lines: a bank of past questions and a library of diagram texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BANK = "exam_year int, chapter int, tingkatan int, topic string, subtopic string, question_type string, marks int, soalan string, jawapan string, keywords_bm array<string>, keywords_en array<string>, diagrams array<string>, ord int"
LIBRARY = "ord int, key string, description string"


def question_bank(spark: SparkSession, path: str) -> DataFrame:
    """Questions as documents.question_chunks takes them; ord is a question's place from 0."""
    return spark.read.schema(BANK).json(path)


def diagram_library(spark: SparkSession, path: str) -> DataFrame:
    """(ord, key, description): a small dimension table, keys in the order in which they are tried, each once."""
    rows = spark.read.schema(LIBRARY).json(path)
    first = W.partitionBy("key").orderBy("ord")
    return rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
