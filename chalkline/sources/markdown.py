"""Whole-file readers of Markdown, one row for each file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold_newlines


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(name: Column) -> Column:
    """A file name without its last suffix."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def read_markdown(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """(source_file, text) of all matching files below folder, newlines folded. Unreadable files are skipped."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("ignoreCorruptFiles", True)
    files = reader.text(folder, wholetext=True)
    return files.select(file_name(F.col("_metadata.file_path")).alias("source_file"), fold_newlines(F.col("value")).alias("text"))


def read_past_papers(chunks: DataFrame) -> DataFrame:
    """Chunks of past papers: their type is fixed, and the first four digits of the file's stem, if any, are the year."""
    year = F.regexp_extract(stem(F.col("source_file")), r"([0-9]{4})", 1).try_cast("int")
    return chunks.withColumn("content_type", F.lit("qa_scheme")).withColumn("exam_year", F.coalesce(year, F.col("exam_year")))


def diagram_references(files: DataFrame) -> DataFrame:
    """(path, alt, source_file): every image reference, each path once, where it is first by file and place."""
    alt, path = (F.regexp_extract_all("text", F.lit(r"!\[([^\]]*)\]\(([^)]+)\)"), F.lit(i)) for i in (1, 2))
    each = files.select("source_file", F.posexplode(F.arrays_zip(alt.alias("alt"), path.alias("path"))).alias("place", "ref"))
    each = each.select("source_file", "place", F.trim("ref.alt").alias("alt"), F.trim("ref.path").alias("path"))
    return each.groupBy("path").agg(F.min_by("alt", F.struct("source_file", "place")).alias("alt"), F.min("source_file").alias("source_file"))


def image_type(content: Column) -> Column:
    """By the leading bytes; jpeg if they are none of the known."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("89504E47"), "image/png").when(head.startswith("47494638"), "image/gif").when(head.startswith("52494646") & F.substring(head, 17, 8).eqNullSafe("57454250"), "image/webp").otherwise("image/jpeg")
    )
