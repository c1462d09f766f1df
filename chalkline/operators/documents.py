"""Markdown to chunks, and the metadata of chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any, fold_newlines, language_by_markers, strings, strip
from ..sources.markdown import stem
from .lookups import described, english_keywords, file_topic

# ---- Fixed values of worked examples

EXAMPLE_MARKERS = ("diberi", "formula", "pengiraan", "jawapan", "langkah", "penyelesaian")
EXAMPLE_STARTS = re.compile(r"^(?:##? (?:soalan|contoh|langkah)|diberi|formula|pengiraan|jawapan)", re.M)

SEPARATOR = "\n\n---\n\n"
MIN_CHARS, LEAST_CHARS = 150, 20
_HEADING = re.compile(r"(#{1,3}) (.+)$")
_RULE = re.compile(r"---+$")


def is_worked_example(text: str) -> bool:
    low = text.lower()
    return sum(f"# {m}" in low or f"\n{m}:" in low for m in EXAMPLE_MARKERS) >= 2


def sections(text: str) -> Iterator[tuple[list[str], list[str]]]:
    """(the three headings above, blocks between horizontal rules) for each stretch of text without a heading."""
    heads, blocks, lines = ["", "", ""], [], []

    def cut():
        if block := "\n".join(lines).strip():
            blocks.append(block)
        lines.clear()

    for line in text.split("\n"):
        if m := _HEADING.match(line):
            cut()
            if blocks:
                yield list(heads), blocks
            level, blocks = len(m[1]) - 1, []
            heads[level:] = [m[2].strip()] + [""] * (2 - level)
        elif _RULE.match(line):
            cut()
        else:
            lines.append(line)
    cut()
    if blocks:
        yield heads, blocks


def joined_examples(blocks: list[str]) -> Iterator[str]:
    """Blocks in which neighbouring parts of a worked example are one."""
    parts: list[str] = []
    for b in blocks:
        if EXAMPLE_STARTS.search(b.lower()):
            parts.append(b)
            continue
        if parts:
            yield SEPARATOR.join(parts)
            parts = []
        yield b
    if parts:
        yield SEPARATOR.join(parts)


def chunks_of(text: str, min_chars: int = MIN_CHARS) -> Iterator[tuple[str, str, str, str]]:
    """(h1, h2, h3, content). Short blocks go with the next of their section, unless they are worked examples."""
    for heads, blocks in sections(text):
        short: list[str] = []
        for b in joined_examples(blocks):
            if len(b) < min_chars and not is_worked_example(b):
                short.append(b)
                continue
            yield (*heads, "\n\n".join([*short, b]))
            short = []
        if short:
            yield (*heads, "\n\n".join(short))


def chunk_markdown(files: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """files (source_file, text) -> one row for each chunk of LEAST_CHARS or more, numbered in its file from 0.

    A null text has no chunks. Files are independent; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["source_file", "idx", "heading_h1", "heading_h2", "heading_h3", "content"]
        types = [pa.string(), pa.int32(), *[pa.string()] * 4]
        for b in batches:
            for source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                kept = [c for c in chunks_of(text, min_chars) if len(c[3]) >= LEAST_CHARS] if text else []
                columns = zip(*((source, i, *c) for i, c in enumerate(kept)), strict=True) if kept else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    schema = "source_file string, idx int, heading_h1 string, heading_h2 string, heading_h3 string, content string"
    rows = files.select("source_file", fold_newlines(F.col("text")).alias("text")).mapInArrow(run, schema)
    return with_features(rows)


def chunk_id(source_file: Column, heading: Column, number: Column) -> Column:
    name = F.replace(F.lower(stem(source_file)), F.lit(" "), F.lit("_"))
    slug = F.substring(F.regexp_replace(F.replace(F.lower(heading), F.lit(" "), F.lit("_")), "[^a-z0-9_]", ""), 1, 40)
    return F.format_string("%s__%s__%04d", name, slug, number)


def keyword_list(content: Column) -> Column:
    """The comma-separated words after Keyword(s):, each once, in order."""
    lines = F.regexp_extract_all(content, F.lit(r"(?id)Keywords?:\s*(.+)"), F.lit(1))
    words = F.transform(F.flatten(F.transform(lines, lambda x: F.split(x, ","))), strip)
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def equations(content: Column) -> Column:
    """Lines with an arrow that has three characters or more on either side."""
    lines = F.filter(F.split(content, "\n"), lambda x: x.rlike("(?d)^.{3,}(?:→|⇌|->|⟶).{3,}"))
    found = F.transform(lines, lambda e: F.regexp_replace(e, r"^\s+|\s+$", ""))
    # most texts have no arrow, and their lines are not cut
    return F.when(~contains_any(content, ["→", "⇌", "->", "⟶"]), F.expr("cast(array() as array<string>)")).otherwise(found)


def formula_candidates(content: Column) -> Column:
    """First words of the parts of equations that look like formulas, and lines that are one; sorted, each once."""
    parts = F.flatten(F.transform(equations(content), lambda e: F.split(e, "[→⇌>+-]")))
    words = F.transform(parts, lambda p: F.split(strip(p), r"\s+")[0])
    words = F.transform(F.filter(words, lambda w: w.rlike("[A-Z][a-z0-9]")), lambda w: F.regexp_replace(w, "^[(),. ]+|[(),. ]+$", ""))
    one = r"[A-Z][A-Za-z0-9()·.^+\-=₂₃₄⁺⁻]+"
    # only lines that may be one are stripped; the last test decides
    lines = F.filter(F.split(content, "\n"), lambda x: x.rlike(rf"^\s*{one}[\u0085\u2028\u2029]?\s*$"))
    lines = F.filter(F.transform(lines, strip), lambda x: x.rlike(f"^{one}$"))
    return F.array_sort(F.array_distinct(F.concat(words, lines)))


def diagrams(content: Column) -> Column:
    alt, path = (F.regexp_extract_all(content, F.lit(r"!\[([^\]]*)\]\(([^)]+)\)"), F.lit(i)) for i in (1, 2))
    return F.zip_with(alt, path, lambda a, p: F.struct(strip(a).alias("alt"), strip(p).alias("path")))


def worked_example(content: Column) -> Column:
    low = F.lower(content)
    return sum(F.coalesce(contains_any(low, [f"# {m}", f"\n{m}:"]).cast("int"), F.lit(0)) for m in EXAMPLE_MARKERS) >= 2


def with_features(rows: DataFrame) -> DataFrame:
    content = F.col("content")
    return rows.select(
        chunk_id(F.col("source_file"), F.coalesce(F.nullif("heading_h2", F.lit("")), "heading_h1"), F.col("idx")).alias("chunk_id"), "source_file", "idx", "heading_h1", "heading_h2", "heading_h3", "content",
        keyword_list(content).alias("raw_keywords"), formula_candidates(content).alias("formulas"), diagrams(content).alias("diagrams"), equations(content).alias("equations"),
        worked_example(content).alias("has_worked_example"), content.rlike(r"(?md)^\|.+\|").alias("has_table"), F.length(content).alias("char_count"),
    )


def is_calculation_file(text: Column) -> Column:
    return text.rlike(r"(?imd)^Jenis:\s*calculation")


# ---- Fixed values of content types

CALCULATION = r"(?i)(?:pengiraan|hitungkan|kira|calculate|find|nilai|value|diberi|formula|langkah|jawapan|Q\s*=|n\s*=|m\s*=|pH\s*=|ΔH)"
FORMULA_LINE = r"(?md)^(?:[A-Z][a-z]?[0-9()]+|n\s*=|m\s*=|Q\s*=|pH\s*=|ΔH)"
QUESTION = r"(?i)(?:soalan|contoh soalan|jawapan skema|marking scheme|answer scheme|topikal|SPM [0-9]{4})"
DEFINITION = r"(?i)(?:ditakrifkan sebagai|adalah|ialah|defined as|refers to|merujuk kepada)"


def content_type() -> Column:
    """From the file's name, else from what the chunk has, first that fits."""
    name, text = F.lower(stem(F.col("source_file"))), F.col("content")
    worked, defines = F.col("has_worked_example"), text.rlike(DEFINITION)
    has = lambda *words: F.exists(strings(words), lambda w: F.contains(name, w))
    return (
        F.when(has("calculation", "pengiraan"), "calculation")
        .when(has("master", "reference", "jisim_atom"), "formula")
        .when(text.rlike(QUESTION) & worked, "qa_scheme")
        .when(worked | ((F.size("equations") > 0) & text.rlike(CALCULATION)), "calculation")
        .when(text.rlike(FORMULA_LINE) & (F.size("formulas") >= 3) & ~defines, "formula")
        .when(defines & ~worked, "definition")
        .otherwise("theory")
    )


def tag(chunks: DataFrame) -> DataFrame:
    """chunks with chapter, form, topic, type, language, keywords, year, question type and the text to embed."""
    text, low = F.col("content"), F.lower("content")
    heads = F.filter(F.array("heading_h1", "heading_h2", "heading_h3"), lambda h: h != "")
    out = chunks.withColumn("__file", file_topic(F.col("source_file"))).withColumnRenamed("raw_keywords", "keywords_bm")
    topic = F.coalesce(F.nullif("__file.topic", F.lit("")), F.nullif(strip(F.regexp_replace("heading_h1", r"^BAB [0-9]+:\s*", "")), F.lit("")), F.nullif("heading_h2", F.lit("")), F.lit(""))
    subtopic = F.when(~F.col("heading_h3").isin("", "Konsep SPM"), F.col("heading_h3")).otherwise(strip(F.regexp_replace("heading_h2", r"^[0-9]+\.[0-9]+\s*", "")))
    out = out.select(
        "*", F.array_join(heads, " > ").alias("full_heading"), F.col("__file.chapter").alias("chapter"), F.col("__file.tingkatan").alias("tingkatan"), topic.alias("topic"), subtopic.alias("subtopic"),
        content_type().alias("content_type"), english_keywords(F.col("keywords_bm")).alias("keywords_en"), (F.size("diagrams") > 0).alias("has_diagram"), language_by_markers(text).alias("language"),
        F.regexp_extract(text, r"\bSPM[_ ]?([0-9]{4})\b", 1).try_cast("int").alias("exam_year"),
        F.when(F.contains(low, F.lit("pilihan jawapan")) | F.contains(low, F.lit("mcq")), "mcq").when(F.contains(low, F.lit("esei")) | F.contains(low, F.lit("essay")), "esei")
        .when(F.contains(low, F.lit("soalan struktur")) | F.contains(low, F.lit("structured")), "struktur").alias("question_type"),
    ).drop("__file")
    return out.withColumn("embed_text", embed_text())


def embed_text() -> Column:
    def line(name: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(f"{name}: "), value))

    keywords = F.slice(F.concat("keywords_bm", "keywords_en"), 1, 20)
    return F.concat_ws(
        "\n\n", line("Tajuk", F.col("full_heading")), line("Topik", F.col("topic")), line("Kata kunci", F.array_join(keywords, ", ")), line("Formula", F.array_join(F.slice("formulas", 1, 10), ", ")), F.col("content")
    )


def type_counts(chunks: DataFrame) -> DataFrame:
    """Counts by content type, by language and by chapter (nulls last) in one table."""
    out = chunks.groupingSets([["content_type"], ["language"], ["chapter"]], "content_type", "language", "chapter").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    by = F.when(F.col("g") == 3, "content_type").when(F.col("g") == 5, "language").otherwise("chapter")
    return out.select(by.alias("by"), "content_type", "language", "chapter", "n").orderBy("by", "content_type", "language", F.asc_nulls_last("chapter"))


# ---- questions and diagrams as chunks


def question_chunks(questions: DataFrame) -> DataFrame:
    """Bank questions (with `ord`, their place from 0) as chunks with the key set of the question index."""
    text = F.concat(F.lit("SOALAN:\n"), F.col("soalan"), F.lit("\n\nSKEMA JAWAPAN:\n"), F.col("jawapan"))
    return questions.select(
        F.format_string("spm_%d_bab%d_t%d_%s_%04d", "exam_year", "chapter", "tingkatan", "question_type", "ord").alias("chunk_id"), F.format_string("spm_%d", "exam_year").alias("source_file"), F.lit("qa_scheme").alias("content_type"),
        "chapter", "tingkatan", "topic", "subtopic", text.alias("content"), F.concat_ws("\n", "topic", "subtopic", F.array_join("keywords_bm", ", "), F.array_join("keywords_en", ", "), text).alias("embed_text"),
        "keywords_bm", "keywords_en", F.lit(True).alias("has_worked_example"), (F.size("diagrams") > 0).alias("has_diagram"), F.lit(False).alias("has_table"), F.lit("BM").alias("language"), "exam_year", "question_type", "marks",
        F.transform("diagrams", lambda d: F.struct(d.alias("path"), F.lit("").alias("alt"))).alias("diagrams"),
    )


def diagram_stem(path: Column) -> Column:
    """The lower-cased stem of an image path, without one leading rajah_ or diagram_."""
    return F.regexp_replace(stem(F.regexp_extract(F.lower(path), r"([^/]*)$", 1)), "^(?:rajah_|diagram_)", "")


def layered_descriptions(references: DataFrame, library: DataFrame, recognised: DataFrame | None = None, least: int = 20) -> DataFrame:
    """references (path, ...) with description: of the library, else text recognised in the image if it is longer than `least`, else the stem in words.

    library: (ord, key, description); recognised: (path, text), one row for each path.
    """
    out = described(references.withColumn("stem", diagram_stem(F.col("path"))), library)
    out = out.join(recognised.select("path", F.col("text").alias("__read")), "path", "left") if recognised is not None else out.withColumn("__read", F.lit(None).cast("string"))
    read = F.when(F.length("__read") > least, F.concat(F.lit("[Teks OCR dari rajah]: "), F.col("__read")))
    words = F.concat(F.lit("[Rajah: "), F.replace("stem", F.lit("_"), F.lit(" ")), F.lit("]"))
    return out.withColumn("description", F.coalesce("description", read, words)).drop("__read")


def diagram_chunks(diagrams: DataFrame) -> DataFrame:
    """diagrams (path, alt, source_file, stem, description) as chunks; what a diagram lacks is null in build_corpus."""
    alt, none = F.col("alt"), F.expr("cast(array() as array<string>)")
    head = F.concat(F.lit("Rajah: "), alt)
    return diagrams.select(
        F.concat(F.lit("diagram__"), "stem").alias("chunk_id"), "source_file", F.lit("theory").alias("content_type"), head.alias("topic"), alt.alias("subtopic"), F.concat(head, F.lit("\n\n"), "description").alias("content"),
        F.concat(F.lit("Rajah kimia SPM: "), alt, F.lit("\n"), "description").alias("embed_text"), F.array(alt, F.replace("stem", F.lit("_"), F.lit(" "))).alias("keywords_bm"), none.alias("keywords_en"), none.alias("formulas"), none.alias("equations"),
        F.array(F.struct(alt, "path")).alias("diagrams"), F.lit(False).alias("has_worked_example"), F.lit(True).alias("has_diagram"), F.lit(False).alias("has_table"), F.lit("BM").alias("language"),
    )


def describe_in_place(content: Column, described: Column) -> Column:
    """content with a description after each reference; described: array of struct(path, alt, description)."""

    def add(text: Column, d: Column) -> Column:
        ref = F.concat(F.lit("!["), d["alt"], F.lit("]("), d["path"], F.lit(")"))
        return F.replace(text, ref, F.concat(ref, F.lit("\n[Rajah: "), d["description"], F.lit("]")))

    return F.aggregate(F.filter(described, lambda d: d["description"].isNotNull()), content, add)


def build_corpus(parts: list[DataFrame]) -> DataFrame:
    """Chunks of several kinds under one schema; what a kind lacks is null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


