"""Source divergence audit: how far the vocabularies of the sources of a language lie apart.

Tasks look every byte of a batch of texts up in a table of term bytes, find the
boundaries of terms in one go, hash the slices with xxhash and compare each
slice's bytes with those of the first of its hash. Spark adds the counts up and
keeps the frequent terms. The terms of a language are dealt out in buckets of a
bounded number of cells (terms times sources); a task sets up the CSR matrix of
sources by terms of a bucket and sums differences with reduceat. Sums of buckets
are added; everything is integer arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import joined_small, written

#: Bytes that terms consist of: letters, and all of characters beyond ASCII.
TERM = np.zeros(256, bool)
TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
LEAST_DOCUMENTS, SMOOTHING, UNIT, TOP_TERMS = 30, 5, 1_000_000_000, 50
#: Bytes of text that are cut into terms at once (one longer text goes alone), and cells of a bucket.
SLICE_BYTES, CELLS = 8 << 20, 1 << 20

COUNTED = "lang string, source string, term string, n bigint, docs bigint"
PARTS = "lang string, source string, part string, item string, value bigint"


def find_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text of each) of the terms of texts that lie one after the other; no term goes over the end of a text."""
    here = TERM[data]
    before, after = np.zeros(len(here), bool), np.zeros(len(here), bool)
    before[1:], after[:-1] = here[:-1], here[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges], after[edges - 1] = False, False
    starts, ends = np.flatnonzero(here & ~before), np.flatnonzero(here & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def group_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest=xxhash.xxh64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """(first slice of each group, group of each slice): groups of equal bytes.

    Slices are grouped by hash; each is then compared, byte by byte, with the
    first of its group. Those that differ from it in spite of the hash are
    grouped among themselves, by their bytes.
    """
    raw = data.tobytes()
    hashes = np.fromiter((digest(raw[a:z]) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    sizes = ends - starts
    same = sizes == sizes[first][group]
    rows = np.flatnonzero(same)
    if len(rows):
        own = sizes[rows]
        at = np.cumsum(own) - own
        places = np.arange(own.sum()) + np.repeat(starts[rows] - at, own)
        shift = np.repeat(starts[first][group[rows]] - starts[rows], own)
        same[rows] = np.logical_and.reduceat(data[places] == data[places + shift], at)
    odd = np.flatnonzero(~same)
    if len(odd):
        numbers: dict[bytes, int] = {}
        more = []
        for i in odd.tolist():
            key = raw[starts[i] : ends[i]]
            if key not in numbers:
                numbers[key] = len(first) + len(more)
                more.append(i)
            group[i] = numbers[key]
        first = np.append(first, more)
    return first, group


def _counted(langs: list[str], sources: list[str], texts: pa.Array) -> pa.RecordBatch | None:
    """Occurrences and documents of each term in each group of a slice of rows."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if offsets[-1] == offsets[0]:
        return None
    data = LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    starts, ends, text = find_terms(data, offsets - offsets[0])
    if not len(starts):
        return None
    first, term = group_slices(data, starts, ends)
    names: dict[tuple[str, str], int] = {}
    group = np.array([names.setdefault(k, len(names)) for k in zip(langs, sources, strict=True)])
    pair, n = np.unique(text * len(first) + term, return_counts=True)  # of a text and a term
    own, back, docs = np.unique(group[pair // len(first)] * len(first) + pair % len(first), return_inverse=True, return_counts=True)
    total = np.zeros(len(own), np.int64)
    np.add.at(total, back, n)
    raw = data.tobytes()
    words = pa.array([raw[starts[i] : ends[i]] for i in first.tolist()], pa.binary()).cast(pa.string())
    lang, source = zip(*names, strict=True)
    where = pa.array(own // len(first))
    columns = [pa.array(lang, pa.string()).take(where), pa.array(source, pa.string()).take(where), words.take(pa.array(own % len(first))), pa.array(total), pa.array(docs.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs of whole texts, for rows of docs with string columns lang, source and text without nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, sources, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.large_binary())
            sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else []
            at, held = 0, 0
            for i, size in enumerate(sizes):
                if i > at and held + size > SLICE_BYTES:
                    if (out := _counted(langs[at:i], sources[at:i], texts.slice(at, i - at))) is not None:
                        yield out
                    at, held = i, 0
                held += size
            if at < len(texts) and (out := _counted(langs[at:], sources[at:], texts.slice(at))) is not None:
                yield out

    rows = docs.select("lang", "source", "text").mapInArrow(run, COUNTED)
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(n: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(UNIT * (n + SMOOTHING) / (total + SMOOTHING * terms)), without a product beyond 64 bits."""
    whole, rest, out = total + SMOOTHING * terms, n + SMOOTHING, np.zeros(n.shape, np.int64)
    if whole >= 1 << 53:
        raise ArithmeticError("more terms than 64-bit arithmetic holds")
    for _ in range(3):  # UNIT in three steps of 1000
        digits, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digits
    return out + 1


def bucket_parts(lang: str, sources: list[str], totals: list[int], n_terms: int, terms: np.ndarray, row: np.ndarray, column: np.ndarray, n: np.ndarray, top: int) -> Iterator[tuple]:
    """Rows of PARTS of one bucket: sums of differences for each two sources, and the best terms of each.

    terms (bytes, sorted), and of each cell its row (source), column (term) and count.
    """
    order = np.lexsort((column, row))
    row, column, n = row[order], column[order], n[order]
    indptr = np.searchsorted(row, np.arange(len(sources) + 1))
    if not len(terms):
        yield from ((lang, a, "pair", b, 0) for i, a in enumerate(sources) for b in sources[i + 1 :])
        return
    by_term = np.argsort(column, kind="stable")
    q = shares(np.add.reduceat(n[by_term], np.searchsorted(column[by_term], np.arange(len(terms)))), sum(totals), n_terms)
    p = np.empty((len(sources), len(terms)), np.int64)
    for i, total in enumerate(totals):
        own = slice(indptr[i], indptr[i + 1])
        p[i] = shares(np.zeros(1, np.int64), total, n_terms)[0]
        p[i, column[own]] = shares(n[own], total, n_terms)
    for i, a in enumerate(sources):
        below = p[i + 1 :]
        if len(below):
            sums = np.add.reduceat(np.abs(below - p[i]).ravel(), np.arange(len(below)) * len(terms))
            yield from ((lang, a, "pair", b, int(v)) for b, v in zip(sources[i + 1 :], sums, strict=True))
        own = column[indptr[i] : indptr[i + 1]]
        more = p[i, own] - q[own]
        own, more = own[more > 0], more[more > 0]
        best = np.lexsort((own, -more))[:top]  # terms are sorted, so their numbers are
        yield from ((lang, a, "term", terms[own[j]].decode(), int(more[j])) for j in best)


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, cells: int = CELLS) -> DataFrame:
    """lang, source, part, item, value and rank.

    Part pair: every other source of the language, by the sum of the differences
    of smoothed shares over all kept terms. Part term: the `top` terms that are
    more frequent in the source than in the language. Nulls are empty strings;
    repeated rows count each; a source alone in its language has no pair; an
    empty table gives none. Other columns are not read.
    """
    clean = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = written(term_counts(clean), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_documents)
    counts = written(counts.drop("docs").join(kept.select("lang", "term"), ["lang", "term"]), "kept-terms")
    # sources have numbers in the order of their names, languages the size of their matrix
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = clean.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"))
    groups = written(groups, "groups")
    n_terms = counts.groupBy("lang", "term").agg(F.lit(1)).groupBy("lang").agg(F.count("*").alias("terms"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(n_terms, "lang", "left").select("lang", F.coalesce("terms", F.lit(0)).alias("terms"), "sources")
    langs = written(langs.withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("terms") * F.col("sources") / cells))), "languages")

    bucket = F.pmod(F.xxhash64("term"), F.col("buckets")).alias("bucket")
    cells_of = joined_small(counts, langs, ["lang"]).select("lang", bucket, "source", "term", "n")
    groups_of = joined_small(groups, langs, ["lang"]).select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)).alias("bucket"), "source", "total", "terms")

    def run(cells: pa.Table, groups: pa.Table) -> pa.Table:
        own = sorted(zip(groups.column("source").to_pylist(), groups.column("total").to_pylist(), strict=True), key=lambda x: x[0].encode())
        numbers = {s: i for i, (s, _) in enumerate(own)}
        words = cells.column("term").cast(pa.binary()).combine_chunks().dictionary_encode() if len(cells) else None
        names = np.array(words.dictionary.to_pylist() if words else [], object)
        order = np.argsort(names) if len(names) else np.zeros(0, np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        row = np.array([numbers[s] for s in cells.column("source").to_pylist()], np.int64)
        column = place[words.indices.to_numpy()] if words else np.zeros(0, np.int64)
        n = cells.column("n").to_numpy().astype(np.int64)
        lang, n_terms = groups.column("lang")[0].as_py(), groups.column("terms")[0].as_py()
        rows = list(bucket_parts(lang, [s for s, _ in own], [t for _, t in own], n_terms, names[order], row, column, n, top))
        kinds = [pa.string()] * 4 + [pa.int64()]
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "source", "part", "item", "value"])

    parts = cells_of.groupBy("lang", "bucket").cogroup(groups_of.groupBy("lang", "bucket")).applyInArrow(run, PARTS)
    parts = written(parts, "divergence-parts")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    pairs = written(pairs, "divergence-pairs")
    pairs = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value"))
    place = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    terms = parts.where("part = 'term'").withColumn("rank", place).where(F.col("rank") <= top)
    return pairs.withColumn("rank", place).unionByName(terms)


SQL = rf"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
frequent AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(words)) AS term FROM d) GROUP BY ALL HAVING count(*) >= {LEAST_DOCUMENTS}),
counts AS (
  SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(words) AS term FROM d) JOIN frequent USING (lang, term) GROUP BY ALL),
size_of AS (SELECT lang, count(*) AS v FROM frequent GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM d),
cells AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, v, sum(coalesce(n, 0)) OVER (PARTITION BY lang, source) AS total
  FROM grp JOIN frequent USING (lang) JOIN size_of USING (lang) LEFT JOIN counts USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + ({UNIT}::HUGEINT * (n + {SMOOTHING})) // (total + {SMOOTHING} * v) AS p FROM cells),
q AS (
  SELECT lang, term, 1 + ({UNIT}::HUGEINT * (sum(n) + {SMOOTHING})) // (sum(sum(n)) OVER (PARTITION BY lang) + {SMOOTHING} * any_value(v)) AS q
  FROM cells GROUP BY lang, term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS place
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, place::INTEGER AS rank FROM ranked WHERE part = 'pair' OR place <= {TOP_TERMS}
"""
