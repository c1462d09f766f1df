"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by document: every block of documents is one row that
holds its terms and, for each term, the ascending token positions at which it
occurs. A gap between documents keeps phrases from crossing them. A phrase is
found by taking the postings of its rarest term in the block, shifting them by
the term's offset, and intersecting them with the shifted lists of the other
terms, rarest first. Neither building nor searching shuffles the texts, and test
items go from the tasks that write them to those that search for them by files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .files import create_folder, read_bytes, write_bytes
from .shared import shared_folder, text_bytes

WINDOW = 13
#: Text of one block; a longer document is a block of its own.
BLOCK_BYTES = 4 << 20
#: Test text of one file, which a task searches for at once; blocks that it holds where there are several files.
SLICE_BYTES, HELD_BLOCKS = 4 << 20, 16
#: Lower-cases A-Z, keeps 0-9, a-z and bytes of other characters, and makes the rest spaces.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLDED).split()


def _block(ids: list, hashes: list, docs: list[list[bytes]]) -> dict:
    lengths = np.array([len(w) for w in docs], np.int32)
    starts = np.cumsum(np.append(0, lengths[:-1] + 1)).astype(np.int32) if len(docs) else np.zeros(0, np.int32)
    flat = np.empty(int(lengths.sum()), object)
    flat[:] = [w for d in docs for w in d]
    codes, terms = pd.factorize(flat)
    places = np.arange(len(flat), dtype=np.int32) + np.repeat(np.arange(len(docs), dtype=np.int32), lengths)
    postings = places[np.argsort(codes, kind="stable")]
    return {
        "doc_ids": ids, "hashes": hashes, "lengths": lengths.tobytes(), "starts": starts.tobytes(), "terms": b" ".join(terms),
        "counts": np.bincount(codes, minlength=len(terms)).astype(np.int32).tobytes(), "postings": np.diff(postings, prepend=np.int32(0)).astype(np.int32).tobytes(),
    }


def build_index(docs: DataFrame, id_column: str = "doc_id", path: str | None = None) -> DataFrame:
    """Write the positional index of all whole texts and return it, one row for each block.

    Every row of docs is indexed, also those with null ids or repeated ids; a
    null text has no words. path: where, else in the shared folder.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_column].dataType
    schema = f"doc_ids array<{id_type.simpleString()}>, hashes array<bigint>, lengths binary, starts binary, terms binary, counts binary, postings binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(row):
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in out], schema=out)

        out = pa.schema([("doc_ids", pa.list_(arrow_id)), ("hashes", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("lengths", "starts", "terms", "counts", "postings"))])
        ids, hashes, held, size = [], [], [], 0
        for b in batches:
            for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                t = t.as_py()
                if held and size + len(t) > BLOCK_BYTES:
                    yield batch(_block(ids, hashes, held))
                    ids, hashes, held, size = [], [], [], 0
                ids.append(i)
                hashes.append(h)
                held.append(words_of(t))
                size += len(t)
        if held:
            yield batch(_block(ids, hashes, held))

    arrow_id = to_arrow_type(id_type)
    path = path or shared_folder(spark, "positional-index")
    rows = docs.select(F.col(id_column), F.xxhash64("text"), text_bytes())
    rows.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


class Phrases:
    """The distinct windows of test items, their words as numbers, and the items of each."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        owners: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            w = words_of(text)
            for i in range(max(1, len(w) - window + 1) if w else 0):
                owners.setdefault(tuple(w[i : i + window]), set()).add(item)
        self.owners = [tuple(sorted(x)) for x in owners.values()]
        vocabulary: dict[bytes, int] = {}
        lines = [[vocabulary.setdefault(w, len(vocabulary)) for w in x] for x in owners]
        self.vocabulary = list(vocabulary)
        self.sizes = np.array([len(x) for x in lines], np.int32)
        #: Short windows are padded with a number that stands for a word found everywhere.
        self.words = np.full((len(lines), window), len(self.vocabulary), np.int32)
        for i, x in enumerate(lines):
            self.words[i, : len(x)] = x


def _near(starts: np.ndarray, other: np.ndarray, slop: int) -> np.ndarray:
    at = np.searchsorted(other, starts - slop)
    return starts[(at < len(other)) & (other[np.minimum(at, len(other) - 1)] <= starts + slop)]


def search_block(block: dict, phrases: Phrases, slop: int = 0) -> list[tuple[int, np.ndarray]]:
    """(window, starting positions) of those that occur; with slop, each word may be off its place by so many."""
    numbers = {t: i for i, t in enumerate(block["terms"].split())}
    counts = np.frombuffer(block["counts"], np.int32)
    ends = np.cumsum(counts)
    postings = np.cumsum(np.frombuffer(block["postings"], np.int32))
    own = np.array([numbers.get(w, -1) for w in phrases.vocabulary], np.int64)
    often = np.append(np.where(own >= 0, counts[own] if len(counts) else 0, 0), np.iinfo(np.int32).max)
    df = often[phrases.words]
    out = []
    for i in np.flatnonzero((df > 0).all(axis=1)):
        order = np.argsort(df[i, : phrases.sizes[i]], kind="stable")
        starts = None
        for k in order:
            t = own[phrases.words[i, k]]
            shifted = postings[ends[t] - counts[t] : ends[t]] - k
            starts = shifted if starts is None else _near(starts, shifted, slop)
            if not len(starts):
                break
        else:
            out.append((int(i), starts))
    return out


# ---- test items, in files that tasks read


def write_slices(benchmark: DataFrame, limit: int = SLICE_BYTES) -> list[str]:
    """Files of at most `limit` bytes of test text each (a longer item has one of its own); tasks write them, and only their names come back."""
    tests = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text_bytes().alias("text"))
    path = shared_folder(benchmark.sparkSession, "test-items")
    create_folder(path)
    total = tests.agg(F.sum(F.length("text"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def file():
            uri = f"{path}/{uuid.uuid4().hex}.arrow"
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, kind) as w:
                w.write_batch(pa.RecordBatch.from_pylist(held, kind))
            write_bytes(uri, out.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array([uri])], names=["uri"])

        kind, held, size = pa.schema([("item", pa.string()), ("text", pa.binary())]), [], 0
        for b in batches:
            for row in b.to_pylist():
                if held and size + len(row["text"]) > limit:
                    yield file()
                    held, size = [], 0
                held.append(row)
                size += len(row["text"])
        if held:
            yield file()

    return [r.uri for r in tests.repartition(max(1, -(-total // limit))).mapInArrow(run, "uri string").collect()]


_phrases: dict[tuple[str, int], Phrases] = {}


def phrases_of(uri: str, window: int) -> Phrases:
    """The windows of a file; a worker process holds those of one file."""
    if (uri, window) not in _phrases:
        _phrases.clear()
        rows = pa.ipc.open_stream(read_bytes(uri)).read_all().to_pylist()
        _phrases[uri, window] = Phrases([(r["item"], r["text"]) for r in rows], window)
    return _phrases[uri, window]


def search(index: DataFrame, slices: list[str], window: int = WINDOW, slop: int = 0) -> DataFrame:
    """One row for each indexed document: doc_id, text_hash, n_words, positions of hit words, items with occurring windows.

    The index is read once. slices: files of write_slices; with several, a task
    takes one after the other over HELD_BLOCKS blocks. With slop > 0 the
    positions are those that near matches span.
    """
    id_type = index.schema["doc_ids"].dataType.elementType
    held_blocks = 1 if len(slices) < 2 else HELD_BLOCKS

    def found_in(blocks: list[dict]) -> Iterator[pa.RecordBatch]:
        hit: dict[tuple[int, int], list[np.ndarray]] = {}
        found: dict[tuple[int, int], set[str]] = {}
        for uri in slices:
            phrases = phrases_of(uri, window)
            for n, row in enumerate(blocks):
                lengths, starts = np.frombuffer(row["lengths"], np.int32), np.frombuffer(row["starts"], np.int32)
                for i, places in search_block(row, phrases, slop):
                    for d, p in zip(np.searchsorted(starts, places, "right") - 1, places, strict=True):
                        first, last = max(p - slop, starts[d]), min(p + phrases.sizes[i] + slop, starts[d] + lengths[d])
                        hit.setdefault((n, int(d)), []).append(np.arange(first, last) - starts[d])
                        found.setdefault((n, int(d)), set()).update(phrases.owners[i])
        for n, row in enumerate(blocks):
            lengths = np.frombuffer(row["lengths"], np.int32)
            each = [(n, d) for d in range(len(lengths))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], to_arrow_type(id_type)), pa.array(row["hashes"], pa.int64()), pa.array(lengths.astype(np.int64)),
                    pa.array([np.unique(np.concatenate(hit[k])).tolist() if k in hit else [] for k in each], pa.list_(pa.int32())), pa.array([sorted(found.get(k, ())) for k in each], pa.list_(pa.string())),
                ],
                names=["doc_id", "text_hash", "n_words", "hit_positions", "items"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = []
        for b in batches:
            for row in b.to_pylist():
                blocks.append(row)
                if len(blocks) == held_blocks:
                    yield from found_in(blocks)
                    blocks = []
        if blocks:
            yield from found_in(blocks)

    return index.mapInArrow(run, f"doc_id {id_type.simpleString()}, text_hash bigint, n_words bigint, hit_positions array<int>, items array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row for each row of docs: doc_id, text_hash, n_words, n_hit, n_items, items, contaminated.

    A word is hit inside any occurrence of a window of consecutive item words;
    an item of fewer words is one window. Contaminated: a twentieth of the words
    or more are hit. Null texts have no words; rows without an id, repeated rows
    and repeated items count like others; a null item_id is the item "". Either
    table may be empty; other columns are not read; a text longer than a block
    is a block of its own. Test sets over slice_bytes are searched in slices.
    """
    found = search(build_index(docs), write_slices(benchmark, slice_bytes), window)
    n_hit = F.size("hit_positions").cast("bigint")
    return found.select(
        "doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sort_array("items").alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def proximity_matches(docs: DataFrame, benchmark: DataFrame, slop: int = 3, window: int = WINDOW) -> DataFrame:
    """doc_id and items whose words all occur within `slop` places of where a window has them (exact phrases included)."""
    found = search(build_index(docs), write_slices(benchmark), window, slop)
    return found.where(F.size("items") > 0).select("doc_id", F.explode("items").alias("item_id")).distinct()


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, with their columns."""
    bad = contamination(docs, benchmark).where("contaminated").select("doc_id", "text_hash").distinct()
    same: Column = docs["doc_id"].eqNullSafe(bad["doc_id"]) & F.xxhash64(docs["text"]).eqNullSafe(bad["text_hash"])
    return docs.join(bad, same, "left_anti")
