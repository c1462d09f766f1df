"""Byte-level BPE by ranked merges, folded with Spark's higher-order functions.

Tasks cut blocks of texts into words of the tokenizer's pattern with Arrow, look
at each distinct piece of a block once, and hand on each distinct word once. Spark folds the merges over the bytes of these words, with
a map of ranks as a literal in the plan; a word's ids then go wherever it stands.
Decoding concatenates the byte strings of the ids, word by word. Nothing is shuffled. Words of
a bounded sample are encoded first, so that tasks do not repeat common ones.

A fold takes time with the square of a word's length, so a word over LONG_BYTES
goes in overlapping windows. A list of tokens is the encoding of its bytes
exactly if each two neighbours are that of theirs; so two windows with a token
in common, at the same place, are joined there.
"""

from __future__ import annotations

import base64
import io
import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .files import read_bytes, write_bytes
from .shared import shared_folder, written
from .units import MARKS, unit_array, unit_text

#: Slots of the literal rank map, and the rank of what is no token.
SLOTS, NONE = 1 << 16, 1 << 30
#: Codes that no character may have.
SURROGATES, SURROGATES_END = 0xD800, 0xE000
#: Bytes of the texts whose words go together.
BLOCK_BYTES = 1 << 21
#: Distinct words that a task remembers; beyond, it starts anew.
REMEMBERED = 150_000
#: Documents whose words are encoded first, and most of these words.
SAMPLE_DOCUMENTS, SAMPLE_WORDS = 40_000, 200_000
#: Bytes of a word that is folded whole; of longer ones, the step between windows and a window's bytes.
LONG_BYTES, STEP_BYTES, WINDOW_BYTES = 160, 96, 128
#: In the numbers of a text, before the count of a long word's windows and their numbers.
WINDOWS = 0xFFFFFFFF


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


# ---- the fold


def char_of(rank: int) -> str:
    """A token as one character; characters sort as their ranks do."""
    return chr(rank + 1 if rank + 1 < SURROGATES else rank + 1 + SURROGATES_END - SURROGATES)


def rank_of(char: Column) -> Column:
    code = F.ascii(char)
    return F.when(code < SURROGATES, code - 1).otherwise(code - 1 - (SURROGATES_END - SURROGATES))


def rank_map(ranks: dict[bytes, int]) -> Column:
    """Two tokens to the token that joins them, as one literal: an array of SLOTS strings, found by hash.

    A string is the mark for no token, then its pairs: a mark, the two tokens and
    the one that joins them. What stands after mark and pair, or else at the
    start, is what the pair becomes.
    """
    _, none, mark = marks_beyond(ranks)
    slots = [none] * SLOTS
    for token, r in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                key = char_of(left) + char_of(right)
                slots[xxhash.xxh64_intdigest(key.encode(), 42) % SLOTS] += mark + key + char_of(r)
    return F.from_json(F.lit(json.dumps(slots, ensure_ascii=False, separators=(",", ":"))), "array<string>")


def marks_beyond(ranks: dict[bytes, int]) -> list[str]:
    """Characters that are no token: for the sides of a word, for no token and before a pair."""
    most = max(ranks.values(), default=0)
    return [char_of(most + i) for i in (1, 2, 3)]


def let(value: Column, body) -> Column:
    """body(value), value evaluated once."""
    return F.aggregate(F.expr("cast(array() as array<int>)"), value, lambda a, _: a, body)


def encode_words(words: Column, ranks: dict[bytes, int]) -> Column:
    """array<binary> -> array<array<int>>: the ids of each word, as if it stood alone.

    A word in the making is a string of its tokens between two marks, beside the
    string of what each two neighbours would become.
    """
    side, none, mark = marks_beyond(ranks)
    latin = "".join(map(chr, range(256)))
    single = "".join(char_of(ranks[bytes([i])]) for i in range(256))
    #: Tokens that no merges lead to; a word that is one of them is that token all the same.
    whole = {t.decode("latin-1"): r for t, r in ranks.items() if len(t) > 1 and merged(t, ranks) != [r]}

    def all_words(table: Column) -> Column:
        def become(pair: Column) -> Column:
            own = table[F.xxhash64(pair).bitwiseAND(F.lit(SLOTS - 1)).cast("int")]
            return F.substring(F.call_function("substring_index", own, F.concat(F.lit(mark), pair), F.lit(-1)), 1, 1)

        def merge(acc: Column, _) -> Column:
            """Joins the leftmost pair of the least rank; only what is beside it changes."""

            def at(m: Column, i: Column) -> Column:
                def beside(tokens: Column) -> Column:
                    new = F.concat(become(F.substring(tokens, i - 1, F.lit(2))), become(F.substring(tokens, i, F.lit(2))))
                    return F.struct(tokens.alias("tokens"), F.overlay(acc["next"], new, i - 1, F.lit(3)).alias("next"))

                return let(F.overlay(acc["tokens"], m, i, F.lit(2)), beside)

            least = F.array_min(F.split(acc["next"], ""))
            return let(least, lambda m: F.when(m < none, let(F.position(m, acc["next"]), lambda i: at(m, i))).otherwise(acc))

        def fold(tokens: Column) -> Column:
            n = F.length(tokens)
            following = F.array_join(F.transform(F.sequence(F.lit(1), n - 1), lambda i: become(F.substring(tokens, i, F.lit(2)))), "")
            start = F.struct(tokens.alias("tokens"), following.alias("next"))
            return F.aggregate(F.sequence(F.lit(3), n), start, merge, lambda a: F.transform(F.split(F.replace(a["tokens"], F.lit(side)), ""), rank_of))

        def word(w: Column) -> Column:
            plain = F.decode(w, "ISO-8859-1")
            folded = let(F.concat(F.lit(side), F.translate(plain, latin, single), F.lit(side)), fold)
            for t, r in whole.items():
                folded = F.when(plain == t, F.array(F.lit(r))).otherwise(folded)
            return folded

        return F.transform(words, word)

    return let(rank_map(ranks), all_words)


# ---- words of texts


def in_blocks(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows in batches whose last column has about so many bytes, BLOCK_BYTES if not stated."""
    most = BLOCK_BYTES if most is None else most
    held, size = [], 0
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column(b.num_columns - 1)).to_numpy(), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            end = min(b.num_rows, int(np.searchsorted(ends, before + most - size)) + 1)
            held.append(b[at:end])
            size += int(ends[end - 1]) - before
            if size >= most:
                yield pa.concat_batches(held) if len(held) > 1 else held[0]
                held, size = [], 0
            at = end
    if held:
        yield pa.concat_batches(held)


class Words:
    """Numbers for distinct words; those of the sample have theirs beforehand."""

    def __init__(self, pattern: str, known: dict[str, int]):
        self.find, self.known = regex.compile(pattern).findall, known
        #: The cuts of units.py hold for this pattern only.
        self.by_units = pattern == public_tokenizers.PATTERN
        self.reset()

    def reset(self) -> None:
        self.numbers: dict[str, int] = {}
        self.new: list[bytes] = []

    def _number(self, word: str) -> bytes:
        if len(word) > LONG_BYTES // 4 and len(data := word.encode()) > LONG_BYTES:
            windows = [data[at : at + WINDOW_BYTES].decode(errors="surrogateescape") for at in range(0, len(data) - WINDOW_BYTES + STEP_BYTES, STEP_BYTES)]
            return b"".join([WINDOWS.to_bytes(4, "little"), len(windows).to_bytes(4, "little"), *map(self._own_number, windows)])
        return self._own_number(word)

    def _own_number(self, word: str) -> bytes:
        i = self.known.get(word)
        if i is None and (i := self.numbers.get(word)) is None:
            i = self.numbers[word] = len(self.known) + len(self.numbers)
            self.new.append(word.encode(errors="surrogateescape"))
        return i.to_bytes(4, "little")

    def _units(self, keys: list[str]) -> Iterator[bytes]:
        """The numbers of each unit's words."""
        known, numbers, most = self.known.get, self.numbers.get, LONG_BYTES // 4
        for key in keys:
            # a blank and letters are one word, and so are marks after them
            core = key.rstrip(MARKS)
            if not core.isalpha():
                yield b"".join(map(self._number, self.find(unit_text(key))))
                continue
            word = " " + core
            i = known(word)
            if i is None:
                i = numbers(word)
            own = self._number(word) if i is None or len(word) > most else i.to_bytes(4, "little")
            yield own if len(core) == len(key) else own + self._number(key[len(core) :])

    def of(self, texts: pa.StringArray) -> tuple[pa.Buffer, np.ndarray]:
        """The numbers of the words of texts, and where those of each text end."""
        if not self.by_units:
            own = [b"".join(map(self._number, self.find(t))) for t in texts.to_pylist()]
            return pa.py_buffer(b"".join(own)), np.cumsum([len(x) // 4 for x in own], dtype=np.int64)
        keys, ends = unit_array(texts)
        coded = keys.dictionary_encode()
        numbers = list(self._units(coded.dictionary.to_numpy(zero_copy_only=False).tolist()))
        return joined_parts(pa.array(numbers, pa.binary()), coded.indices, ends, 4)


def joined_parts(parts: pa.BinaryArray | pa.LargeBinaryArray, indices, ends: np.ndarray, width: int = 1) -> tuple[pa.Buffer, np.ndarray]:
    """The parts with these indices put together, and where what stands before each end does end, in steps of width bytes."""
    taken = parts.take(indices)
    kind = np.int64 if pa.types.is_large_binary(parts.type) else np.int32
    stops = np.frombuffer(taken.buffers()[1], kind)[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, kind)
    data = (taken.buffers()[2] or pa.py_buffer(b""))[int(stops[0]) : int(stops[-1])]
    return data, ((stops[ends] - stops[0]) // width).astype(np.int64)


def as_binary(data, ends: np.ndarray) -> pa.BinaryArray:
    """Bytes cut at these ends."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


_seeds: dict[str, dict[str, int]] = {}


def _seed_numbers(uri: str) -> dict[str, int]:
    """Word -> number, read once by each worker process."""
    if uri not in _seeds:
        _seeds.clear()
        x = np.load(io.BytesIO(read_bytes(uri)))
        words = as_binary(x["words"], x["word_ends"]).to_pylist()
        _seeds[uri] = {w.decode(errors="surrogateescape"): i for i, w in enumerate(words)}
    return _seeds[uri]


_seeds_encoded: dict[str, tuple[pa.BinaryArray, pa.BinaryArray]] = {}


def _seed_ids(uri: str, pieces: pa.BinaryArray) -> tuple[pa.BinaryArray, pa.BinaryArray]:
    """The ids of each word of the sample and their bytes, by its number; read once by each worker process."""
    if uri not in _seeds_encoded:
        _seeds_encoded.clear()
        x = np.load(io.BytesIO(read_bytes(uri)))
        _seeds_encoded[uri] = _decoded(x["ids"].view("<u4"), x["id_ends"], pieces)
    return _seeds_encoded[uri]


def _decoded(ids: np.ndarray, ends: np.ndarray, pieces: pa.BinaryArray) -> tuple[pa.BinaryArray, pa.BinaryArray]:
    """The ids of each word, and their pieces joined."""
    return as_binary(ids, 4 * ends), as_binary(*joined_parts(pieces, pa.array(ids), ends))


# ---- long words


def merged(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same fold over a run of bytes of any length, with a heap of what may be joined; n log n steps."""
    n = len(data)
    parts = [data[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pair_rank = [ranks.get(data[i : i + 2], NONE) for i in range(n - 1)] + [NONE]
    heap = [r << 40 | i for i, r in enumerate(pair_rank) if r != NONE]
    heapify(heap)
    while heap:
        top = heappop(heap)
        r, i = top >> 40, top & ((1 << 40) - 1)
        if pair_rank[i] != r:
            continue  # one side of it has been joined otherwise
        j = after[i]
        parts[i] += parts[j]
        parts[j] = b""
        pair_rank[j] = NONE
        after[i] = k = after[j]
        if k < n:
            before[k] = i
        for left in (before[i], i):
            if left >= 0:
                right = after[left]
                new = pair_rank[left] = ranks.get(parts[left] + parts[right], NONE) if right < n else NONE
                if new != NONE:
                    heappush(heap, new << 40 | left)
    return [ranks[x] for x in parts if x]


def _placed(ids: list[int], at: int, pieces: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, end, id) of tokens from place at on."""
    out = []
    for i in ids:
        out.append((at, at + len(pieces[i]), i))
        at += len(pieces[i])
    return out


def _joined(known: list[tuple[int, int, int]], more: list[tuple[int, int, int]]) -> bool:
    """Go on from a token that ends `known` and one that is in `more`, if there is one."""
    own = {(s, e): j for j, (s, e, _) in enumerate(more)}
    for i in range(len(known) - 1, -1, -1):
        if known[i][0] < more[0][0]:
            return False
        if (j := own.get(known[i][:2])) is not None:
            known[i + 1 :] = more[j + 1 :]
            return True
    return False


def stitch(windows: list[list[int]], pieces: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The ids of a long word from those of its windows.

    Where two windows have no token in common, as in runs that very long tokens
    cover, the whole word is folded anew.
    """
    known = _placed(windows[0], 0, pieces)
    for k, ids in enumerate(windows[1:], 1):
        if not _joined(known, _placed(ids, k * STEP_BYTES, pieces)):
            whole = bytearray()
            for i, w in enumerate(windows):
                whole += b"".join(map(pieces.__getitem__, w))[len(whole) - i * STEP_BYTES :]
            return merged(bytes(whole), ranks)
    return [i for _, _, i in known]


def _without_windows(numbers: np.ndarray, ends: np.ndarray, ids_of: pa.BinaryArray, pieces: list[bytes], ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Numbers and ends with each long word as one number, beyond those of ids_of, and the ids of the long words."""
    numbers, kept, long_words = numbers.copy(), np.ones(len(numbers), bool), []
    for at in np.flatnonzero(numbers == WINDOWS).tolist():
        end = at + 2 + int(numbers[at + 1])
        windows = [np.frombuffer(x, "<u4").tolist() for x in ids_of.take(pa.array(numbers[at + 2 : end])).to_pylist()]
        numbers[at] = len(ids_of) + len(long_words)
        kept[at + 1 : end] = False
        long_words.append(stitch(windows, pieces, ranks))
    return numbers[kept], np.concatenate([[0], np.cumsum(kept)])[ends], long_words


def _cut(rows: DataFrame, pattern: str, seed: str | None, ids_kind) -> DataFrame:
    """One row for a block of texts: their keys, the numbers of their words, and words not seen before in the task."""
    kind = to_arrow_type(ids_kind)
    schema = f"keys array<{ids_kind.simpleString()}>, ends binary, numbers binary, words array<binary>, anew boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # a worker may have served other operators before
        own, anew = Words(pattern, _seed_numbers(seed) if seed else {}), True
        types = [pa.list_(kind), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.bool_()]
        for b in in_blocks(batches):
            numbers, ends = own.of(b.column(1))
            row = [b.column(0).to_pylist(), ends.tobytes(), numbers.to_pybytes(), own.new, anew]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=["keys", "ends", "numbers", "words", "anew"])
            own.new, anew = [], False
            if len(own.numbers) > REMEMBERED:
                own.reset()
                anew = True

    return rows.mapInArrow(run, schema)


def sample_words(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> str | None:
    """Encode the words of about SAMPLE_DOCUMENTS texts by hash, SAMPLE_WORDS at most; the place of the result in the shared folder.

    The result saves repeated work only. It is bounded, so every task may read it.
    """
    spark = docs.sparkSession
    share = F.lit(1 << 30)  # of hashes that are below a bound
    n = docs.count()
    bound = int((1 << 30) * min(1.0, SAMPLE_DOCUMENTS / max(1, n)))
    chosen = docs.select(F.coalesce("text", F.lit("")).alias("text")).where(F.pmod(F.xxhash64("text"), share) < bound)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Words(pattern, {})
        for b in in_blocks(batches):
            own.of(b.column(0))
            if len(own.new) >= REMEMBERED:
                yield pa.RecordBatch.from_arrays([pa.array(own.new, pa.binary())], names=["word"])
                own.reset()
        yield pa.RecordBatch.from_arrays([pa.array(own.new, pa.binary())], names=["word"])

    # words that more tasks meet come first
    words = chosen.mapInArrow(distinct, "word binary").groupBy("word").agg(F.count("*").alias("met"))
    words = written(words, "distinct-words")
    least, part, total = 0, 1.0, 0  # of the words that so many tasks met, that part
    for row in words.groupBy("met").agg(F.count("*").alias("n")).orderBy(F.desc("met")).collect():
        if total + row["n"] > SAMPLE_WORDS:
            least, part = row["met"], (SAMPLE_WORDS - total) / row["n"]
            break
        total += row["n"]
    words = words.where((F.col("met") > least) | ((F.col("met") == least) & (F.pmod(F.xxhash64("word"), share) < int(part * (1 << 30)))))
    found = words.select("word", encode_words(F.array("word"), ranks)[0].alias("ids")).toArrow()
    if not found.num_rows:
        return None
    word, ids = found.column("word").combine_chunks(), found.column("ids").combine_chunks()
    out = io.BytesIO()
    np.savez(
        out, words=np.frombuffer(b"".join(word.to_pylist()), np.uint8), word_ends=np.cumsum(pc.binary_length(word).to_numpy().astype(np.int64)),
        ids=ids.flatten().to_numpy(zero_copy_only=False).astype("<u4").view(np.uint8), id_ends=np.cumsum(ids.value_lengths().to_numpy().astype(np.int64)),
    )
    uri = shared_folder(spark, "sample-words")
    write_bytes(uri, out.getvalue())
    return uri


def encode(docs: DataFrame, rank_path: str, pattern: str, id_column: str = "doc_id") -> DataFrame:
    """id_column, ids (unsigned 32-bit little-endian) and decoded (their bytes) of every whole text.

    A null text is empty and has no ids. There is a row for each row of docs,
    with null and repeated ids as they are; an empty table gives none. Other
    columns of docs are not read. Words may be as long as texts.
    """
    ranks = read_ranks(rank_path)
    seed = sample_words(docs, ranks, pattern)
    kind = docs.schema[id_column].dataType
    blocks = _cut(docs.select(F.col(id_column), F.coalesce("text", F.lit(""))), pattern, seed, kind)
    blocks = blocks.select("keys", "ends", "numbers", encode_words(F.col("words"), ranks).alias("word_ids"), "anew")
    arrow_kind = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()
        pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, r in ranks.items():
            pieces[r] = token
        piece_of = pa.array(pieces, pa.binary())
        first = _seed_ids(seed, piece_of) if seed else (pa.array([], pa.binary()),) * 2
        for b in batches:
            for row in range(b.num_rows):
                keys, ends, numbers, words, anew = (c[row] for c in b.columns)
                if anew.as_py():
                    ids_of, decoded_of = first
                if len(words):
                    flat = words.values.flatten().to_numpy(zero_copy_only=False).astype("<u4")
                    new = _decoded(flat, np.cumsum(words.values.value_lengths().to_numpy()), piece_of)
                    ids_of, decoded_of = pa.concat_arrays([ids_of, new[0]]), pa.concat_arrays([decoded_of, new[1]])
                own, stops = np.frombuffer(numbers.as_buffer(), "<u4"), np.frombuffer(ends.as_buffer(), np.int64)
                own_ids, own_decoded = ids_of, decoded_of
                if (own == WINDOWS).any():
                    own, stops, long_words = _without_windows(own, stops, ids_of, pieces, ranks)
                    new = _decoded(np.concatenate(long_words).astype("<u4"), np.cumsum([len(x) for x in long_words]), piece_of)
                    own_ids, own_decoded = pa.concat_arrays([ids_of, new[0]]), pa.concat_arrays([decoded_of, new[1]])
                own = pa.array(own)
                columns = [pa.array(keys.as_py(), arrow_kind), *(as_binary(*joined_parts(x, own, stops)) for x in (own_ids, own_decoded))]
                yield pa.RecordBatch.from_arrays(columns, names=[id_column, "ids", "decoded"])

    return blocks.mapInArrow(run, f"{id_column} {kind.simpleString()}, ids binary, decoded binary")


def report(encoded: DataFrame, id_column: str = "doc_id") -> DataFrame:
    return encoded.select(id_column, (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
