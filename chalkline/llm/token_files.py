"""Token-id files with a minimal perfect hash index.

A shard is a range of documents in doc_id order: a payload of raw ids (2 bytes
each where the vocabulary allows, little-endian) and an index. The index maps
each key by hash and displacement to a slot of its own, without gaps; the slot
holds a fingerprint of the key and the document's place in the payload, so a
read takes constant time and foreign keys are told with high probability.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import in_blocks, joined_parts
from .files import create_folder, open_input, open_output, write_bytes
from .shared import shared_folder, written
from .units import LITERAL, MARKS, unit_array, unit_text

END_ID = 2
#: Bytes of the texts that are encoded together.
BLOCK_BYTES = 8 << 20
#: Encodings of units that one Python worker remembers; beyond, it keeps those in its present texts.
REMEMBERED = 1_000_000
#: New units that go to the library in one text, and in one call.
IN_A_TEXT, TOGETHER = 200, 10_000
BUCKET = 2
MANIFEST = "shard int, payload string, index string, n_docs bigint, n_tokens bigint, first string, last string"


class UnitEncoder:
    """A byte-level tokenizer of the tokenizers library that encodes each distinct unit once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        #: Strings that the library takes as tokens of their own, wherever they stand in a text.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if len(vocabulary) <= 1 << 16 else "<u4")
        self.end = np.array([END_ID], self.dtype).tobytes()
        line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line_end = line_end[0] if len(line_end) == 1 else -1
        #: Bytes that each id stands for: a character of a token is a byte of the text.
        self.widths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.widths[i] = len(token)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: pa.StringArray) -> tuple[pa.Buffer, np.ndarray]:
        """The ids of all texts, END_ID after each, and how many there are up to the end of each text.

        Texts that hold the string of an added token are encoded whole; units of the others hold none.
        """
        held = np.zeros(len(texts), bool)
        for a in self.added:
            held |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        keys, ends = unit_array(pc.if_else(pa.array(held), "", texts) if held.any() else texts)
        coded = keys.dictionary_encode()
        parts, places = self._ids_of(coded.dictionary)
        last = np.full(len(texts), len(parts))
        last[held] = len(parts) + 1 + np.arange(held.sum())
        more = [self.end, *(x + self.end for x in self._encode_each(texts.filter(pa.array(held)).to_pylist()))]
        indices = np.insert(places[coded.indices.to_numpy()], ends, last)
        return joined_parts(pa.concat_arrays([parts, pa.array(more, pa.large_binary())]), pa.array(indices), ends + np.arange(1, len(texts) + 1), self.dtype.itemsize)

    def _ids_of(self, keys: pa.StringArray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
        """Ids of distinct units, and the place of each unit's own. Those of words with marks after them are put together from the two."""
        stems = pc.utf8_rtrim(keys, MARKS)
        sizes = pc.utf8_length(stems).to_numpy()
        marked = np.flatnonzero(sizes < pc.utf8_length(keys).to_numpy())
        marked = marked[pc.match_substring_regex(stems.take(pa.array(marked)), r"[\pL\pN]\z").to_numpy(zero_copy_only=False)]
        apart = np.zeros(len(keys), bool)
        apart[marked] = True
        coded = pc.if_else(pa.array(apart), stems, keys).dictionary_encode()
        own, places = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64)
        marks = [LITERAL + k[n:] for k, n in zip(keys.take(pa.array(marked)).to_pylist(), sizes[marked].tolist(), strict=True)]
        known = self.known
        self._learn([k for k in {*own, *marks} if k not in known])
        if len(known) > REMEMBERED:
            self.known = {k: known[k] for k in {*own, *marks}}
        parts = pa.array(list(map(known.__getitem__, own)), pa.large_binary())
        joined = pc.binary_join_element_wise(parts.take(pa.array(places[marked])), pa.array(list(map(known.__getitem__, marks)), pa.large_binary()), pa.scalar(b"", pa.large_binary()))
        places[marked] = len(parts) + np.arange(len(marked))
        return pa.concat_arrays([parts, joined]), places

    def _encode_each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Units that a blank or a line end precedes are encoded many at a time, as one text.

        Of the others, those without white space get a line end before them, which is a token of its own.
        """
        known, each = self.known, []
        keys, pieces, bare = [], [], []
        for k in new:
            if k[0] != LITERAL:
                keys.append(k)
                pieces.append(k if k[0] == "\n" else " " + k)
                bare.append(False)
                continue
            text = k[1:]
            led = text[:1] in (" ", "\n")
            word = text[1:] if led else text
            if word.split() == [word] and (led or self.line_end >= 0):
                keys.append(k)
                pieces.append(text if led else "\n" + text)
                bare.append(not led)
            else:
                each.append(k)
        for i in range(0, len(keys), TOGETHER):
            part = slice(i, i + TOGETHER)
            each += self._learn_together(keys[part], pieces[part], np.array(bare[part]))
        for i in range(0, len(each), TOGETHER):
            part = each[i : i + TOGETHER]
            known.update(zip(part, self._encode_each([unit_text(k) for k in part]), strict=True))

    def _learn_together(self, keys: list[str], pieces: list[str], bare: np.ndarray) -> list[str]:
        """Encodes the pieces as texts of IN_A_TEXT, without the first id of bare ones; returns the keys where tokens do not end as pieces do."""
        texts = ["".join(pieces[i : i + IN_A_TEXT]) for i in range(0, len(pieces), IN_A_TEXT)]
        found = [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(found)
        token_ends = np.cumsum(self.widths[ids])
        piece_ends = np.cumsum(pc.binary_length(pa.array(pieces, pa.large_string())).to_numpy())
        at = np.searchsorted(token_ends, piece_ends)
        stops = at + 1
        starts = np.concatenate([[0], stops[:-1]])
        right = token_ends[-1] == piece_ends[-1] and (token_ends[at] == piece_ends).all() and (ids[starts[bare]] == self.line_end).all()
        if not right:
            return keys
        starts = (starts + bare) * self.dtype.itemsize
        data = ids.tobytes()
        self.known.update(zip(keys, [data[a:z] for a, z in zip(starts.tolist(), (stops * self.dtype.itemsize).tolist(), strict=True)], strict=True))
        return []


_encoders: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """One for each worker process and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]


# ---- minimal perfect hash


def key_bytes(doc_id: str | None, copy: int) -> bytes:
    """The key of the copy-th document with that id; a null id differs from any text."""
    return b"%d-" % copy if doc_id is None else b"%d=" % copy + doc_id.encode()


def key_parts(key: bytes) -> tuple[str | None, int]:
    """The id and the copy of a key."""
    digits = len(key) - len(key.lstrip(b"0123456789"))
    return None if key[digits : digits + 1] == b"-" else key[digits + 1 :].decode(), int(key[:digits])


def _hashes(key: bytes) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(key)
    return x & 0xFFFFFFFFFFFFFFFF, x >> 64


def _slots(h1, h2, d, n):
    """Slots of keys under displacement d."""
    with np.errstate(over="ignore"):
        x = h1 + np.uint64(d) * (h2 | np.uint64(1))
        x ^= x >> np.uint64(32)
        return (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)


def build_mph(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(displacements by bucket, slot of each key, fingerprint of each key).

    Buckets are placed largest first by trying displacements; a bucket of one
    key takes a free slot, which -1 - slot states.
    """
    n = len(keys)
    pairs = np.array([_hashes(k) for k in keys], np.uint64).reshape(n, 2)
    h1, h2 = pairs[:, 0], pairs[:, 1]
    r = max(1, n // BUCKET)
    bucket = (h1 % np.uint64(r)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=r)
    ends = np.cumsum(sizes)
    shift = np.zeros(r, np.int64)
    slot, taken = np.full(n, -1, np.int64), np.zeros(n, bool)
    for b in np.argsort(-sizes, kind="stable"):
        if sizes[b] < 2:
            break
        own = order[ends[b] - sizes[b] : ends[b]]
        d = 0
        while True:
            at = (_slots(h1[own], h2[own], d, n) % np.uint64(n)).astype(np.int64)
            if not taken[at].any() and len(set(at.tolist())) == len(at):
                break
            d += 1
        shift[b], slot[own] = d, at
        taken[at] = True
    free = iter(np.flatnonzero(~taken))
    for b in np.flatnonzero(sizes == 1):
        own = order[ends[b] - 1]
        slot[own] = next(free)
        shift[b] = -1 - slot[own]
    return shift, slot, (h2 >> np.uint64(32)).astype(np.uint32)


#: An index file: magic, keys, buckets; displacements; slots; sizes of the keys in document order, and the keys.
HEAD = struct.Struct("<4sqq")
MAGIC = b"mph1"
SLOT = np.dtype([("print", "<u4"), ("length", "<i8"), ("start", "<i8")])
SHIFT = np.dtype("<i4")


class ShardIndex:
    """Keys to (place in the payload, ids), by an open index file; None for a key whose fingerprint differs.

    find() reads the head, one displacement and one slot, however large the index.
    """

    def __init__(self, file):
        self.file = file
        magic, self.n, self.buckets = HEAD.unpack(self._read(0, HEAD.size))
        if magic != MAGIC:
            raise ValueError("not an index")
        self.slots_at = HEAD.size + self.buckets * SHIFT.itemsize

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def find(self, key: bytes) -> tuple[int, int] | None:
        if not self.n:
            return None
        h1, h2 = _hashes(key)
        d = int(np.frombuffer(self._read(HEAD.size + h1 % self.buckets * SHIFT.itemsize, SHIFT.itemsize), SHIFT)[0])
        slot = -1 - d if d < 0 else int(_slots(np.array([h1], np.uint64), np.array([h2], np.uint64), d, self.n)[0] % np.uint64(self.n))
        own = np.frombuffer(self._read(self.slots_at + slot * SLOT.itemsize, SLOT.itemsize), SLOT)[0]
        return (int(own["start"]), int(own["length"])) if own["print"] == h2 >> 32 else None

    def keys(self) -> list[bytes]:
        """All keys in document order."""
        at = self.slots_at + self.n * SLOT.itemsize
        ends = np.cumsum(np.frombuffer(self._read(at, 4 * self.n), "<u4").astype(np.int64)).tolist()
        data = self._read(at + 4 * self.n, ends[-1] if ends else 0)
        return [data[a:z] for a, z in zip([0, *ends], ends, strict=False)]

    def find_all(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """find() for many keys, which must all be known."""
        shift = np.frombuffer(self._read(HEAD.size, self.buckets * SHIFT.itemsize), SHIFT).astype(np.int64)
        slots = np.frombuffer(self._read(self.slots_at, self.n * SLOT.itemsize), SLOT)
        pairs = np.array([_hashes(k) for k in keys], np.uint64).reshape(len(keys), 2)
        d = shift[(pairs[:, 0] % np.uint64(self.buckets)).astype(np.int64)]
        moved = _slots(pairs[:, 0], pairs[:, 1], np.maximum(d, 0).astype(np.uint64), self.n) % np.uint64(self.n)
        own = slots[np.where(d < 0, -1 - d, moved.astype(np.int64))]
        if (own["print"] != (pairs[:, 1] >> np.uint64(32)).astype(np.uint32)).any():
            raise KeyError("a key is not in this shard")
        return own["start"], own["length"]


def index_bytes(ids: list[str | None], copies: list[int], starts: list[int], lengths: list[int]) -> bytes:
    keys = [key_bytes(i, c) for i, c in zip(ids, copies, strict=True)]
    shift, slot, prints = build_mph(keys)
    slots = np.empty(len(keys), SLOT)
    slots["print"][slot], slots["start"][slot], slots["length"][slot] = prints, starts, lengths
    sizes = np.array([len(k) for k in keys], "<u4")
    return b"".join([HEAD.pack(MAGIC, len(keys), len(shift)), shift.astype(SHIFT).tobytes(), slots.tobytes(), sizes.tobytes(), *keys])


# ---- files


def write_tokens(docs: DataFrame, path: str, vocabulary: str) -> DataFrame:
    """Encode docs (doc_id, text), write shards under `path` in ascending doc_id order, return the manifest.

    Each document ends with END_ID; a null text is empty. Null ids come first;
    rows that repeat an id follow each other by a hash of the text and have
    keys of their own. An empty table gives an empty manifest; other columns of
    docs are not read. Files of failed attempts stay unreferenced.
    """
    create_folder(path)
    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, copies, starts, lengths = [], [], [], []
        own, at, name, out = encoder(vocabulary), 0, uuid.uuid4().hex, None
        for b in in_blocks(batches, BLOCK_BYTES):
            data, ends = own.encode(b.column(1).cast(pa.string()))
            out = out or open_output(f"{path}/{name}.ids")
            out.write(data)
            for i in b.column(0).to_pylist():
                copies.append(copies[-1] + 1 if ids and ids[-1] == i else 0)
                ids.append(i)
            stops = [0, *ends.tolist()]
            starts += [at + x for x in stops[:-1]]
            lengths += np.diff(stops).tolist()
            at += stops[-1]
        if out is None:
            return
        out.close()
        write_bytes(f"{path}/{name}.mph", index_bytes(ids, copies, starts, lengths))
        row = [TaskContext.get().partitionId(), f"{path}/{name}.ids", f"{path}/{name}.mph", len(ids), at, ids[0], ids[-1]]
        types = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=[x.split()[0] for x in MANIFEST.split(", ")])

    return written(rows.select(F.col("doc_id").cast("string"), "text").mapInArrow(run, MANIFEST), "token-manifest")


def read_tokens(spark: SparkSession, manifest: DataFrame, vocabulary: str) -> DataFrame:
    """Every document from the files, each found by its key: doc_id (as text), copy, start, n_tokens, ids_crc32.

    Only the manifest, one short row for each shard, passes through the driver.
    """
    shards, base = [], 0
    for m in manifest.orderBy("shard").toLocalIterator():
        shards.append((m["payload"], m["index"], base))
        base += m["n_tokens"]
    schema = "doc_id string, copy int, start bigint, n_tokens bigint, ids_crc32 bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = encoder(vocabulary).dtype
        for b in batches:
            for payload, index, base in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with open_input(index) as f:
                    own = ShardIndex(f)
                    keys = own.keys()
                    starts, lengths = own.find_all(keys)
                with open_input(payload) as f:
                    for k in range(0, len(keys), 1024):
                        part = slice(k, k + 1024)
                        ids, copies = zip(*map(key_parts, keys[part]), strict=True)
                        sums = []
                        for s, n in zip(starts[part].tolist(), lengths[part].tolist(), strict=True):
                            f.seek(s * dtype.itemsize)
                            sums.append(zlib.crc32(np.frombuffer(f.read(n * dtype.itemsize), dtype).astype("<u4").tobytes()))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids, pa.string()), pa.array(copies, pa.int32()), pa.array(np.ascontiguousarray(starts[part]) + base), pa.array(np.ascontiguousarray(lengths[part])), pa.array(sums, pa.int64())],
                            names=["doc_id", "copy", "start", "n_tokens", "ids_crc32"],
                        )

    if not shards:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame(shards, "payload string, index string, base bigint").repartition(len(shards)).mapInArrow(run, schema)


def document_tokens(manifest: DataFrame, doc_id, vocabulary: str, copy: int = 0) -> list[int] | None:
    """The ids of one document by its key, from one index slot and one run of its payload; None if it has none."""
    key = key_bytes(None if doc_id is None else str(doc_id), copy)
    dtype = encoder(vocabulary).dtype
    number = isinstance(doc_id, int)
    near = manifest
    if doc_id is not None:
        first, last = (F.col(c).cast("bigint") if number else F.col(c) for c in ("first", "last"))
        near = manifest.where(first.isNull() | ((first <= F.lit(doc_id)) & (last >= F.lit(doc_id))))
    for m in near.orderBy("shard").toLocalIterator():
        with open_input(m["index"]) as f:
            at = ShardIndex(f).find(key)
        if at:
            with open_input(m["payload"]) as f:
                f.seek(at[0] * dtype.itemsize)
                return np.frombuffer(f.read(at[1] * dtype.itemsize), dtype).tolist()
    return None


def tokenized(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write docs as token files and read them back: doc_id, start, n_tokens, ids_crc32, copy."""
    spark = docs.sparkSession
    manifest = write_tokens(docs, shared_folder(spark, "token-files"), vocabulary)
    return read_tokens(spark, manifest, vocabulary).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
