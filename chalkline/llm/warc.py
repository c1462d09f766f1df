"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent frames of about FRAME_BYTES; a bundle ends
with a seek table (a skippable frame that lists every frame's compressed and
plain size), so any frame can be read alone. An index maps each record to its
bundle, frame and place in the frame. Equal payloads are stored once: the
record of the smallest page_id is the response, the others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import create_folder, open_input, open_output
from .shared import shared_folder, text_bytes, written

FRAME_BYTES, BUNDLE_BYTES, LEVEL = 256 << 10, 64 << 20, 6
#: The seekable format: skippable frame, footer, and descriptor without checksums.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Parts in which the pages of one payload meet its first page.
SALTS = 8
DATE = "1970-01-01T00:00:00Z"
INDEX = "page_id string, bundle string, frame int, at int, length int"
READ = "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, url string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: str | None, copy: int) -> str:
    return f"<urn:nopage:{copy}>" if page_id is None else f"<urn:page:{page_id}:{copy}>"


def page_of(name: str) -> str | None:
    """The page of a record's id."""
    return name.removeprefix("<urn:page:").rpartition(":")[0] if name.startswith("<urn:page:") else None


def _line(name: str, value: str) -> bytes:
    safe = value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if name == "WARC-Target-URI" else value
    return f"{name}: {safe}\r\n".encode()


def record(page_id: str | None, copy: int, url: str | None, payload: bytes, payload_digest: str, refers_to: str | None, revisit: bool) -> bytes:
    """A response with its payload, or a revisit without."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    out = [b"WARC/1.1\r\n", _line("WARC-Type", "revisit" if revisit else "response"), _line("WARC-Record-ID", record_id(page_id, copy))]
    if url is not None:
        out.append(_line("WARC-Target-URI", url))
    out += [_line("WARC-Date", DATE), _line("WARC-Payload-Digest", f"sha1:{payload_digest}")]
    if revisit:
        out.append(_line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        out.append(_line("WARC-Refers-To", record_id(refers_to, 0)))
    out += [_line("Content-Type", "application/http; msgtype=response"), _line("Content-Length", str(len(block)))]
    return b"".join([*out, b"\r\n", block, b"\r\n\r\n"])


def parse(data: bytes, at: int = 0) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(headers, block, start, end) of each record of a frame."""
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        lines = data[at:head_end].decode().split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        start = head_end + 4
        end = start + int(headers["Content-Length"])
        yield headers, data[start:end], at, end + 4
        at = end + 4


class BundleWriter:
    """Frames, then the seek table."""

    def __init__(self, uri: str):
        self.out, self.zip = open_output(uri), zstandard.ZstdCompressor(level=LEVEL)
        self.sizes: list[tuple[int, int]] = []
        self.frame = bytearray()
        self.written = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Where the record went: frame, and place in it."""
        if self.frame and len(self.frame) + len(data) > FRAME_BYTES:
            self.flush()
        place = len(self.sizes), len(self.frame)
        self.frame += data
        return place

    def flush(self) -> None:
        if self.frame:
            packed = self.zip.compress(bytes(self.frame))
            self.out.write(packed)
            self.sizes.append((len(packed), len(self.frame)))
            self.written += len(packed)
            self.frame = bytearray()

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


def seek_table(f) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of each frame of an open bundle."""
    size = f.size()
    f.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    f.seek(size - 9 - 8 * n)
    entries, at, out = f.read(8 * n), 0, []
    for packed, plain in struct.iter_unpack("<II", entries):
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(f, entry: tuple[int, int, int]) -> bytes:
    f.seek(entry[0])
    return zstandard.ZstdDecompressor().decompress(f.read(entry[1]), max_output_size=entry[2])


def read_record(bundle: str, frame: int, at: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry, reading its frame only."""
    with open_input(bundle) as f:
        headers, block, _, _ = next(parse(read_frame(f, seek_table(f)[frame]), at))
        return headers, block


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0) -> DataFrame:
    """Write a record for every row of pages (page_id, url, html) under `path`; return the index.

    Payloads of least_bytes or more are stored once. Null html is an empty
    payload; null ids come after others, and of rows that repeat id and payload
    the first is as their id says and the rest revisit it. An empty table gives
    an empty index; other columns are not read; a payload longer than a frame
    has one of its own. Bundles of failed attempts stay unreferenced.
    """
    create_folder(path)
    # the digest decides what is equal; hot payloads meet in partial counts only
    rows = pages.select("page_id", "url", text_bytes("html").alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    keys = rows.where(F.length("payload") >= least_bytes).select("page_id", "digest")
    first = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # a payload may be that of a third of all pages
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keys = keys.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    revisits = keys.join(first, ["digest", "salt"]).where(~F.col("page_id").eqNullSafe(F.col("first"))).distinct()
    revisits = revisits.select("page_id", "digest", F.col("first").cast("string").alias("first"))
    # a mark that says whom a page revisits sorts just before the page; rows that repeat id and payload are neighbours
    marked = rows.withColumn("first", F.lit(None).cast("string")).withColumn("mark", F.lit(0))
    marks = revisits.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(b"").alias("payload"), "digest", "first", F.lit(1).alias("mark"))
    joined = marked.unionByName(marks).repartition("page_id", "digest").sortWithinPartitions("page_id", "digest", F.desc("mark"), "url")
    joined = joined.select(F.col("page_id").cast("string").alias("name"), "url", "payload", "digest", "first", "mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, uri, found = None, "", []
        last, copy, target = None, 0, None

        def finish():
            bundle.close()
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=names)
            found.clear()
            return out

        names = ["page_id", "bundle", "frame", "at", "length"]
        types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
        for b in batches:
            for row in zip(*b.columns, strict=True):
                name, url, payload, own, first, mark = (x.as_py() for x in row)
                if last != (name, own):
                    last, copy, target = (name, own), 0, None
                else:
                    copy += 1
                if mark:
                    target, copy = first, -1
                    continue
                own = base64.b32encode(own).decode()
                again = len(payload) >= least_bytes and (target is not None or copy > 0)
                if bundle is None:
                    uri = f"{path}/{uuid.uuid4().hex}.warc.zst"
                    bundle = BundleWriter(uri)
                data = record(name, copy, url, payload, own, (name if target is None else target) if again else None, again)
                frame, at = bundle.add(data)
                found.append((name, uri, frame, at, len(data)))
                if bundle.written >= BUNDLE_BYTES:
                    yield finish()
                    bundle = None
        if bundle is not None:
            yield finish()

    return written(joined.mapInArrow(run, INDEX), "warc-index")


def read_archive(spark: SparkSession, index: DataFrame) -> DataFrame:
    """Every record of the bundles that the index names, read back frame by frame, each bundle in a task of its own."""
    bundles = index.select("bundle").distinct()
    bundles = bundles.repartition(max(1, bundles.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ.split(", ")]
        for b in batches:
            for uri in b.column(0).to_pylist():
                with open_input(uri) as f:
                    for entry in seek_table(f):
                        rows = []
                        for headers, block, _, _ in parse(read_frame(f, entry)):
                            kind, cut = headers["WARC-Type"], block.index(b"\r\n\r\n") + 4
                            size = int(block[:cut].rsplit(b"Content-Length: ", 1)[1].split(b"\r\n", 1)[0])
                            code = headers["WARC-Payload-Digest"].removeprefix("sha1:") if kind == "revisit" else digest(block[cut:])
                            url = headers.get("WARC-Target-URI")
                            url = url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                            rows.append((page_of(headers["WARC-Record-ID"]), size if kind == "revisit" else len(block) - cut, code, kind, page_of(headers["WARC-Refers-To"]) if kind == "revisit" else None, url))
                        types = [pa.string(), pa.int64(), *[pa.string()] * 4]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return bundles.mapInArrow(run, READ)


def archived_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages to archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    spark = pages.sparkSession
    index = write_archive(pages, shared_folder(spark, "warc"), least_bytes)
    kind = pages.schema["page_id"].dataType
    out = read_archive(spark, index)
    return out.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))
