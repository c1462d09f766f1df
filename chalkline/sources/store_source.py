"""A keyed store as a data source: spark.read and spark.readStream.format("keyed_store").

Options: path, key, at. A batch reads one partition for each bucket, with
filters pushed into the Parquet scan and buckets without changes streamed as
they lie. A stream has versions as offsets and gives the rows that each version
wrote. Executors open the files themselves (local paths, hdfs:// and what else
pyarrow reads); where only Spark reads a store, use KeyedStore.read().
Pushdown needs spark.sql.python.filterPushdown.enabled.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pd
from pyarrow import fs
from pyspark.sql import datasource as D
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .store import GONE, SEQ, KeyedStore


def place(uri: str) -> tuple[fs.FileSystem, str]:
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parsed.path)
    return fs.FileSystem.from_uri(uri)


def manifest_of(path: str) -> dict:
    """The newest manifest; as KeyedStore.manifest(), without a session."""
    system, folder = place(f"{path}/_versions")
    names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.base_name.endswith(".json"))
    if not names:
        return {"version": 0, "schema": None, "parts": [], "applied": {}}
    with system.open_input_file(f"{folder}/{names[-1]}") as f:
        return json.loads(f.read())


#: Filters that Parquet scans take, as expressions of a field and a value.
PUSHED = {
    D.EqualTo: lambda f, v: f == v, D.GreaterThan: lambda f, v: f > v, D.GreaterThanOrEqual: lambda f, v: f >= v, D.LessThan: lambda f, v: f < v, D.LessThanOrEqual: lambda f, v: f <= v,
    D.In: lambda f, v: f.isin(list(v)),
}


def expression(f: D.Filter) -> pc.Expression | None:
    """A filter on a column of the table as an expression; None for others, which Spark applies."""
    if len(getattr(f, "attribute", ())) != 1:
        return None
    field = pc.field(f.attribute[0])
    if isinstance(f, D.IsNull):
        return field.is_null()
    if isinstance(f, D.IsNotNull):
        return field.is_valid()
    make = PUSHED.get(type(f))
    return make(field, f.value) if make else None


@dataclass
class Bucket(D.InputPartition):
    """Parts (folder, version, whole) of a bucket, oldest first; changed: whether they need a merge."""

    bucket: int
    parts: list[tuple[str, int, bool]]
    changed: bool


class _Files:
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path, to_arrow_schema(T.StructType([*schema, T.StructField(GONE, T.BooleanType())]))

    def scan(self, folder: str, bucket: int, where: pc.Expression | None = None) -> Iterator[pa.RecordBatch]:
        """Rows of a bucket of a part with GONE, a bounded number at a time."""
        system, at = place(f"{self.path}/parts/{folder}/__bucket={bucket}")
        data = pd.dataset(at, schema=self.schema, format="parquet", filesystem=system)
        yield from data.to_batches(filter=where, batch_size=1 << 14)


class StoreReader(D.DataSourceReader):
    def __init__(self, path: str, key: str, at: str, schema: T.StructType, manifest: dict):
        self.path, self.key, self.at, self.schema, self.manifest = path, key, at, schema, manifest
        self.where: pc.Expression | None = None
        self.names: list[str] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:  # noqa: N802 (the interface's name)
        for f in filters:
            own = expression(f)
            if own is None:
                yield f
            else:
                self.where = own if self.where is None else self.where & own

    def partitions(self) -> list[Bucket]:
        held: dict[int, list[tuple[str, int, bool]]] = {}
        for p in self.manifest["parts"]:
            for b in p["buckets"]:
                held.setdefault(b, []).append((p["folder"], p["seq"], p["whole"]))
        return [Bucket(b, parts, len(parts) > 1 or not parts[0][2]) for b, parts in sorted(held.items())]

    def read(self, partition: Bucket) -> Iterator[pa.RecordBatch]:
        files, columns = _Files(self.path, self.schema), self.schema.names
        (base, first, _), later = partition.parts[0], partition.parts[1:]
        if not partition.changed:
            for b in files.scan(base, partition.bucket, self.where):
                yield b.select(columns)
            return
        # rows of the changes are few; those of the oldest part go by, but for the keys that change
        changes = [(seq, b) for folder, seq, _ in later for b in files.scan(folder, partition.bucket)]
        rows = [r | {SEQ: seq} for seq, b in changes for r in b.to_pylist()]
        keys = pa.array(sorted({r[self.key] for r in rows} - {None}), files.schema.field(self.key).type)
        null = any(r[self.key] is None for r in rows)
        mine = pc.field(self.key).isin(keys) | (pc.field(self.key).is_null() if null else pc.scalar(False))
        others = ~pc.field(self.key).isin(keys) & (pc.field(self.key).is_valid() if null else pc.scalar(True)) & ~pc.field(GONE)
        for b in files.scan(base, partition.bucket, others if self.where is None else others & self.where):
            yield b.select(columns)
        rows += [r | {SEQ: first} for b in files.scan(base, partition.bucket, mine) for r in b.to_pylist()]
        best: dict = {}
        for r in rows:
            order = (r[self.at], r[SEQ])
            if r[self.key] not in best or order >= best[r[self.key]][0]:
                best[r[self.key]] = order, r
        kept = pa.Table.from_pylist([r for _, r in best.values() if not r[GONE]], files.schema)
        if self.where is not None:
            kept = kept.filter(self.where)
        yield from kept.select(columns).to_batches()


class ChangeReader(D.DataSourceStreamReader):
    """Rows as versions wrote them; removals are not among them."""

    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path, schema

    def initialOffset(self) -> dict:  # noqa: N802
        return {"version": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"version": manifest_of(self.path)["version"]}

    def partitions(self, start: dict, end: dict) -> list[Bucket]:
        parts = [p for p in manifest_of(self.path)["parts"] if start["version"] < p["seq"] <= end["version"] and p["whole"] and (not p.get("compacted") or start["version"] == 0)]
        return [Bucket(b, [(p["folder"], p["seq"], True)], False) for p in parts for b in p["buckets"]]

    def read(self, partition: Bucket) -> Iterator[pa.RecordBatch]:
        for b in _Files(self.path, self.schema).scan(partition.parts[0][0], partition.bucket):
            yield b.select(self.schema.names)

    def commit(self, end: dict) -> None:
        pass


class StoreSource(D.DataSource):
    """Stores whose rows the newest replaces; those that merge or sum columns are read with KeyedStore."""

    @classmethod
    def name(cls) -> str:
        return "keyed_store"

    def _path(self) -> str:
        return self.options["path"].rstrip("/")

    def schema(self) -> T.StructType:
        own = manifest_of(self._path())["schema"]
        if own is None:
            raise ValueError(f"nothing has been written to {self._path()}")
        return T.StructType.fromJson(own)

    def reader(self, schema: T.StructType) -> StoreReader:
        return StoreReader(self._path(), self.options["key"], self.options["at"], schema, manifest_of(self._path()))

    def streamReader(self, schema: T.StructType) -> ChangeReader:  # noqa: N802
        return ChangeReader(self._path(), schema)


def register(spark) -> None:
    spark.dataSource.register(StoreSource)


def frame(store: KeyedStore):
    """The newest version of a store through the data source."""
    register(store.spark)
    return store.spark.read.format("keyed_store").option("key", store.key).option("at", store.at).load(store.path)
