"""A keyed table of documents that is merged when it is read.

A write adds one folder with only the rows that it brings, cut into buckets by a
hash of the key, and commits a manifest: the folders that make up a version. A
manifest is put in place by a rename that fails if the version exists, so of two
writers one wins; the other commits its folder on top, or fails if it asked for
the version that it had read. Readers plan on one manifest and see one version.
Buckets that one folder holds are read as they lie; only those with later
changes are merged, and compaction makes one folder of these again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders of a version beyond which a write compacts, and tries of a commit that others overtake.
MOST_PARTS, TRIES = 16, 20
BUCKET, SEQ, GONE = "__bucket", "__seq", "__gone"


class Conflict(PySparkException):
    """The version that a writer had read is no longer the newest."""


class KeyedStore:
    """One row for each key: that with the largest `at`, of equal ones the one written last.

    merge: a column that is null in a later row keeps its earlier value.
    sums: columns whose values are added up over all rows of a key. A null key
    is a key. Other columns may have any names that do not start with __.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, at: str, *, buckets: int = 32, merge: bool = False, sums: Sequence[str] = ()):
        self.spark, self.path, self.key, self.at, self.buckets, self.merge, self.sums = spark, path.rstrip("/"), key, at, buckets, merge, tuple(sums)
        self._fs_package = spark._jvm.org.apache.hadoop.fs
        self._files = self._fs_package.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- manifests

    def _place(self, *names: str):
        return self._fs_package.Path("/".join([self.path, *names]))

    def versions(self) -> list[int]:
        folder = self._place("_versions")
        if not self._files.exists(folder):
            return []
        return sorted(int(f.getPath().getName()[:-5]) for f in self._files.listStatus(folder) if f.getPath().getName().endswith(".json"))

    def version(self) -> int:
        """The newest version; 0 before the first write."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "parts": [], "applied": {}}
        lines = self.spark.read.option("wholetext", True).text(f"{self.path}/_versions/{version:010d}.json").collect()
        return json.loads(lines[0][0])

    def _commit(self, manifest: dict) -> bool:
        """Whether this manifest became its version."""
        own = self._place("_versions", f".{uuid.uuid4().hex}")
        out = self._files.create(own, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = self._fs_package.FileContext.getFileContext(own.toUri(), self.spark._jsc.hadoopConfiguration()) if "://" in self.path else self._fs_package.FileContext.getFileContext(self.spark._jsc.hadoopConfiguration())
        kind = self._fs_package.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.NONE
        try:
            context.rename(context.makeQualified(own), context.makeQualified(self._place("_versions", f"{manifest['version']:010d}.json")), how)
        except Exception as e:
            self._files.delete(own, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def _advance(self, change: Callable[[dict], dict | None], expected: int | None) -> int:
        """Commit change(newest manifest) as the next version; None leaves the store as it is."""
        for _ in range(TRIES):
            last = self.manifest()
            if expected is not None and last["version"] != expected:
                raise Conflict(f"the store is at version {last['version']}, not {expected}")
            new = change(json.loads(json.dumps(last)))
            if new is None:
                return last["version"]
            new["version"] = last["version"] + 1
            if self._commit(new):
                return new["version"]
        raise Conflict(f"{TRIES} commits were overtaken")

    # ---- rows

    def _part(self, rows: DataFrame) -> tuple[str, list[int]]:
        """Write rows (with BUCKET) to a folder of their own; its name and buckets."""
        name = uuid.uuid4().hex
        rows.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/parts/{name}")
        found = [f.getPath().getName() for f in self._files.listStatus(self._place("parts", name))]
        return name, sorted(int(f.partition("=")[2]) for f in found if f.startswith(BUCKET))

    def _merged(self, rows: DataFrame) -> DataFrame:
        """One row for each key of rows with SEQ and GONE."""
        order = F.struct(self.at, SEQ)
        each = W.partitionBy(self.key)
        # what came before the last removal of a key is gone
        rows = rows.withColumn("__end", F.max(F.when(F.col(GONE), order)).over(each)).where(F.col("__end").isNull() | (order > F.col("__end")))
        plain = [c for c in rows.columns if c not in (self.key, SEQ, GONE, BUCKET, "__end", *self.sums)]
        if self.merge:
            own = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in plain]
        else:
            own = [F.max_by(F.struct(*plain), order).alias("__row")]
        out = rows.groupBy(self.key).agg(*own, *(F.sum(c).alias(c) for c in self.sums))
        return out if self.merge else out.select(self.key, "__row.*", *self.sums)

    def _read(self, parts: list[dict], schema: T.StructType, buckets: list[int] | None = None) -> DataFrame | None:
        """Rows of some buckets (of all) of the parts, with SEQ and GONE."""
        full = T.StructType([*schema, T.StructField(GONE, T.BooleanType()), T.StructField(BUCKET, T.IntegerType())])
        out = []
        for p in parts:
            own = [b for b in p["buckets"] if buckets is None or b in buckets]
            if own:
                out.append(self.spark.read.schema(full).parquet(f"{self.path}/parts/{p['folder']}").where(F.col(BUCKET).isin(own)).withColumn(SEQ, F.lit(p["seq"])))
        return reduce(DataFrame.unionByName, out) if out else None

    def _changed(self, parts: list[dict]) -> list[int]:
        """Buckets that more than one part holds, or one with removals."""
        held: dict[int, int] = {}
        for p in parts:
            for b in p["buckets"]:
                held[b] = held.get(b, 0) + (1 if p["whole"] else 2)
        return sorted(b for b, n in held.items() if n > 1)

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version (the newest). A store without a write has no columns yet and raises ValueError."""
        manifest = self.manifest(version)
        if manifest["schema"] is None:
            raise ValueError(f"nothing has been written to {self.path}")
        schema = T.StructType.fromJson(manifest["schema"])
        changed = self._changed(manifest["parts"])
        still = sorted({b for p in manifest["parts"] for b in p["buckets"]} - set(changed))
        out = [x.select(*schema.names) for x in [self._read(manifest["parts"], schema, still)] if x is not None]
        merged = self._read(manifest["parts"], schema, changed)
        if merged is not None:
            out.append(self._merged(merged).select(*schema.names))
        return reduce(DataFrame.unionByName, out) if out else self.spark.createDataFrame([], schema)

    def get(self, keys: Sequence, version: int | None = None) -> DataFrame:
        """The rows of some keys (a stated list; None is the null key). Only the buckets that these keys fall into are read."""
        manifest = self.manifest(version)
        if manifest["schema"] is None:
            raise ValueError(f"nothing has been written to {self.path}")
        schema = T.StructType.fromJson(manifest["schema"])
        asked = self.spark.createDataFrame([(k,) for k in keys], T.StructType([T.StructField("k", schema[self.key].dataType)]))
        buckets = sorted({r[0] for r in asked.select(F.pmod(F.xxhash64("k"), F.lit(self.buckets))).collect()})
        one = F.col(self.key).isin([k for k in keys if k is not None])
        one = one | F.col(self.key).isNull() if None in keys else one
        rows = self._read(manifest["parts"], schema, buckets)
        if rows is None:
            return self.spark.createDataFrame([], schema)
        return self._merged(rows.where(one)).select(*schema.names)

    def changes(self, since: int, until: int | None = None) -> DataFrame:
        """Rows written after version `since`, as they were written, with SEQ (their version) and GONE for removals.

        Compaction is no change, but folders that it replaced count only as long
        as `since` is not before it.
        """
        manifest = self.manifest(until)
        schema = T.StructType.fromJson(manifest["schema"])
        rows = self._read([p for p in manifest["parts"] if p["seq"] > since and not p.get("compacted")], schema)
        return rows.drop(BUCKET) if rows is not None else self.spark.createDataFrame([], T.StructType([*schema, T.StructField(GONE, T.BooleanType()), T.StructField(SEQ, T.IntegerType())]))

    # ---- writes

    def _write(self, rows: DataFrame, gone: bool, expected: int | None, batch: tuple[str, int] | None) -> int:
        def known(manifest: dict) -> bool:
            return batch is not None and manifest["applied"].get(batch[0], -1) >= batch[1]

        last = self.manifest()
        if known(last):
            return last["version"]
        if expected is not None and last["version"] != expected:
            raise Conflict(f"the store is at version {last['version']}, not {expected}")
        columns = [c for c in rows.columns]
        if not gone:
            rows = self._merged(rows.withColumn(SEQ, F.lit(0)).withColumn(GONE, F.lit(False))).select(*columns)
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
        if last["schema"] is not None:
            own = T.StructType.fromJson(last["schema"])
            rows = rows.select(*(F.col(f.name).cast(f.dataType) if f.name in columns else F.lit(None).cast(f.dataType).alias(f.name) for f in own))
            schema = own
        placed = rows.withColumn(GONE, F.lit(gone)).withColumn(BUCKET, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
        folder, buckets = self._part(placed)

        def change(manifest: dict) -> dict | None:
            if known(manifest):
                return None
            manifest["schema"] = manifest["schema"] or schema.jsonValue()
            if buckets:
                manifest["parts"].append({"folder": folder, "seq": manifest["version"] + 1, "buckets": buckets, "whole": not gone})
            if batch is not None:
                manifest["applied"][batch[0]] = batch[1]
            return manifest

        version = self._advance(change, expected)
        if len(self.manifest()["parts"]) > MOST_PARTS:
            version = self.compact()
        return version

    def upsert(self, rows: DataFrame, *, expected: int | None = None, batch: tuple[str, int] | None = None) -> int:
        """Write rows with the columns of the table (in any order; missing ones are null); returns the version.

        expected: fail with Conflict unless this is the newest version.
        batch: (name of a source, number); a number that was applied before changes nothing.
        """
        return self._write(rows, False, expected, batch)

    def remove(self, keys: DataFrame, *, expected: int | None = None) -> int:
        """Remove keys (columns key and at): what they had up to `at` is gone."""
        return self._write(keys.select(self.key, self.at), True, expected, None)

    def insert_new(self, rows: DataFrame) -> int:
        """Write rows whose key the store lacks; fails with Conflict if another writer commits meanwhile."""
        version = self.version()
        if version:
            rows = rows.join(self.read(version).select(F.col(self.key).alias("__known")), F.col(self.key).eqNullSafe(F.col("__known")), "left_anti")
        return self.upsert(rows, expected=version)

    def batches(self, name: str) -> Callable[[DataFrame, int], None]:
        """A foreachBatch function; a batch that is repeated after a failure changes nothing."""

        def run(rows: DataFrame, number: int) -> None:
            self.upsert(rows, batch=(name, number))

        return run

    def compact(self) -> int:
        """Make one folder of the buckets that have changes."""
        for _ in range(TRIES):
            manifest = self.manifest()
            changed = self._changed(manifest["parts"])
            if not changed:
                return manifest["version"]
            schema = T.StructType.fromJson(manifest["schema"])
            rows = self._merged(self._read(manifest["parts"], schema, changed)).select(*schema.names)
            rows = rows.withColumn(GONE, F.lit(False)).withColumn(BUCKET, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
            folder, buckets = self._part(rows)

            def change(new: dict, changed=changed, folder=folder, buckets=buckets) -> dict:
                parts = [p | {"buckets": [b for b in p["buckets"] if b not in changed]} for p in new["parts"]]
                new["parts"] = [p for p in parts if p["buckets"]]
                if buckets:
                    new["parts"].append({"folder": folder, "seq": new["version"] + 1, "buckets": buckets, "whole": True, "compacted": True})
                return new

            try:
                return self._advance(change, manifest["version"])
            except Conflict:
                continue  # another writer was first; its rows belong into the new folder
        raise Conflict(f"{TRIES} compactions were overtaken")

    def vacuum(self, keep: int = 2) -> int:
        """Delete folders that only versions before the newest `keep` have, and their manifests; returns how many folders."""
        versions = self.versions()
        old, new = versions[:-keep], versions[-keep:]
        folders = lambda vs: {p["folder"] for v in vs for p in self.manifest(v)["parts"]}
        unused = folders(old) - folders(new)
        for f in unused:
            self._files.delete(self._place("parts", f), True)
        for v in old:
            self._files.delete(self._place("_versions", f"{v:010d}.json"), False)
        return len(unused)
