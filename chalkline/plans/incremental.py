"""An index of files that follows their changes: only changed files are cut anew, only new texts embedded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import documents
from ..sources.staging import staged
from ..sources.store import KeyedStore

Chunker = Callable[[DataFrame], DataFrame]


def tagged_chunks(files: DataFrame) -> DataFrame:
    return documents.tag(documents.chunk_markdown(files))


class IncrementalIndex:
    """Two keyed stores below a path.

    Of each file, one row has its content address (SHA-256 of the text) and all
    its chunks, so a changed file replaces its chunks in one commit. Of each
    distinct text to embed, one row has its vector. Vectors are committed
    before the chunks that need them, so readers never miss one.
    """

    def __init__(self, spark: SparkSession, path: str, embedder: Callable[[Column], Column], chunker: Chunker = tagged_chunks, buckets: int = 32):
        self.spark, self.embedder, self.chunker = spark, embedder, chunker
        self.files = KeyedStore(spark, f"{path.rstrip('/')}/files", "source_file", "at", buckets=buckets)
        self.vectors = KeyedStore(spark, f"{path.rstrip('/')}/vectors", "sha", "at", buckets=buckets)

    def _known(self) -> DataFrame | None:
        return self.files.read().select("source_file", "file_sha") if self.files.version() else None

    def sync(self, files: DataFrame, complete: bool = True) -> dict[str, int]:
        """Bring the index to files (source_file, text; of repeated names the largest text by SHA-256 counts).

        complete: files are all there are, so files of the index that they lack
        are removed. Returns how many files changed and were removed, and how
        many texts were embedded. A file without chunks is kept as such; a null
        text is an empty one. Running it again changes nothing.
        """
        now = files.select("source_file", F.coalesce("text", F.lit("")).alias("text")).withColumn("file_sha", F.sha2("text", 256))
        now = now.groupBy("source_file").agg(F.max_by("text", "file_sha").alias("text"), F.max("file_sha").alias("file_sha"))
        known, base, at = self._known(), self.files.version(), self.files.version() + 1
        if known is None:
            changed, gone = now, None
        else:
            old = known.select(F.col("source_file").alias("__name"), F.col("file_sha").alias("__sha"))
            changed = now.join(old, (F.col("source_file") == F.col("__name")) & (F.col("file_sha") == F.col("__sha")), "left_anti")
            gone = known.join(now, "source_file", "left_anti").select("source_file", F.lit(at).alias("at")) if complete else None
        changed = staged(changed, "changed-files")
        chunks = self.chunker(changed.select("source_file", "text")).withColumn("sha", F.sha2(F.coalesce("embed_text", F.lit("")), 256))
        chunks = staged(chunks, "changed-chunks")
        wanted = chunks.groupBy("sha").agg(F.first("embed_text").alias("text"))
        if self.vectors.version():
            wanted = wanted.join(self.vectors.read().select("sha"), "sha", "left_anti")
        new = staged(wanted.select("sha", self.embedder(F.col("text")).alias("embedding"), F.lit(0).alias("at")), "new-vectors")
        counts = {"changed": changed.count(), "removed": gone.count() if gone is not None else 0, "embedded": new.count()}
        if counts["embedded"]:
            self.vectors.upsert(new)
        if counts["removed"]:
            base = self.files.remove(gone, expected=base)
        if counts["changed"]:
            own = chunks.groupBy(F.col("source_file").alias("__name")).agg(F.sort_array(F.collect_list(F.struct("idx", F.struct(*chunks.columns).alias("chunk")))).alias("__chunks"))
            none = F.transform("__chunks", lambda c: c["chunk"])
            rows = changed.select("source_file", "file_sha").join(own, F.col("source_file") == F.col("__name"), "left")
            self.files.upsert(rows.select("source_file", F.lit(at).alias("at"), "file_sha", F.coalesce(none, F.slice(none, 1, 0)).alias("chunks")), expected=base)
        return counts

    def batches(self) -> Callable[[DataFrame, int], None]:
        """A foreachBatch function for a stream of new and changed files."""
        return lambda files, _: self.sync(files, complete=False) and None

    def index(self) -> DataFrame:
        """All chunks with index_name, a position and an embedding, as build_index() gives them."""
        chunks = self.files.read().select(F.explode("chunks").alias("c")).select("c.*")
        own = chunks.join(self.vectors.read().select("sha", "embedding"), "sha")
        return own.withColumn("index_name", text.content_index(F.col("content_type"))).withColumn("pos", F.xxhash64("chunk_id", "sha"))
