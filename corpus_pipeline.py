"""A training corpus from raw documents, in stages that are each written and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. docs has doc_id and text, and may have any
other columns, also of names that operators use; they are handed on as they are.
A null text is an empty one; rows without an id and rows that repeat an id stay
apart, but for copies, of which near-dedup keeps one; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.llm import bpe, decontamination, quality_classifier, secrets, simhash
from chalkline.llm.shared import shared_folder, table, text_bytes, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of operator 8 accepts."""
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality_classifier.score(model, text_bytes()) >= quality_classifier.THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of operator 2."""
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages, by operator 10."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the spans that operator 1 finds replaced by a mark; n_chars is that of the new text."""
    ledger = secrets.SecretLedger(spark, shared_folder(spark, "secret-ledger"))
    ledger.scan(docs)
    own = docs.withColumnRenamed("spans", "__kept_spans")  # the ledger's findings have a column of that name
    out = secrets.redact(ledger.findings(own)).withColumnRenamed("__kept_spans", "spans")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes, by operator 6."""
    encoded = bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.report(encoded)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("byte-level BPE encoding and decoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "pipeline")
    return docs


#: The stages learn, cluster and tokenize; SQL cannot express them.
ORACLE_SQL = None
