"""The queries over the driver's tables, by the operators of this package."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, decontamination, divergence, mixing, pii, quality_classifier, quality_rules, secrets, simhash, token_files, url_filter, warc
from .shared import fold_of, shared_folder, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secrets.SecretLedger(spark, shared_folder(spark, "secret-ledger"))
    ledger.scan(docs)
    return secrets.report(ledger.findings(docs))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.report(pii.find(docs, pii.fit(docs)))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_files.tokenized(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archived_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.report(bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    least = url_filter.fit_outcome(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return url_filter.judge(pages, url_filter.page_outcomes(pages, least))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    out = quality_classifier.quality_scores(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold_of() == 0).alias("held_out"), "score", "predicted")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    out = quality_rules.apply_rules(docs.select("doc_id", "text"), rules)
    return out.select("doc_id", *quality_rules.COUNTS[:5], "base_failed", "kept", "rule")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(mixing.copies(table(spark, sf_dir, "documents")))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = (
    op1_secret_scan, op2_simhash, op3_pii, op4_token_files, op5_warc, op6_bpe, op7_url_filter, op8_quality_classifier, op9_quality_rules, op10_decontamination,
    op11_source_mix, op12_source_divergence, op13_centroid_clusters,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op7_url_filter": url_filter.SQL, "op12_source_divergence": divergence.SQL, "op13_centroid_clusters": centroids.SQL}
