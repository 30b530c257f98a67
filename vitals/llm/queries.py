"""Registered queries of the training-data operators, over whole tables.

Each query is thin: it reads its tables, applies one operator with its
production parameters and derives the digest columns.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitals.llm import (bpe, compress_classifier, grid_order, html_template, quality_rules, secrets, simhash_vp,
                        source_divergence, spelling_variants, token_files, toxicity_cnn, warc, winnowing)
from vitals.llm.blocks import crc32_fold
from vitals.llm.oracle import ORACLE
from vitals.sources.tables import table

TOKENIZER = "word_bpe_49k.json"
END_ID = 1


def tokenizer_path() -> str:
    return public_tokenizers.path(TOKENIZER)


def _sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs)
    base = F.filter("spans", lambda s: s["kind"] != "random")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        _sha256(secrets.listed(base)).alias("base_sha256"),
                        secrets.listed(F.col("spans")).alias("spans"), count("random"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash_vp.near_duplicates(docs, words=3, radius=2)
    return found.select("doc_id", simhash_vp.fp_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = winnowing.contamination(docs, table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        _sha256(F.array_join("items", ",")).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_documents(docs, tokenizer_path(), ids=False, digests=True)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    measured = quality_rules.measures(docs)
    m = [F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    conditions = quality_rules.rules(F.col("text"), *m)
    rejected_by = quality_rules.cascade(conditions, quality_rules.rule_order(docs))
    base = conditions["few_words"] | conditions["repeated_words"]
    return measured.select("doc_id", *m, base.alias("base_failed"), rejected_by.isNull().alias("kept"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_template.extract(pages).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = compress_classifier.train(docs, table(spark, sf_dir, "labels"), "quality", crc32_fold(F.col("doc_id"), 5) != 0)
    scored = compress_classifier.score(docs, model)
    return scored.select("doc_id", (crc32_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= compress_classifier.THRESHOLD).cast("int").alias("predicted"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.token_files(docs, tokenizer_path(), END_ID)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = toxicity_cnn.train(docs, table(spark, sf_dir, "labels"), "toxic", crc32_fold(F.col("doc_id"), 4) != 2)
    scored = toxicity_cnn.score(docs, model, keep=("doc_id", "lang"))
    return scored.select("doc_id", (crc32_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
                         (F.col("score") >= toxicity_cnn.THRESHOLD).cast("int").alias("predicted"),
                         toxicity_cnn.flagged(scored, model).alias("flagged_by_lang"))


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_order.near_vectors(table(spark, sf_dir, "embeddings"), least=0.9)


def op12_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op13_spelling_variant_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


_QUERIES = (op1_secret_scan, op2_simhash_near_dedup, op3_decontamination, op4_bpe, op5_quality_rules,
            op6_html_extraction, op7_quality_classifier, op8_token_files, op9_warc, op10_toxicity,
            op11_embedding_near_dedup, op12_source_divergence_audit,
            op13_spelling_variant_grouping, pipeline)

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    fn.__name__: (fn, ORACLE.get(fn.__name__)) for fn in _QUERIES}
