"""Preparing a training corpus: quality, near copies, benchmark leaks, secrets, tokens.

Every stage takes (spark, docs, sf_dir) and works on all that the one before
kept; all but the last return the columns of ``documents``. ``run`` writes each
stage's rows as Parquet in the shared folder and reads them back, so a lost
executor costs one stage at most. The joins that filter rows are merge joins at every
size, as their lists of row numbers grow with the corpus. Rows are handled as rows: equal or null
doc_ids never merge or multiply them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitals.llm import bpe, compress_classifier, secrets, simhash_vp, winnowing
from vitals.llm.blocks import crc32_fold, written
from vitals.llm.queries import tokenizer_path
from vitals.sources.tables import table


def _new(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have (names are compared without case)."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows with a number of their own, stored so that the number stays, and the number's name."""
    row = _new(docs, "pipeline_row")
    return written(docs.withColumn(row, F.monotonically_increasing_id()), name), row


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    train = crc32_fold(F.col("doc_id"), 5) != 0
    model = compress_classifier.train(docs, table(spark, sf_dir, "labels"), "quality", train)
    out = _new(docs, "quality_score")
    scored = compress_classifier.score(docs, model, keep=tuple(docs.columns), out=out)
    return scored.where(F.col(out) >= compress_classifier.THRESHOLD).drop(out)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each near-duplicate class: the smallest doc_id (null last), then the first row."""
    rows, row = _numbered(docs, "dedup-docs")
    found = simhash_vp.near_duplicates(rows, words=3, radius=2, keep=("doc_id", row))
    first = found.groupBy("component").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("no_id"), "doc_id", row)).alias("first"))
    keep = first.select(F.col(f"first.{row}").alias(row)).hint("merge")
    return rows.join(keep, row, "left_semi").drop(row)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that share a window with a benchmark item."""
    rows, row = _numbered(docs, "decontaminate-docs")
    found = winnowing.contamination(rows, table(spark, sf_dir, "benchmark"), keep=(row,))
    hit = found.where("n_hit > 0").select(row).hint("merge")
    return rows.join(hit, row, "left_anti").drop(row)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mark; n_chars follows the text."""
    spans, text = _new(docs, "secret_spans"), _new(docs, "masked_text")
    found = secrets.find_secrets(docs, out=spans)
    masked = secrets.redacted(F.col("text"), F.col(spans))
    hit = F.size(spans) > 0
    out = found.withColumn(text, masked)
    changes = {"text": F.col(text)}
    if "n_chars" in docs.columns:
        changes["n_chars"] = F.when(hit, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select(*[changes.get(c, F.col(c)).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the corpus, decoded again: doc_id, lang, source, n_tokens, ids, ids_sha256, decoded_sha256."""
    return bpe.encode_documents(docs, tokenizer_path(), keep=("doc_id", "lang", "source"), digests=True)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("secret scans", mask_secrets),
    ("BPE encoding and decoding", encode),
]

#: The classifier's dictionaries, SimHash and BPE merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-").lower())
    return docs
