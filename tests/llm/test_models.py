"""Classifiers: held-out accuracy, unlabelled and empty input; the pipeline; every query's schema."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline
from tests.conftest import SF_SMALL
from vitals.llm import compress_classifier, toxicity_cnn
from vitals.llm.blocks import crc32_fold, written
from vitals.llm.queries import REGISTRY, tokenizer_path

from . import brute as B


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("aeioubcdlmnrst", k=rng.randint(3, 8))) for _ in range(600)]
    rows, labels = [], []
    for i in range(900):
        text = rng.choices(words, k=rng.randint(40, 160))
        bad, toxic = i % 4 == 0, i % 3 == 0
        if toxic:
            for _ in range(4):
                text[rng.randrange(len(text))] = rng.choice(["vilex", "grubby", "snarl"])
        rows.append((i, (" | ".join(t.upper() + "!!" for t in text) if bad else " ".join(text)), "en"))
        labels.append((i, int(not bad), int(toxic)))
    labels += [(None, 1, 1), (5000, 0, 0), (3, None, None)]
    return (written(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "test-docs"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows)


def test_fold(spark):
    got = spark.createDataFrame([(i,) for i in range(200)] + [(None,)], "d long").select("d", crc32_fold(F.col("d"), 5)).collect()
    assert all(f == (None if d is None else zlib.crc32(str(d).encode()) % 5) for d, f in got)


def test_quality_held_out(labelled):
    docs, labels, rows = labelled
    model = compress_classifier.train(docs, labels, "quality", crc32_fold(F.col("doc_id"), 5) != 0)
    got = compress_classifier.score(docs, model).where(crc32_fold(F.col("doc_id"), 5) == 0).collect()
    right = sum((r["score"] >= 0.3) == (r["doc_id"] % 4 != 0) for r in got)
    assert right >= 0.97 * len(got)


def test_toxicity_held_out(labelled):
    docs, labels, rows = labelled
    model = toxicity_cnn.train(docs, labels, "toxic", crc32_fold(F.col("doc_id"), 4) != 2)
    scored = toxicity_cnn.score(docs, model, keep=("doc_id", "lang"))
    got = scored.withColumn("flag", toxicity_cnn.flagged(scored, model)).where(crc32_fold(F.col("doc_id"), 4) == 2).collect()
    assert sum((r["score"] >= 0.3) == (r["doc_id"] % 3 == 0) for r in got) >= 0.95 * len(got)
    assert sum(r["flag"] == (r["doc_id"] % 3 == 0) for r in got) >= 0.9 * len(got)


@pytest.mark.parametrize("module,label", [(compress_classifier, "quality"), (toxicity_cnn, "toxic")])
def test_odd_rows_and_no_labels(spark, docs, no_docs, module, label):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(0, 1, 1), (1, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        model = module.train(docs, labels, label, F.lit(True))
        got = module.score(docs, model).collect()
        assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got}) == 1
    mixed = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    model = module.train(docs, mixed, label, F.lit(True))
    got = module.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert module.score(no_docs, model).count() == 0


def test_scores_of_blocks_and_single_texts_agree(docs, spark):
    mixed = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    model = toxicity_cnn.train(docs, mixed, "toxic", F.lit(True))
    rows = docs.select("doc_id", "text").collect()
    one = Counter((r[0], round(float(model.score(*toxicity_cnn._block([(r[1] or "").encode()]))[0]), 5)) for r in rows)
    assert Counter((r[0], round(r[1], 5)) for r in toxicity_cnn.score(docs, model).collect()) == one


def _stages(spark, docs, sf_dir):
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), "test-stage")
        out.append(docs)
    return out


def test_last_stage_decodes(spark, docs, doc_rows):
    library = Tokenizer.from_file(tokenizer_path())
    got = corpus_pipeline.encode(spark, docs, SF_SMALL).select("doc_id", "ids", "decoded_sha256").collect()
    want = []
    for r in doc_rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], tuple(ids), B.sha(library.decode(ids, skip_special_tokens=False))))
    assert Counter((r[0], tuple(r[1]), r[2]) for r in got) == Counter(want)


def test_stages_on_odd_rows(spark, docs, doc_rows, monkeypatch):
    """Each stage against brute force over what the one before kept."""
    columns = docs.columns
    kept, dedup, clean, masked, ids = _stages(spark, docs, SF_SMALL)
    for stage in (kept, dedup, clean, masked):
        assert stage.columns == columns
    rows = kept.collect()
    low = {}
    low_code = B.components(list(range(len(rows))), [B.simhash(r["text"]) for r in rows])
    for r, c in zip(rows, low_code):
        key = (r["doc_id"] is None, r["doc_id"] or 0)
        low[c] = min(low.get(c, key), key)
    got = Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in dedup.collect())
    assert got == Counter(low.values())
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    want = Counter(r["doc_id"] for r in dedup.collect() if not B.contamination(r["text"], items)[1])
    assert Counter(r["doc_id"] for r in clean.collect()) == want
    texts = masked.collect()
    assert Counter(r["doc_id"] for r in texts) == want
    assert not any(B.base_spans(r["text"]) for r in texts)
    changed = {r["doc_id"]: r["text"] for r in clean.collect()}
    for r in texts:
        if r["text"] != changed[r["doc_id"]]:
            assert r["n_chars"] == len(r["text"]) and "[SECRET]" in r["text"]
    assert Counter(r["doc_id"] for r in ids.collect()) == want


def test_stages_on_an_empty_table(spark, no_docs):
    assert [s.count() for s in _stages(spark, no_docs, SF_SMALL)] == [0] * 5


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_registered(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    assert df.count() > 0
    table = {"op6_": "pages", "op9_": "pages", "op11": "embeddings"}.get(name[:4], "documents")
    if name == "op12_source_divergence_audit":
        docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
        per_lang = [r["n"] for r in docs.groupBy("lang").agg(F.count_distinct("source").alias("n")).collect()]
        assert df.where("part = 'pair'").count() == sum(n * (n - 1) for n in per_lang)
    elif name == "op13_spelling_variant_grouping":
        assert df.count() == df.select("word").distinct().count()
    elif name != "pipeline":
        assert df.count() == spark.read.parquet(f"{SF_SMALL}/{table}.parquet").count()


def test_rows_without_language_do_not_set_the_common_threshold():
    from vitals.llm.toxicity_cnn import _thresholds
    s = np.array([0.9, 0.8, 0.2, 0.1, 0.15, 0.12, 0.05, 0.01])
    y = np.array([1, 1, 0, 0, 1, 1, 0, 0])
    langs = ["en"] * 4 + [""] * 4
    own, common = _thresholds(s, y, np.ones(8), langs)
    assert set(own) == {"en", ""} and own[""] < common <= own["en"] + 1
    assert _thresholds(s, y, np.ones(8), ["xx"] * 8)[1] == common


@pytest.mark.parametrize("module,label", [(compress_classifier, "quality"), (toxicity_cnn, "toxic")])
def test_long_labelled_texts_are_learnt_and_shards_are_averaged(spark, module, label, monkeypatch):
    """Only long texts have label 1; every labelled row counts, in however many shards."""
    rng = random.Random(3)
    words = ["".join(rng.choices("aeioubcdlmnrst", k=5)) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=60)), "en") for i in range(12)]
    rows += [(100 + i, " ".join(rng.choices([*words, "vilex", "GRUB!"], k=5500)), "en") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], int(r[0] >= 100)) for r in rows], f"doc_id long, {label} int")
    monkeypatch.setattr(module, "SHARD_ROWS", 6)
    with compress_classifier.LabelledRows(docs, labels, label, F.lit(True), ("lang",), 6) as found:
        assert found.shards == 3 and found.count(1) == 4 and found.count(0) == 12
        assert found.rows.agg(F.max(F.length("text"))).first()[0] > 32 << 10
    got = {r["doc_id"]: r["score"] for r in module.score(docs, module.train(docs, labels, label, F.lit(True))).collect()}
    assert len(set(got.values())) > 1
    if module is toxicity_cnn:
        assert min(v for k, v in got.items() if k >= 100) > max(v for k, v in got.items() if k < 100)


def test_labelled_rows_join_by_id_and_few_other_texts_are_shuffled(spark):
    """Every (document, label) pair of an id once, whatever repeats or is null; rows without a label are left out before the shuffle."""
    rows = [(i % 50 if i < 60 else i, f"text {i % 55}" if i % 7 else None) for i in range(3000)] + [(None, "no id")]
    labels = [(i, i % 2) for i in range(0, 100, 3)] + [(3, 1), (6, 0), (6, 0), (None, 1), (9, None), (12, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id int, quality int")
    want = Counter((t or "", y) for d, t in rows for e, y in labels if d is not None and d == e and y in (0, 1))
    with compress_classifier.LabelledRows(docs, known, "quality", F.lit(True), (), 10) as found:
        assert Counter((r["text"], r["y"]) for r in found.rows.collect()) == want
        assert found.rows.rdd.getNumPartitions() == found.shards > 1
    ids = {e for e, y in labels if y in (0, 1)} - {None}
    read = compress_classifier._perhaps_labelled(docs, known.where("doc_id is not null")).collect()
    assert sum(r["doc_id"] in ids for r in read) == sum(d in ids for d, _ in rows)
    assert len(read) < len(rows) / 10
