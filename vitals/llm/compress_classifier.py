"""Quality by compression: which of two dictionaries shortens a text more.

One zstandard dictionary is built from good and one from bad labelled text. A
text is compressed with both; the difference of the sizes over their sum says
which side it is like. How sure that is depends on how much text there is and
how well it compresses at all (very repetitive texts shrink alike with either),
so the calibration is a logistic curve over the difference, normalised by the
sum and by its root, and the size per byte and log length beside it. It is
fitted on labelled rows that the dictionaries did not see, weighted back to the
shares of the classes, and gives the score: the probability of label 1.

Training reads every labelled row with its whole text. Tasks train a dictionary
per ``CHUNK_BYTES`` of the texts they read; dictionaries of a class are then
trained into one, ``FAN_IN`` at a time. The rows of odd hash are those that the
dictionaries do not see; their sums give each Newton step of the curve. Scoring reads
every whole text. A null or empty text has both sizes and the difference zero
and gets the curve's value there. Without labels of both classes the score is
the share of label 1, or 0.5 without any label.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitals.llm.blocks import bounded_batches, text_blocks, utf8_list, written

CHUNK_BYTES = 8 << 20
FAN_IN = 16
PIECE_BYTES = 2 << 10
SHARD_ROWS = 32_000
DICT_BYTES = 112 << 10
LEVEL = 3
THRESHOLD = 0.3
MAP_BITS = 24


def _perhaps_labelled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id has a label, and some others: read by a bit map of ``MAP_BITS`` bits, so no text is shuffled."""
    bit = F.xxhash64(F.col("doc_id").cast("string")).bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    own = F.expr("shiftleft(1L, cast(map_bit & 63 as int))")
    words = known.select(bit.alias("map_bit")).groupBy(F.shiftright("map_bit", 6).alias("map_word")).agg(F.bit_or(own).alias("map_bits"))
    at = docs.withColumn("map_bit", bit).withColumn("map_word", F.shiftright("map_bit", 6))
    return at.join(F.broadcast(words), "map_word").where(F.col("map_bits").bitwiseAND(own) != 0).select(*docs.columns)


class LabelledRows:
    """Every labelled training row, kept on the executors' disks for the passes over it.

    ``rows``: text, y, ``extra`` and ``fold`` (0 to 9, by the hash of doc_id), dealt to ``shards`` partitions and
    ordered by a hash. Texts are shuffled once, at every size, and only those that a bit map of the labelled
    ids holds. ``shares``: label counts, of labels without a document too; ``counts``: rows by y and fold; ``bytes``: those
    of all texts.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, label: str, train: Column, extra: tuple[str, ...] = (),
                 shard_rows: int = SHARD_ROWS, max_shards: int | None = None):
        known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & train).select(
            "doc_id", F.col(label).alias("y"))
        self.shares = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
        total = sum(self.shares.values())
        self.shards = max(1, min(-(-total // shard_rows), max_shards or total))
        read = _perhaps_labelled(docs.select("doc_id", "text", *extra), known).withColumn("at", F.xxhash64(F.lit(1), "doc_id", "text"))
        ids = read.select("doc_id", "at").distinct().join(known, "doc_id")
        # a window takes the partitions as they are dealt, where a join may deal the texts anew
        own = F.collect_list("y").over(Window.partitionBy("at", "doc_id"))
        dealt = read.withColumn("is_row", F.lit(True)).unionByName(ids, allowMissingColumns=True).repartition(self.shards, "at")
        rows = dealt.withColumn("ys", own).where("is_row").select(
            F.coalesce("text", F.lit("")).alias("text"), F.explode("ys").alias("y"), *extra,
            F.pmod(F.xxhash64("doc_id"), F.lit(10)).cast("int").alias("fold"), "at")
        self.rows = rows.sortWithinPartitions("at", "y", "text").drop("at").persist(StorageLevel.DISK_ONLY)
        bounded_batches(docs.sparkSession)
        found = self.rows.groupBy("y", "fold").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).collect()
        self.counts = {(r["y"], r["fold"]): r["n"] for r in found}
        self.bytes = sum(r["b"] for r in found)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.rows.unpersist()

    def count(self, y: int, folds=range(10)) -> int:
        return sum(self.counts.get((y, f), 0) for f in folds)

    def split(self, held: list[int]) -> tuple[DataFrame, DataFrame, list[int], list[int]]:
        """(seen rows, held rows, their folds); where one of them lacks a label, both are all rows."""
        seen = [f for f in range(10) if f not in held]
        if not all(self.count(y, folds) for y in (0, 1) for folds in (seen, held)):
            seen = held = list(range(10))
        return self.rows.where(F.col("fold").isin(seen)), self.rows.where(F.col("fold").isin(held)), seen, held


def prior(shares: dict[int, int]) -> float:
    """The share of label 1, or 0.5 without labels."""
    return (shares.get(1, 0) + 0.5) / (shares.get(0, 0) + shares.get(1, 0) + 1)


def _newton(size: int, total: float, sums, ridge: float, steps: int) -> np.ndarray:
    """Weighted ridge logistic regression; ``sums(w)`` gives gradient and Hessian of all rows. The last value is the constant."""
    w = np.zeros(size)
    penalty = np.full(size, ridge * total)
    penalty[-1] = 0
    for _ in range(steps):
        grad, hess = sums(w)
        step = np.linalg.solve(hess + np.diag(penalty + 1e-9), grad + penalty * w)
        w -= step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _logistic_sums(a: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
    return a.T @ (weight * (p - y)), (a * (weight * p * (1 - p))[:, None]).T @ a


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3,
                 steps: int = 60) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; the last value is the constant."""
    a = np.column_stack([x, np.ones(len(x))])
    return _newton(a.shape[1], weight.sum(), lambda w: _logistic_sums(a, y, weight, w), ridge, steps)


@dataclass
class CompressionModel:
    bad: bytes
    good: bytes
    mean: list[float] = field(default_factory=lambda: [0.0] * 6)
    scale: list[float] = field(default_factory=lambda: [1.0] * 6)
    weights: list[float] = field(default_factory=lambda: [0.0] * 7)
    level: int = LEVEL

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for d in (self.bad, self.good):
            data = zstandard.ZstdCompressionDict(d)
            data.precompute_compress(level=self.level)
            out.append(zstandard.ZstdCompressor(level=self.level, dict_data=data, write_content_size=False,
                                                write_checksum=False, write_dict_id=False))
        return out

    def features(self, texts: list[bytes], compressors=None) -> np.ndarray:
        """The normalised size difference (positive: like good text) and what its weight depends on."""
        bad, good = compressors or self.compressors()
        size = np.array([(len(bad.compress(t)), len(good.compress(t)), len(t)) if t else (0, 0, 0)
                         for t in texts], float).reshape(-1, 3)
        total = np.maximum(size[:, 0] + size[:, 1], 1)
        diff = (size[:, 0] - size[:, 1]) / total
        ratio = np.minimum(size[:, 0], size[:, 1]) / np.maximum(size[:, 2], 1)
        return np.column_stack([diff, diff * np.sqrt(total), ratio, ratio * ratio, diff * ratio,
                                np.log1p(size[:, 2])])

    def score(self, texts: list[bytes], compressors=None) -> np.ndarray:
        x = (self.features(texts, compressors) - self.mean) / self.scale
        z = x @ np.array(self.weights[:-1]) + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _pieces(text: bytes) -> list[bytes]:
    return [text[i:i + PIECE_BYTES] for i in range(0, len(text), PIECE_BYTES)]


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary; of texts that are too few to train, one of their pieces, or the texts themselves."""
    for samples in (texts, [p for t in texts for p in _pieces(t)]):
        try:
            return zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:
            continue
    return b"\n".join(texts)[-size:]


def _dictionaries(seen: DataFrame, size: int) -> dict[int, bytes]:
    """A dictionary per label from all texts: one per chunk of a task's texts, then ``FAN_IN`` of a label into one."""
    def chunks(batches):
        held, used = {0: [], 1: []}, {0: 0, 1: 0}

        def out(y):
            d = _dictionary(held[y], size)
            held[y], used[y] = [], 0
            return pa.RecordBatch.from_arrays([pa.array([y], pa.int32()), pa.array([d], pa.binary())], ["y", "d"])

        for b in batches:
            for text, y in zip(utf8_list(b.column("text")), b.column("y").to_pylist()):
                if text:
                    held[y].append(text)
                    used[y] += len(text)
                    if used[y] >= CHUNK_BYTES:
                        yield out(y)
        for y in (0, 1):
            if held[y]:
                yield out(y)

    def merged(key, table):
        found = sorted(table.column("d").to_pylist())
        d = found[0] if len(found) == 1 else _dictionary([p for f in found for p in _pieces(f)], size)
        return pa.table({"y": pa.array([key[0].as_py()], pa.int32()), "d": pa.array([d], pa.binary())})

    parts = written(seen.select("text", F.col("y").cast("int").alias("y")).mapInArrow(chunks, "y int, d binary"), "dictionaries")
    while True:
        most = max((r[0] for r in parts.groupBy("y").count().select("count").collect()), default=0)
        if most <= 1:
            return {r["y"]: bytes(r["d"]) for r in parts.collect()}
        group = F.pmod(F.xxhash64("d"), F.lit(-(-most // FAN_IN))).alias("g")
        parts = written(parts.select("y", "d", group).groupBy("y", "g").applyInArrow(merged, "y int, d binary"), "dictionaries")


_FEATURES = [f"x{i}" for i in range(6)]


def _feature_rows(held: DataFrame, model: CompressionModel) -> DataFrame:
    """The features and y of every held row, stored."""
    shared = held.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        c = shared.value.compressors()
        for b in text_blocks(batches, "text"):
            x = shared.value.features(utf8_list(b.column("text")), c)
            yield pa.RecordBatch.from_arrays([*(pa.array(v) for v in x.T), b.column("y")], [*_FEATURES, "y"])

    schema = ", ".join(f"{c} double" for c in _FEATURES)
    return written(held.select("text", F.col("y").cast("int").alias("y")).mapInArrow(run, f"{schema}, y int"), "quality-features")


def _sums_of(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, weight: dict[int, float]):
    """The gradient and Hessian over all rows at given weights, added up per task."""
    size = len(mean) + 1

    def at(w: np.ndarray):
        def run(batches):
            grad, hess = np.zeros(size), np.zeros((size, size))
            for b in batches:
                x = np.column_stack([b.column(c).to_numpy() for c in _FEATURES])
                y = b.column("y").to_numpy().astype(float)
                g, h = _logistic_sums(np.column_stack([(x - mean) / scale, np.ones(len(x))]), y,
                                      np.where(y == 1, weight[1], weight[0]), w)
                grad, hess = grad + g, hess + h
            yield pa.RecordBatch.from_arrays([pa.array([grad.tolist()]), pa.array([hess.ravel().tolist()])], ["g", "h"])

        found = rows.mapInArrow(run, "g array<double>, h array<double>").collect()
        return (np.sum([r["g"] for r in found], axis=0), np.sum([r["h"] for r in found], axis=0).reshape(size, size))
    return at


def fit(labelled: LabelledRows, dict_bytes: int = DICT_BYTES) -> CompressionModel:
    """Fit on all labelled rows."""
    p = prior(labelled.shares)
    if min(labelled.count(0), labelled.count(1)) < 2:
        return CompressionModel(b"", b"", weights=[0.0] * 6 + [float(np.log(p / (1 - p)))])
    seen, held, _, held_folds = labelled.split([1, 3, 5, 7, 9])
    found = _dictionaries(seen, dict_bytes)
    model = CompressionModel(found.get(0, b""), found.get(1, b""))
    rows = _feature_rows(held, model)
    stats = rows.agg(*[F.avg(c) for c in _FEATURES], *[F.stddev_pop(c) for c in _FEATURES]).first()
    mean, scale = np.array(stats[:6]), np.maximum(np.array(stats[6:]), 1e-6)
    n = {y: labelled.count(y, held_folds) for y in (0, 1)}
    total = n[0] + n[1]
    weight = {1: p / max(1, n[1]) * total, 0: (1 - p) / max(1, n[0]) * total}
    w = _newton(7, n[0] * weight[0] + n[1] * weight[1], _sums_of(rows, mean, scale, weight), 1e-3, 60)
    model.mean, model.scale, model.weights = mean.tolist(), scale.tolist(), w.tolist()
    return model


def train(docs: DataFrame, labels: DataFrame, label: str, train_rows: Column) -> CompressionModel:
    with LabelledRows(docs, labels, label, train_rows) as labelled:
        return fit(labelled)


def score(docs: DataFrame, model: CompressionModel, keep: tuple[str, ...] = ("doc_id",),
          text: str = "text", out: str = "score") -> DataFrame:
    """The ``keep`` columns of every row and the score of its whole text."""
    src = docs.select(*[c for c in keep if c != text], F.col(text).alias("__text"))
    kept = docs.select(*keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        c = shared.value.compressors()
        for b in text_blocks(batches, "__text"):
            s = shared.value.score(utf8_list(b.column("__text")), c)
            yield pa.RecordBatch.from_arrays(
                [*(b.column("__text" if n == text else n) for n in keep), pa.array(s)], [*keep, out])
    bounded_batches(docs.sparkSession)
    return src.mapInArrow(run, kept.schema.add(out, "double"))
