"""Toxicity: a small convolutional text classifier in numpy.

Words are hashed to embeddings, the sum of one for the word and one for its
first bytes, so that forms of a stem share what is learned; filters of several
widths slide over them, each keeps its largest activation in the text (max pooling), and a logistic layer
turns these into a score. Training is Adam on mini-batches over every labelled
row and its whole text: the rows are dealt to shards of some ``SHARD_ROWS`` (at most
``MAX_SHARDS``, which grow with the rows), each shard trains from the same
model over its rows in chunks, and the shards' models are averaged, an embedding
over the shards that moved it; ``ROUNDS`` times where there are several shards.
A fifth of the rows is set aside to calibrate the
score to the classes' shares and to set a threshold per language. The language
is no input of the score.

For scoring, each filter column is folded into the embedding table first, so a
convolution is a sum of table rows. Whole texts are read in blocks.

Without rows the result is empty. A null or word-free text has the activations of padding and so one fixed score.
Without labels of both classes the score is the share of label 1, or 0.5
without labels.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitals.llm.blocks import Words, bounded_batches, lower_ascii, mix64, text_blocks, utf8_buffer, utf8_list
from vitals.llm.compress_classifier import LabelledRows, fit_logistic, prior

SHARD_ROWS = 8000
MAX_SHARDS = 64
ROUNDS = 3
CHUNK_ROWS = 4000
CHUNK_BYTES = 16 << 20
BATCH_BYTES = 128 << 10
LOGIT_STEPS = 64
LOGIT_MOST = 64
SLICE_ROWS = 4096
BUCKETS = 1 << 16
PREFIX_BYTES = 4
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 6
MIN_STEPS = 1500
BATCH = 64
THRESHOLD = 0.3

_PAD = 2 * (max(WIDTHS) - 1)
PAD_ROW = 2 * BUCKETS
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True


def padded_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of the embedding per word (2, n) with padding behind each text, first and end position per text)."""
    w = Words(lower_ascii(data), offsets, IS_WORD)
    n = w.counts
    first = np.cumsum(n + _PAD) - (n + _PAD)
    out = np.full((2, int((n + _PAD).sum())), PAD_ROW, np.int32)
    at = np.arange(len(w)) + w.doc * _PAD
    mask = np.uint64(BUCKETS - 1)
    head = np.zeros(len(w), np.uint64)
    for j in range(PREFIX_BYTES):
        place = np.minimum(w.start + j, w.end - 1)
        byte = np.where(w.start + j < w.end, w.data[place], 0) if len(w) else head
        head = head << np.uint64(8) | byte.astype(np.uint64)
    out[0, at] = (w.hashes() & mask).astype(np.int32)
    out[1, at] = (mix64(head) & mask).astype(np.int32) + BUCKETS
    return out, first, first + n + max(WIDTHS) - 1


def _block(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    off = np.cumsum([0, *map(len, texts)])
    return np.frombuffer(b"".join(texts), np.uint8), off


@dataclass
class ToxicityModel:
    embed: np.ndarray                       # (2 * BUCKETS + 1, DIM): words, prefixes, padding
    conv: list[np.ndarray]                  # per width (FILTERS, width, DIM)
    bias: list[np.ndarray]
    out: np.ndarray                         # (len(WIDTHS) * FILTERS,)
    const: float = 0.0
    calibration: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)
    common: float | None = None             # of languages without a threshold
    prior: float | None = None              # score of an untrained model

    def tables(self) -> list[list[np.ndarray]]:
        return [[(self.embed @ c[:, j].T).astype(np.float32) for j in range(c.shape[1])] for c in self.conv]

    def logits(self, data: np.ndarray, offsets: np.ndarray, tables=None) -> np.ndarray:
        h, first, end = padded_buckets(data, offsets)
        cuts = np.column_stack([first, end]).ravel()
        n = h.shape[1] - _PAD // 2
        z = np.full(len(first), self.const)
        for k, (table, bias) in enumerate(zip(tables or self.tables(), self.bias)):
            a = table[0][h[0, :n]]
            a += table[0][h[1, :n]]
            for j in range(1, len(table)):
                for kind in h:
                    a += table[j][kind[j:j + n]]
            top = np.maximum.reduceat(a, np.minimum(cuts, n - 1), axis=0)[::2]
            z += np.maximum(top + bias, 0) @ self.out[k * FILTERS:(k + 1) * FILTERS]
        return z

    def score(self, data: np.ndarray, offsets: np.ndarray, tables=None) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(offsets) - 1, self.prior)
        z = self.logits(data, offsets, tables) * self.calibration[0] + self.calibration[1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.state = rate, 0, {}

    def step(self, key, value: np.ndarray, grad: np.ndarray, rows=None) -> None:
        m, v = self.state.setdefault(key, (np.zeros_like(value), np.zeros_like(value)))
        at = slice(None) if rows is None else rows
        m[at] = 0.9 * m[at] + 0.1 * grad
        v[at] = 0.99 * v[at] + 0.01 * grad * grad
        fix = np.sqrt(1 - 0.99 ** self.t) / (1 - 0.9 ** self.t)
        value[at] -= self.rate * fix * m[at] / (np.sqrt(v[at]) + 1e-6)


def _train_step(model: ToxicityModel, adam: _Adam, h, first, end, y, weight) -> None:
    docs = len(first)
    tops, places = [], []
    vectors = model.embed[h[0]] + model.embed[h[1]]
    for c, b in zip(model.conv, model.bias):
        width = c.shape[1]
        n = h.shape[1] - _PAD // 2
        a = sum(vectors[j:j + n] @ c[:, j].T for j in range(width)) + b
        place = np.stack([a[s:e].argmax(0) + s for s, e in zip(first, np.minimum(end, n))])
        places.append(place)
        tops.append(np.maximum(np.take_along_axis(a, place, 0), 0))
    x = np.concatenate(tops, 1)
    z = x @ model.out + model.const
    g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / docs
    dx = np.where(x > 0, g[:, None] * model.out[None], 0)
    adam.t += 1
    touched, grads = [], []
    for k, c in enumerate(model.conv):
        d = dx[:, k * FILTERS:(k + 1) * FILTERS]
        dc = np.zeros_like(c)
        for j in range(c.shape[1]):
            at = places[k] + j
            dc[:, j] = np.einsum("df,dfe->fe", d, vectors[at])
            for kind in h:
                touched.append(kind[at].ravel())
                grads.append((d[:, :, None] * c[None, :, j]).reshape(-1, DIM))
        adam.step(("b", k), model.bias[k], d.sum(0))
        adam.step(("c", k), c, dc + 1e-5 * c)
    rows, inverse = np.unique(np.concatenate(touched), return_inverse=True)
    ge = np.zeros((len(rows), DIM))
    np.add.at(ge, inverse, np.concatenate(grads))
    real = rows < PAD_ROW
    adam.step("e", model.embed, ge[real] + 1e-5 * model.embed[rows[real]], rows[real])
    out = model.out.copy()
    adam.step("o", model.out, x.T @ g + 1e-4 * out)
    const = np.array([model.const])
    adam.step("k", const, np.array([g.sum()]))
    model.const = float(const[0])


def _initial(seed: int) -> ToxicityModel:
    rng = np.random.default_rng(seed)
    width = len(WIDTHS) * FILTERS
    return ToxicityModel(
        np.vstack([rng.normal(0, 0.1, (2 * BUCKETS, DIM)), np.zeros((1, DIM))]),
        [rng.normal(0, 0.4, (FILTERS, k, DIM)) for k in WIDTHS], [np.zeros(FILTERS) for _ in WIDTHS],
        rng.normal(0, 0.3, width))


def _small(model: ToxicityModel) -> np.ndarray:
    """All parameters but the embeddings in a row."""
    return np.concatenate([*(c.ravel() for c in model.conv), *model.bias, model.out, [model.const]])


def _with_small(model: ToxicityModel, values: np.ndarray) -> None:
    at = 0
    for group in (model.conv, model.bias, [model.out]):
        for x in group:
            x[...] = values[at:at + x.size].reshape(x.shape)
            at += x.size
    model.const = float(values[at])


def _chunk_passes(model: ToxicityModel, adam: _Adam, rng, texts: list[bytes], y: np.ndarray, weight: np.ndarray,
                  passes: int, touched: np.ndarray) -> None:
    """Mini-batches over a chunk of texts, of ``BATCH`` texts and some ``BATCH_BYTES`` at most."""
    hashed = [padded_buckets(*_block([t]))[0] for t in texts]
    for h in hashed:
        touched[h] = True
    sizes = np.array([len(t) for t in texts])
    for _ in range(passes):
        order = rng.permutation(len(texts))
        a = 0
        while a < len(order):
            fits = int(np.searchsorted(np.cumsum(sizes[order[a:a + BATCH]]), BATCH_BYTES, "right"))
            pick = order[a:a + max(1, fits)]
            a += len(pick)
            h = np.concatenate([hashed[i] for i in pick], 1)
            size = np.array([hashed[i].shape[1] for i in pick])
            first = np.cumsum(size) - size
            _train_step(model, adam, h, first, first + size - _PAD + max(WIDTHS) - 1, y[pick], weight[pick])


_UPDATE = "slice int, shard int, n long, at binary, rows binary"


def _round(seen: DataFrame, model: ToxicityModel, weight: dict[int, float], passes: int, seed: tuple[int, ...]) -> None:
    """One round: every shard trains from ``model`` over its rows; the averages go into ``model``."""
    shared = seen.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        shard = TaskContext.get().partitionId()
        own = copy.deepcopy(shared.value)
        adam, rng = _Adam(0.01), np.random.default_rng((*seed, shard))
        touched = np.zeros(PAD_ROW + 1, bool)
        texts, ys, used, n = [], [], 0, 0

        def train_chunk():
            y = np.array(ys, float)
            _chunk_passes(own, adam, rng, texts, y, np.where(y == 1, weight[1], weight[0]), passes, touched)
            texts.clear()
            ys.clear()

        for b in batches:
            for text, y in zip(utf8_list(b.column("text")), b.column("y").to_pylist()):
                texts.append(text)
                ys.append(y)
                used, n = used + len(text), n + 1
                if len(texts) >= CHUNK_ROWS or used >= CHUNK_BYTES:
                    train_chunk()
                    used = 0
        if texts:
            train_chunk()
        if not n:
            return
        touched[PAD_ROW] = False
        parts = [(-1, b"", _small(own).tobytes())]
        for s in range(0, PAD_ROW, SLICE_ROWS):
            at = np.flatnonzero(touched[s:s + SLICE_ROWS]).astype(np.int32)
            if len(at):
                parts.append((s // SLICE_ROWS, at.tobytes(), own.embed[s + at].tobytes()))
        for part, at, rows in parts:
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([n], pa.int64()),
                 pa.array([at], pa.binary()), pa.array([rows], pa.binary())], ["slice", "shard", "n", "at", "rows"])

    def averaged(key, table):
        found = sorted(table.to_pylist(), key=lambda r: r["shard"])
        n = np.array([r["n"] for r in found], float)
        if key[0].as_py() < 0:
            at, rows = b"", np.average([np.frombuffer(r["rows"]) for r in found], axis=0, weights=n)
        else:
            total, by = np.zeros((SLICE_ROWS, DIM)), np.zeros(SLICE_ROWS)
            for r in found:
                own = np.frombuffer(r["at"], np.int32)
                total[own] += r["n"] * np.frombuffer(r["rows"]).reshape(-1, DIM)
                by[own] += r["n"]
            moved = np.flatnonzero(by).astype(np.int32)
            at, rows = moved.tobytes(), total[moved] / by[moved, None]
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "at": pa.array([at], pa.binary()),
                         "rows": pa.array([rows.tobytes()], pa.binary())})

    updates = seen.select("text", F.col("y").cast("int").alias("y")).mapInArrow(run, _UPDATE)
    # the model's own size at most comes to the driver, however many rows and shards there are
    for r in updates.groupBy("slice").applyInArrow(averaged, "slice int, at binary, rows binary").toLocalIterator():
        values = np.frombuffer(r["rows"])
        if r["slice"] < 0:
            _with_small(model, values)
        else:
            model.embed[r["slice"] * SLICE_ROWS + np.frombuffer(r["at"], np.int32)] = values.reshape(-1, DIM)
    shared.unpersist()


def _logit_counts(held: DataFrame, model: ToxicityModel) -> list:
    """(lang, z, y, n): how many of the held rows have a logit, to 1 / ``LOGIT_STEPS``; all rows count."""
    shared = held.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        tables = shared.value.tables()
        for b in text_blocks(batches, "text"):
            z = shared.value.logits(*utf8_buffer(b.column("text")), tables)
            z = np.rint(np.clip(z, -LOGIT_MOST, LOGIT_MOST) * LOGIT_STEPS) / LOGIT_STEPS
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(z), b.column("y")], ["lang", "z", "y"])

    rows = held.select("text", F.coalesce("lang", F.lit("")).alias("lang"), F.col("y").cast("int").alias("y"))
    found = rows.mapInArrow(run, "lang string, z double, y int").groupBy("lang", "z", "y").agg(F.count("*").alias("n"))
    return sorted((r["lang"], r["z"], r["y"], r["n"]) for r in found.collect())


def fit(labelled: LabelledRows, epochs: int = EPOCHS, seed: int = 11) -> ToxicityModel:
    """Fit on all labelled rows."""
    model = _initial(seed)
    share = prior(labelled.shares)
    if min(labelled.count(0), labelled.count(1)) < 2:
        model.prior = share
        return model
    seen, held, seen_folds, _ = labelled.split([0, 5])
    n = {y: labelled.count(y, seen_folds) for y in (0, 1)}
    total = n[0] + n[1]
    weight = {y: 0.5 * total / n[y] for y in (0, 1)}
    steps = -(-max(total * BATCH_BYTES, labelled.bytes * BATCH) // (BATCH * BATCH_BYTES * labelled.shards))
    passes, rounds = max(epochs, MIN_STEPS // steps), 1 if labelled.shards == 1 else ROUNDS
    for k in range(rounds):
        _round(seen, model, weight, -(-passes // rounds), (seed, k))
    langs, z, yh, count = (np.array(c) for c in zip(*_logit_counts(held, model)))
    yh, count = yh.astype(float), count.astype(float)
    per = {1: share / count[yh == 1].sum(), 0: (1 - share) / count[yh == 0].sum()}
    wh = np.where(yh == 1, per[1], per[0]) * count * count.sum()
    mean = np.average(z, weights=count)
    scale = max(float(np.sqrt(np.average((z - mean) ** 2, weights=count))), 1e-6)
    a, b = fit_logistic((z / scale)[:, None], yh, wh, ridge=1e-2)
    model.calibration = (float(a) / scale, float(b))
    scores = 1 / (1 + np.exp(-np.clip(z * model.calibration[0] + model.calibration[1], -30, 30)))
    model.thresholds, model.common = _thresholds(scores, yh, wh, langs.tolist())
    return model


def _thresholds(s: np.ndarray, y: np.ndarray, w: np.ndarray, langs: list[str]) -> tuple[dict[str, float], float]:
    """Per language (no language is "") the threshold of the best weighted F1; and the common one, for those without both labels."""
    lang = np.array(langs)

    def best(mask):
        order = np.argsort(-s[mask], kind="stable")
        ss, yy, ww = s[mask][order], y[mask][order], w[mask][order]
        hit, used = np.cumsum(yy * ww), np.cumsum(ww)
        f1 = 2 * hit / (used + (yy * ww).sum())
        f1[:-1][ss[1:] == ss[:-1]] = -1  # equal scores are flagged together
        k = int(np.argmax(f1))
        below = ss[k + 1] if k + 1 < len(ss) else 0.0
        return float((ss[k] + below) / 2)

    common = best(np.ones(len(s), bool))
    out = {}
    for x in sorted(set(langs)):
        m = lang == x
        if 0 < y[m].sum() < m.sum():
            out[x] = best(m)
    return out, common


def train(docs: DataFrame, labels: DataFrame, label: str, train_rows: Column) -> ToxicityModel:
    with LabelledRows(docs, labels, label, train_rows, ("lang",), SHARD_ROWS, MAX_SHARDS) as labelled:
        return fit(labelled)


def score(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",),
          text: str = "text", out: str = "score") -> DataFrame:
    """The ``keep`` columns of every row and the score of its whole text."""
    src = docs.select(*keep, F.col(text).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        tables = shared.value.tables()
        for b in text_blocks(batches, "__text"):
            s = shared.value.score(*utf8_buffer(b.column("__text")), tables)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(s)], [*keep, out])
    bounded_batches(docs.sparkSession)
    return src.mapInArrow(run, src.drop("__text").schema.add(out, "double"))


def flagged(scored: DataFrame, model: ToxicityModel, lang: str = "lang", score_column: str = "score") -> Column:
    """Whether the score reaches the threshold of the row's language."""
    common = THRESHOLD if model.common is None else model.common
    pairs = [F.lit(x) for kv in model.thresholds.items() for x in kv]
    limit = F.coalesce(F.create_map(*pairs)[F.coalesce(F.col(lang), F.lit(""))], F.lit(common)) if pairs else F.lit(common)
    return F.col(score_column) >= limit
