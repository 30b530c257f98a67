"""Near-duplicate vectors by the epsilon grid order join.

Two vectors link where the cosine of their double-precision values reaches a
threshold; on unit vectors that is a Euclidean distance of at most epsilon.

1. Principal directions are fitted on a bounded hash sample (``SAMPLE_ROWS``).
   Any orthonormal directions give the same result; good ones skip more.
2. Each unit vector gets its grid cells (side epsilon) on the leading ``AXES``
   directions. Sorting by cells, then by a digest of the components, then by
   vec_id makes the grid order; equal vectors that meet in a partition fold into one
   entry with a weight, so a vector with many copies costs as much as one.
3. Every partition writes its part of the sequence as pieces in the shared folder,
   with the bounding box of each. Runs of pieces form intervals of
   ``INTERVAL_ROWS`` entries at most.
4. A task joins one interval with a bounded run of others: both are halved
   recursively, and a pair of blocks is left out where their boxes are more
   than epsilon apart. What is left is compared as matrix products of single
   precision; whatever lies within their rounding error of the threshold is
   computed again in double precision.
5. A task returns link counts per entry and a spanning forest of its links, not
   the pairs. Star components of the forests give every vector its class.

Vectors that are null, empty, zero, or hold a null or non-finite component link
with nothing, and vectors link only with vectors of their own length. Rows
with equal vec_id are rows of their own; a null vec_id never names a class and is
not kept. Without rows the result is empty. Work stays quadratic where the vectors
leave nothing to skip, as independent directions in many dimensions do.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from vitals.llm.blocks import bounded_batches, written
from vitals.llm.components import connected_components
from vitals.llm.shared_files import folder, fresh_name, mapped
from vitals.session import scratch_path

SAMPLE_ROWS = 4096
AXES = 16
INTERVAL_ROWS = 4096
RUN_INTERVALS = 64
LEAF_ROWS = 512

_SLACK = 1e-9
_PIECE = "struct<name:string,first:long,dim:int,size:int,low:array<double>,high:array<double>>"


def _rows_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat components as doubles, offsets, usable) of a list column."""
    col = col.cast(pa.list_(col.type.value_type)) if not pa.types.is_list(col.type) else col
    lens = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten()
    holes = np.flatnonzero(flat.is_null().to_numpy(zero_copy_only=False))
    values = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(np.float64)
    off = np.concatenate([[0], np.cumsum(lens)])
    bad = ~np.isfinite(values)
    bad[holes] = True
    usable = lens > 0
    usable[np.searchsorted(off, np.flatnonzero(bad), "right") - 1] = False
    return values, off, usable


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; the largest component first, so that no square leaves the range."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def directions(sample: list[list[float]], axes: int) -> tuple[int, np.ndarray]:
    """(length, leading principal directions) of the sample's most frequent vector length."""
    rows = [x for x in sample if x and all(v is not None and np.isfinite(v) for v in x) and any(x)]
    if not rows:
        return 0, np.zeros((0, 0))
    lens = [len(x) for x in rows]
    dim = max(sorted(set(lens)), key=lens.count)
    x = unit(np.array([x for x in rows if len(x) == dim], np.float64))
    x = x - x.mean(axis=0)
    return dim, np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :axes]


class Projection:
    """Coordinates of unit vectors on fixed directions; vectors of another length lie at the origin."""

    def __init__(self, dim: int, axes: np.ndarray, epsilon: float):
        self.dim, self.axes, self.epsilon = dim, axes, epsilon

    def coordinates(self, x: np.ndarray) -> np.ndarray:
        if x.shape[1] != self.dim:
            return np.zeros((len(x), self.axes.shape[1]))
        return x @ self.axes

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The grid cells as bytes in the order of their numbers."""
        return np.clip(np.floor(self.coordinates(x) / self.epsilon) + 128, 0, 255).astype(np.uint8)


def _keyed(vectors: DataFrame, projection: Projection) -> DataFrame:
    """vec_id, vec, cells and digest; the last two are null where a vector links with nothing."""
    def run(batches):
        for b in batches:
            values, off, usable = _rows_of(b.column("vec"))
            lens = np.diff(off)
            cells: list = [None] * b.num_rows
            digests: list = [None] * b.num_rows
            for dim in np.unique(lens[usable]):
                at = np.flatnonzero(usable & (lens == dim))
                x = values[off[at][:, None] + np.arange(dim)]
                some = np.abs(x).max(axis=1) > 0
                at, x = at[some], x[some] + 0.0  # one zero, not two
                if not len(at):
                    continue
                head = int(dim).to_bytes(4, "big")
                for i, c, v in zip(at.tolist(), projection.cells(unit(x)), x):
                    cells[i] = head + c.tobytes()
                    digests[i] = blake2b(v.tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("vec"), pa.array(cells, pa.binary()), pa.array(digests, pa.binary())],
                ["vec_id", "vec", "cells", "digest"])
    return vectors.mapInArrow(run, vectors.select("vec_id", "vec").schema.add("cells", "binary").add("digest", "binary"))


class _Writer:
    """Folds equal neighbours of a sorted partition into entries and writes them in pieces."""

    def __init__(self, out_dir: str, partition: int, projection: Projection, kind: str):
        self.fs, self.path = folder(out_dir)
        self.projection, self.kind = projection, np.dtype(kind)
        self.entry = partition << 33
        self.last: bytes | None = None
        self.dim = 0
        self.vectors: list[np.ndarray] = []
        self.weights: list[int] = []

    def add(self, cells: bytes, digest: bytes, vector: np.ndarray) -> tuple[int, dict | None]:
        """The row's entry, and the piece that was closed before it."""
        closed = None
        if digest != self.last:
            if self.vectors and (len(self.vectors) >= INTERVAL_ROWS or len(vector) != self.dim):
                closed = self.close()
            self.last, self.dim = digest, len(vector)
            self.vectors.append(vector)
            self.weights.append(0)
        self.weights[-1] += 1
        return self.entry + len(self.vectors) - 1, closed

    def close(self) -> dict | None:
        if not self.vectors:
            return None
        x = np.array(self.vectors)
        at = self.projection.coordinates(unit(x.astype(np.float64)))
        name = fresh_name("piece", ".bin")
        with self.fs.open_output_stream(f"{self.path}/{name}") as out:
            out.write((np.arange(len(x)) + self.entry).astype("<i8").tobytes())
            out.write(np.array(self.weights, "<i8").tobytes())
            out.write(x.astype(self.kind).tobytes())
        piece = {"name": name, "first": self.entry, "dim": self.dim, "size": len(x),
                 "low": at.min(axis=0).tolist(), "high": at.max(axis=0).tolist()}
        self.entry += len(x)
        self.vectors, self.weights, self.last = [], [], None
        return piece


def _sequence(keyed: DataFrame, out_dir: str, projection: Projection, kind: str) -> DataFrame:
    """vec_id and entry of every row in grid order; a row with a piece describes one of the files."""
    def run(batches):
        w = _Writer(out_dir, TaskContext.get().partitionId(), projection, kind)
        schema = pa.schema([("vec_id", pa.int64()), ("entry", pa.int64()), ("piece", pa.struct([
            ("name", pa.string()), ("first", pa.int64()), ("dim", pa.int32()), ("size", pa.int32()),
            ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))]))])
        for b in batches:
            values, off, _ = _rows_of(b.column("vec"))
            ids, entries, pieces = [], [], []
            for i, (v, c, d) in enumerate(zip(b.column("vec_id").to_pylist(), b.column("cells").to_pylist(),
                                              b.column("digest").to_pylist())):
                entry, closed = (None, None) if c is None else w.add(c, d, values[off[i]:off[i + 1]])
                if closed:
                    ids.append(None), entries.append(None), pieces.append(closed)
                ids.append(v), entries.append(entry), pieces.append(None)
            yield pa.RecordBatch.from_pydict({"vec_id": ids, "entry": entries, "piece": pieces}, schema)
        if (closed := w.close()) is not None:
            yield pa.RecordBatch.from_pydict({"vec_id": [None], "entry": [None], "piece": [closed]}, schema)

    order = keyed.orderBy("cells", "digest", "vec_id")
    return order.mapInArrow(run, f"vec_id long, entry long, piece {_PIECE}")


def _intervals(pieces: list) -> list[list[int]]:
    """Runs of pieces of one vector length with ``INTERVAL_ROWS`` entries at most (one piece at least)."""
    out: list[list[int]] = []
    size = 0
    for i, p in enumerate(pieces):
        if out and pieces[out[-1][0]]["dim"] == p["dim"] and size + p["size"] <= INTERVAL_ROWS:
            out[-1].append(i)
            size += p["size"]
        else:
            out.append([i])
            size = p["size"]
    return out


class _Interval:
    """The entries of an interval: ids, weights, unit vectors and boxes of its blocks."""

    def __init__(self, out_dir: str, pieces: list[dict], projection: Projection, kind: str):
        ids, weights, vectors = [], [], []
        size = np.dtype(kind).itemsize
        for p in pieces:
            with mapped(out_dir, p["name"]) as f:
                raw = f.read_buffer(p["size"] * (16 + size * p["dim"]))
            n = p["size"]
            ids.append(np.frombuffer(raw, "<i8", n))
            weights.append(np.frombuffer(raw, "<i8", n, 8 * n))
            vectors.append(np.frombuffer(raw, kind, n * p["dim"], 16 * n).reshape(n, -1))
        self.ids, self.weights = np.concatenate(ids), np.concatenate(weights)
        self.exact = unit(np.concatenate(vectors).astype(np.float64))
        self.rough = self.exact.astype(np.float32)
        self.at = projection.coordinates(self.exact)
        self.boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        if (a, b) not in self.boxes:
            self.boxes[a, b] = self.at[a:b].min(axis=0), self.at[a:b].max(axis=0)
        return self.boxes[a, b]


def _apart(x: tuple, y: tuple, limit: float) -> bool:
    """Whether two boxes are provably farther apart than the limit (squared)."""
    gap = np.maximum(0, np.maximum(np.subtract(x[0], y[1]), np.subtract(y[0], x[1])))
    return float(gap @ gap) > limit


def _close_pairs(x: _Interval, y: _Interval, least: float, limit: float,
                 same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of linked entries, by recursive halving; within one interval each pair once."""
    margin = 1e-5 + 2e-7 * x.exact.shape[1]
    todo = [(0, len(x.ids), 0, len(y.ids))]
    while todo:
        a, b, c, d = todo.pop()
        if (same and d <= a) or _apart(x.box(a, b), y.box(c, d), limit):
            continue
        if b - a > LEAF_ROWS or d - c > LEAF_ROWS:
            if b - a >= d - c:
                m = (a + b) // 2
                todo += [(a, m, c, d), (m, b, c, d)]
            else:
                m = (c + d) // 2
                todo += [(a, b, c, m), (a, b, m, d)]
            continue
        s = x.rough[a:b] @ y.rough[c:d].T
        i, j = np.nonzero(s >= least - margin)
        if not len(i):
            continue
        border = np.flatnonzero(s[i, j] < least + margin)
        i, j = i + a, j + c
        keep = np.ones(len(i), bool)
        for k in range(0, len(border), 1 << 14):
            at = border[k:k + (1 << 14)]
            keep[at] = np.einsum("ij,ij->i", x.exact[i[at]], y.exact[j[at]]) >= least
        if same:
            keep &= i < j
        if keep.any():
            yield i[keep], j[keep]


def _spanning(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels after joining the nodes of every pair: the smallest node of each class."""
    while True:
        a, b = label[u], label[v]
        low = np.minimum(a, b)
        moved = a != b
        if not moved.any():
            return label
        u, v, a, b, low = u[moved], v[moved], a[moved], b[moved], low[moved]
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _found(out_dir: str, pieces: list[dict], intervals: list[list[int]], projection: Projection, kind: str,
           least: float, limit: float, i: int, run: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(u, v, n): links of a spanning forest (n null, here -1) and link counts (v equal u) of one task."""
    count = len(intervals)
    half = count // 2

    def described(k: int) -> tuple:
        own = [pieces[p] for p in intervals[k]]
        return np.min([p["low"] for p in own], axis=0), np.max([p["high"] for p in own], axis=0)

    x = None
    # every pair of intervals belongs to one of its two, by the shorter way around
    for step in range(run * RUN_INTERVALS, min((run + 1) * RUN_INTERVALS, half + 1)):
        if step and 2 * step == count and i >= half:
            continue
        j = (i + step) % count
        if pieces[intervals[i][0]]["dim"] != pieces[intervals[j][0]]["dim"] or _apart(described(i), described(j), limit):
            continue
        x = x or _Interval(out_dir, [pieces[p] for p in intervals[i]], projection, kind)
        y = x if step == 0 else _Interval(out_dir, [pieces[p] for p in intervals[j]], projection, kind)
        nx, shift = len(x.ids), 0 if step == 0 else len(x.ids)
        ids = x.ids if step == 0 else np.concatenate([x.ids, y.ids])
        weights = x.weights if step == 0 else np.concatenate([x.weights, y.weights])
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        label, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        for a, b in _close_pairs(x, y, least, limit, step == 0):
            b = b + shift
            links += np.bincount(a, weights[b], len(ids)).astype(np.int64) + np.bincount(b, weights[a], len(ids)).astype(np.int64)
            label = _spanning(label, place[a], place[b])
        hit = np.flatnonzero(links)
        moved = np.flatnonzero(label != np.arange(len(ids)))
        ordered = ids[order]
        yield (np.concatenate([ordered[label[moved]], ids[hit]]), np.concatenate([ordered[moved], ids[hit]]),
               np.concatenate([np.full(len(moved), -1), links[hit]]))


def near_vectors(vectors: DataFrame, least: float = 0.9, vec_id: str = "vec_id",
                 embedding: str = "embedding") -> DataFrame:
    """Per row: vec_id, n_links, component_id (the smallest vec_id reachable by links) and kept."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    single = isinstance(vectors.schema[embedding].dataType, ArrayType) and isinstance(
        vectors.schema[embedding].dataType.elementType, FloatType)
    kind = "<f4" if single else "<f8"
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("vec"))
    total = rows.count()
    every = max(1, -(-total // SAMPLE_ROWS))
    picked = rows.where(F.pmod(F.xxhash64("vec_id", "vec"), F.lit(every)) == 0).select("vec").limit(2 * SAMPLE_ROWS)
    epsilon = float(np.sqrt(max(0.0, 2 - 2 * least) + _SLACK))
    projection = Projection(*directions([r[0] for r in picked.collect()], AXES), epsilon)
    limit = epsilon * epsilon + _SLACK

    out_dir = scratch_path(spark, "grid-order")
    stored = written(_sequence(_keyed(rows, projection), out_dir, projection, kind), "grid-rows")
    # one row per file, in sequence order
    pieces = sorted((r["piece"].asDict() for r in stored.where("piece is not null").select("piece").collect()),
                    key=lambda p: p["first"])
    members = stored.where("piece is null").select("vec_id", "entry")

    intervals = _intervals(pieces)
    runs = -(-(len(intervals) // 2 + 1) // RUN_INTERVALS)
    shared = spark.sparkContext.broadcast((pieces, intervals))

    def link(batches):
        own_pieces, own_intervals = shared.value
        for b in batches:
            for task in b.column("id").to_pylist():
                for u, v, n in _found(out_dir, own_pieces, own_intervals, projection, kind, least, limit,
                                      task // runs, task % runs):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(n)], ["u", "v", "n"])

    tasks = len(intervals) * runs
    found = written(spark.range(0, tasks, 1, max(1, tasks)).mapInArrow(link, "u long, v long, n long"), "grid-links")
    counts = found.where("n >= 0").groupBy(F.col("u").alias("entry")).agg(F.sum("n").alias("others"))
    roots = connected_components(found.where("n < 0").select("u", "v"))
    sizes = members.where("entry is not null").groupBy("entry").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("low"))
    classed = written(sizes.join(counts, "entry", "left")
                      .join(roots, sizes.entry == roots.node, "left")
                      .select("entry", "low", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
                              F.coalesce("root", "entry").alias("root")), "grid-classes")
    ids = classed.groupBy("root").agg(F.min("low").alias("component_id"))
    named = classed.join(ids, "root").select("entry", "n_links", "component_id")
    out = members.join(named, "entry", "left")
    component = F.when(F.col("entry").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
