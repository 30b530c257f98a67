"""SimHash near-duplicates with a sharded vantage-point tree.

1. Every text becomes a 64-bit SimHash of its word shingles (XXH64, seed 42).
2. Equal fingerprints are folded to one row with their smallest document.
3. A vantage-point tree is fitted on a bounded hash sample of fingerprints
   (``1/SAMPLE_EVERY`` of them and ``MAX_SAMPLE`` at most) and broadcast: two
   numbers per inner node. It cuts the space into shards by Hamming distance.
4. Every fingerprint goes to its own shard and, where its distance to a vantage
   point is within the radius of the border, also to the shards beyond; the
   triangle inequality rules the other branches out. So of two linked
   fingerprints at least one reaches the other's shard.
5. Shards that hold more than ``SPLIT_OWN`` rows of their own, as the sample's tree cannot be
   finer than its sample, are split by further trees, each built on the executors from a sample of its shard's
   own rows, until none is left. So the comparisons per row do not grow with the rows.
6. Each shard compares its own rows with its visitors exactly. Shards with many
   rows are cut into cells (own rows x visitors), so no task grows with a hot
   shard, and each cell returns a spanning forest of its links, not the pairs.
7. Components of the forest edges give each document its class.

Without rows the result is empty. Null or blank texts have fingerprint zero and are linked like any other. Rows
without doc_id get a class but never name one; repeated rows each get a row.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitals.llm.blocks import bounded_batches, text_blocks, utf8_list, written
from vitals.llm.components import connected_components

SAMPLE_EVERY = 16
MAX_SAMPLE = 1 << 16
LEAF_ROWS = 512
SPLIT_OWN = 1024
SPLIT_SAMPLE = 2048
SPLIT_ROWS = 100_000
CELL_OWN = 4096
CELL_VISITORS = 1 << 17

_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)


def simhash(text: bytes, words: int = 3) -> int:
    """Unsigned SimHash of the whole UTF-8 text; zero for a text without words."""
    tokens = text.lower().split()  # bytes: A-Z and the six ASCII white-space characters only
    if not tokens:
        return 0
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), 42)
    joined = b" ".join(tokens)
    ends = list(accumulate(len(t) + 1 for t in tokens))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b - 1], 42) for a, b in zip(starts, ends[words - 1:])], np.uint64)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 15):
        bits = np.unpackbits(h[a:a + (1 << 15)].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(_BIT[ones * 2 > len(h)].sum(dtype=np.uint64))


def with_simhash(docs: DataFrame, words: int = 3, keep: tuple[str, ...] = ("doc_id",),
                 text: str = "text", out: str = "fp") -> DataFrame:
    """The ``keep`` columns of every row and the SimHash of its text as a signed long."""
    src = docs.select(*keep, F.col(text).alias("__text"))
    schema = src.drop("__text").schema.add(out, "long")
    names = [*keep]

    def run(batches):
        for b in text_blocks(batches, "__text"):
            h = np.array([simhash(t, words) for t in utf8_list(b.column("__text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(h.view(np.int64))],
                                             [*names, out])
    bounded_batches(docs.sparkSession)
    return src.mapInArrow(run, schema)


class VPTree:
    """Vantage-point tree over 64-bit codes whose leaves are shards."""

    def __init__(self, sample: np.ndarray, leaf: int, radius: int, seed: int = 7):
        self.radius = radius
        self.vantage: list[int] = []
        self.border: list[int] = []
        self.child: list[list[int]] = []  # >= 0: inner node, < 0: shard -n
        self.shards = 0
        rng = np.random.default_rng(seed)
        sample = np.unique(sample)
        self.root = self._new_leaf() if len(sample) <= leaf else None
        todo = [] if self.root is not None else [(sample, None, 0)]
        while todo:
            points, parent, side = todo.pop()
            split = self._split(points, rng) if len(points) > leaf else None
            if split is None:
                ref = self._new_leaf()
            else:
                vp, mu = split
                ref = len(self.vantage)
                self.vantage.append(int(vp))
                self.border.append(int(mu))
                self.child.append([0, 0])
                near = np.bitwise_count(points ^ vp) <= mu
                todo += [(points[near], ref, 0), (points[~near], ref, 1)]
            if parent is None:
                self.root = ref
            else:
                self.child[parent][side] = ref

    def _new_leaf(self) -> int:
        self.shards += 1
        return -self.shards

    def _split(self, points: np.ndarray, rng: np.random.Generator):
        """The (vantage point, border) with the least overlap per bit of information."""
        best = None
        for vp in rng.choice(points, min(8, len(points)), replace=False):
            share = np.cumsum(np.bincount(np.bitwise_count(points ^ vp), minlength=65)) / len(points)
            mu = np.arange(64)
            p = share[:64]
            both = share[np.minimum(mu + self.radius, 64)] - np.where(
                mu - self.radius >= 0, share[np.maximum(mu - self.radius, 0)], 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                info = -(p * np.log2(p) + (1 - p) * np.log2(1 - p))
                cost = np.where((p > 0.05) & (p < 0.95), np.log2(1 + both) / info, np.inf)
            k = int(np.argmin(cost))
            if np.isfinite(cost[k]) and (best is None or cost[k] < best[0]):
                best = (cost[k], vp, k)
        return None if best is None else best[1:]

    def place(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, shard, own) for every visit of the points within the radius."""
        idx = np.arange(len(points))
        todo = [(self.root, idx, np.ones(len(points), bool))]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while todo:
            ref, i, own = todo.pop()
            if not len(i):
                continue
            if ref < 0:
                found.append((i, np.full(len(i), -ref, np.int32), own))
                continue
            d = np.bitwise_count(points[i] ^ np.uint64(self.vantage[ref])).astype(np.int64)
            mu, r = self.border[ref], self.radius
            near, far = d <= mu + r, d > mu - r
            todo.append((self.child[ref][0], i[near], own[near] & (d[near] <= mu)))
            todo.append((self.child[ref][1], i[far], own[far] & (d[far] > mu)))
        if not found:
            return idx, idx.astype(np.int32), np.ones(0, bool)
        return tuple(np.concatenate(x) for x in zip(*found))


def _forest(own: np.ndarray, visitors: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (root, node) that join whatever is within the radius in one cell."""
    nodes = np.unique(np.concatenate([own, visitors]))
    oi, vi = np.searchsorted(nodes, own), np.searchsorted(nodes, visitors)
    label = np.arange(len(nodes))
    for i, x in zip(oi, own):
        hit = vi[np.bitwise_count(visitors ^ x) <= radius]
        if not len(hit) or (len(hit) == 1 and hit[0] == i):
            continue
        seen = label[hit]
        low = min(int(seen.min()), int(label[i]))
        if low == label[i] and (seen == low).all():
            continue
        label[np.isin(label, np.append(seen, label[i]))] = low
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[moved]], nodes[moved]


def _split(placed: DataFrame, large: DataFrame, radius: int) -> DataFrame:
    """The rows of ``large`` shards (shard, n_own, n_rows) placed in finer ones (shard is the path of numbers).

    Every part of a shard's rows builds the shard's tree again from the same sample, so
    neither rows nor trees of a shard meet in one place.
    """
    every = F.greatest(F.lit(1), F.ceil(F.col("n_own") / SPLIT_SAMPLE)).cast("int")
    parts = F.ceil(F.col("n_rows") / SPLIT_ROWS).cast("int")
    rows = placed.join(large, "shard").withColumn("every", every).withColumn(
        "part", F.pmod(F.xxhash64("fp", F.lit(12)), parts).cast("int"))
    sample = rows.where(F.col("own") & (F.pmod(F.xxhash64("fp", F.lit(11)), F.col("every")) == 0)).groupBy(
        "shard", "every", "n_rows").agg(F.collect_list("fp").alias("sample"))
    trees = written(sample.select("shard", "every", "sample", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")), "vp-trees")

    def place(own_rows: pd.DataFrame, tree_rows: pd.DataFrame) -> pd.DataFrame:
        if own_rows.empty:
            return pd.DataFrame({"shard": [], "fp": [], "own": []})
        points = own_rows["fp"].to_numpy().view(np.uint64)
        mine = own_rows["own"].to_numpy()
        tree = VPTree(np.array([], np.uint64), 1, radius) if tree_rows.empty else VPTree(
            np.asarray(tree_rows["sample"].iloc[0], np.int64).view(np.uint64), max(8, LEAF_ROWS // int(tree_rows["every"].iloc[0])), radius)
        i, sub, at_home = tree.place(points)
        home = np.zeros(len(points), np.int32)
        home[i[at_home]] = sub[at_home]
        # rows of the shard's own visit as in the first tree; visitors of the shard meet them wherever they may be
        use = ~mine[i] | (sub >= home[i])
        i, sub, at_home = i[use], sub[use], at_home[use]
        name = own_rows["shard"].iloc[0]
        return pd.DataFrame({"shard": [f"{name}.{x}" for x in sub.tolist()], "fp": own_rows["fp"].to_numpy()[i], "own": at_home & mine[i]})

    return rows.groupBy("shard", "part").cogroup(trees.groupBy("shard", "part")).applyInPandas(
        place, "shard string, fp long, own boolean")


def _sizes(placed: DataFrame) -> DataFrame:
    return placed.groupBy("shard").agg(F.count_if("own").alias("n_own"), F.count("*").alias("n_rows"))


def near_links(codes: DataFrame, radius: int = 2) -> DataFrame:
    """Forest links (u, v) of all distinct codes (column fp) within ``radius`` bits."""
    spark = codes.sparkSession
    n = codes.count()
    every = max(SAMPLE_EVERY, -(-n // MAX_SAMPLE))
    sample = codes.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).select("fp")
    pts = np.array(sorted(r[0] for r in sample.collect()), np.int64).view(np.uint64)
    tree = spark.sparkContext.broadcast(VPTree(pts, max(8, LEAF_ROWS // every), radius))

    def place(batches):
        for b in batches:
            fp = b.column("fp").to_numpy()
            i, shard, own = tree.value.place(fp.view(np.uint64))
            home = np.zeros(len(fp), np.int32)
            home[i[own]] = shard[own]
            use = shard >= home[i]  # one of two linked rows visits the other's shard
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard[use]).cast(pa.string()), pa.array(fp[i[use]]), pa.array(own[use])], ["shard", "fp", "own"])

    placed = written(codes.select("fp").mapInArrow(place, "shard string, fp long, own boolean"), "vp-placed")
    sizes = written(_sizes(placed), "vp-sizes")
    kept = []
    while not (large := sizes.where(F.col("n_own") > SPLIT_OWN)).isEmpty():
        finer = written(_split(placed, large, radius), "vp-placed")
        finer_sizes = written(_sizes(finer), "vp-sizes")
        if finer_sizes.agg(F.max("n_own")).first()[0] > 0.7 * large.agg(F.max("n_own")).first()[0]:
            break  # trees hardly part the largest shard: cells do
        kept.append((placed.join(large, "shard", "left_anti"), sizes.where(F.col("n_own") <= SPLIT_OWN)))
        placed, sizes = finer, finer_sizes
    for more, more_sizes in kept:
        placed, sizes = placed.unionByName(more), sizes.unionByName(more_sizes)
    cells = sizes.select("shard", F.ceil(F.col("n_own") / F.lit(CELL_OWN)).cast("int").alias("cut_own"),
                         F.ceil(F.col("n_rows") / F.lit(CELL_VISITORS)).cast("int").alias("cut_vis"))
    rows = placed.join(cells, "shard")
    own_cell = F.pmod(F.xxhash64("fp"), F.greatest(F.col("cut_own"), F.lit(1))).cast("int")
    vis_cell = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("cut_vis")).cast("int")
    zero = F.lit(0)
    owners = rows.where("own").select(
        "shard", own_cell.alias("a"), F.explode(F.sequence(zero, F.col("cut_vis") - 1)).alias("b"),
        "fp", F.lit(True).alias("own"))
    visitors = rows.where("cut_own > 0").select(
        "shard", F.explode(F.sequence(zero, F.col("cut_own") - 1)).alias("a"), vis_cell.alias("b"),
        "fp", F.lit(False).alias("own"))

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["own"].to_numpy()
        fp = pdf["fp"].to_numpy()
        u, v = _forest(fp[own].view(np.uint64), fp[~own].view(np.uint64), radius)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return owners.union(visitors).groupBy("shard", "a", "b").applyInPandas(link, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2,
                    keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every row's ``keep`` columns (doc_id among them), fp, component and component_id.

    ``fp`` is the SimHash as a signed long, ``component`` a code that names the
    class, ``component_id`` its smallest non-null doc_id: the smallest that is
    reachable over links of at most ``radius`` bits.
    """
    kept = [f"__keep{n}" for n in range(len(keep))]
    rows = written(with_simhash(docs.select(*[F.col(c).alias(n) for c, n in zip(keep, kept)], F.col("text").alias("text")),
                                words, tuple(kept)), "simhash")
    codes = written(rows.groupBy("fp").agg(F.min(kept[keep.index("doc_id")]).alias("low")), "simhash-codes")
    roots = connected_components(near_links(codes, radius))
    classes = written(codes.join(roots, codes.fp == roots.node, "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("component")), "simhash-classes")
    ids = classes.groupBy("component").agg(F.min("low").alias("component_id"))
    by_code = classes.select("fp", "component").join(ids, "component")
    return rows.join(by_code, "fp").select(*[F.col(n).alias(c) for c, n in zip(keep, kept)], "fp", "component", "component_id")


def fp_hex(fp: Column) -> Column:
    """The fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
