"""Benchmark decontamination by winnowing.

Words of both sides are hashed to k-gram hashes; of every ``window - k + 1``
consecutive k-grams the smallest hash (the rightmost of equals) is kept. Any
span of ``window`` words that occurs on both sides therefore keeps the same
k-gram on both sides, so the join on kept k-grams misses no such span.

* A fixed-size bit map of the benchmark's kept hashes travels to the document
  scan, so only k-grams that may match leave it (a false bit costs a row, no
  more); the map's size does not depend on either side.
* Each kept k-gram carries the few words around it (as 64-bit hashes) that decide
  whether it lies in a shared window. After the equi-join, the hit is extended over equal words
  to both sides and kept if it reaches ``window`` words.
* Equal seeds (k-gram and words around it) form a class, on both sides: the join is between
  distinct seeds, and its result is expanded to the documents' places and the classes' items, so
  a phrase that repeats in an item, or in many items and documents, joins once.
* An item shorter than ``window`` words is one window: for every such length in
  the benchmark (``window - 1`` values at most) all document n-grams of that
  length are matched.

Without documents the result is empty, without items nothing is hit. Null or word-free texts have no words and no hits. Benchmark rows without
item_id or words are ignored; items with equal ids count once. Each document
row is handled alone, also rows that repeat a doc_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from vitals.llm.blocks import Words, lower_ascii, map_blocks, mix64, utf8_buffer, written

WINDOW = 10
KGRAM = 6
MAP_BITS = 23  # one MiB

IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True

_SEED = "array<struct<pos:int,size:int,hash:long,left:array<long>,right:array<long>>>"
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes (also over row borders; see callers)."""
    n = len(h) - k + 1
    g = np.zeros(max(n, 0), np.uint64)
    for j in range(k):
        g = g * _STEP + h[j:j + max(n, 0)]
    return mix64(g + np.uint64(k))


def winnow(h: np.ndarray, doc: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the k-grams kept from windows that lie within one row."""
    n = len(h) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    g = _grams(h, k)
    best, at = g[:n].copy(), np.zeros(n, np.int8)
    for j in range(1, window - k + 1):
        cur = g[j:j + n]
        less = cur <= best
        np.copyto(best, cur, where=less)
        at[less] = j
    whole = doc[:n] == doc[window - 1:window - 1 + n]
    kept = np.zeros(len(g), bool)
    kept[(np.arange(n) + at)[whole]] = True
    pos = np.flatnonzero(kept)
    return pos, g[pos]


def _every_gram(h: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    g = _grams(h, size)
    pos = np.flatnonzero(doc[:len(g)] == doc[size - 1:size - 1 + len(g)])
    return pos, g[pos]


def _around(h: np.ndarray, start: np.ndarray, count: np.ndarray, step: int) -> pa.Array:
    """Lists of ``count`` word hashes from ``start`` on, forwards or backwards."""
    ends = np.cumsum(count)
    at = np.repeat(start, count) + step * (np.arange(int(count.sum())) - np.repeat(ends - count, count))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(h[at].view(np.int64)))


def _seeds(w: Words, h: np.ndarray, found: list[tuple[int, np.ndarray, np.ndarray]], window: int) -> pa.Array:
    """The seeds of each row, given (size, positions, hashes).

    A k-gram carries the hashes of the words around it, nearest first. A whole
    short item has a negative size and needs none.
    """
    size = np.concatenate([np.full(len(p), s, np.int32) for s, p, _ in found])
    pos = np.concatenate([p for _, p, _ in found]).astype(np.int64)
    hashes = np.concatenate([x for *_, x in found]).view(np.int64)
    order = np.argsort(w.doc[pos], kind="stable")
    size, pos, hashes = size[order], pos[order], hashes[order]
    doc = w.doc[pos]
    first = (np.cumsum(w.counts) - w.counts)[doc]
    last = first + w.counts[doc]
    after = pos + np.abs(size)
    reach = np.where(size > 0, window - size, 0)
    seeds = pa.StructArray.from_arrays(
        [pa.array((pos - first).astype(np.int32)), pa.array(size), pa.array(hashes),
         _around(h, pos - 1, np.minimum(reach, pos - first), -1),
         _around(h, after, np.minimum(reach, last - after), 1)], ["pos", "size", "hash", "left", "right"])
    per_doc = np.bincount(doc, minlength=len(w.counts))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_doc)]), pa.int32()), seeds)


def item_seeds(items: DataFrame, item_id: str = "item_id", text: str = "text",
               window: int = WINDOW, k: int = KGRAM) -> DataFrame:
    """(item, size, hash, left, right): the distinct seeds of each item: kept k-grams, or a whole short item."""
    src = items.where(F.col(item_id).isNotNull()).select(
        F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))

    def fn(block):
        data, off = utf8_buffer(block.column("text"))
        w = Words(lower_ascii(data), off, IS_WORD)
        h = w.hashes()
        found = [(k, *winnow(h, w.doc, k, window))]
        for size in range(1, window):
            pos = np.searchsorted(w.doc, np.flatnonzero(w.counts == size))
            if len(pos):
                found.append((-size, pos, _grams(h, size)[pos]))
        return pa.RecordBatch.from_arrays([block.column("item"), _seeds(w, h, found, window)], ["item", "seeds"])

    return (map_blocks(src, "text", fn, f"item string, seeds {_SEED}")
            .select("item", F.explode("seeds").alias("s")).select("item", "s.*").drop("pos").distinct())


def hash_map(seeds: DataFrame, bits: int = MAP_BITS) -> np.ndarray:
    """Bit map of the seeds' hashes; its 64-bit words are folded by Spark first."""
    at = F.col("hash").bitwiseAND(F.lit((1 << bits) - 1))
    words = (seeds.select(F.shiftright(at, 6).alias("w"),
                          F.expr("shiftleft(1L, cast(hash & 63 as int))").alias("b"))
             .groupBy("w").agg(F.bit_or("b").alias("b")))
    out = np.zeros(1 << (bits - 6), np.int64)
    for w, b in words.collect():  # 2^(bits-6) rows at most
        out[w] = b
    return out.view(np.uint64)


def _in_map(m: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(len(m) * 64 - 1)
    return (m[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def document_seeds(docs: DataFrame, bitmap: np.ndarray, short: list[int], text: str = "text",
                   window: int = WINDOW, k: int = KGRAM) -> DataFrame:
    """The other columns of ``docs``, n_words, and the seeds that may match."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bitmap)
    names = [c for c in docs.columns if c != text]
    schema = docs.select(*names).schema.add("n_words", "long").add("seeds", DataType.fromDDL(_SEED))

    def fn(block):
        data, off = utf8_buffer(block.column(text))
        w = Words(lower_ascii(data), off, IS_WORD)
        h = w.hashes()
        found = []
        for size, (pos, g) in [(k, winnow(h, w.doc, k, window)), *((-n, _every_gram(h, w.doc, n)) for n in short)]:
            use = _in_map(shared.value, g)
            found.append((size, pos[use], g[use]))
        seeds = _seeds(w, h, found, window)
        return pa.RecordBatch.from_arrays(
            [*(block.column(n) for n in names), pa.array(w.counts.astype(np.int64)), seeds],
            [*names, "n_words", "seeds"])

    return map_blocks(docs, text, fn, schema)


def _common(a: str, b: str) -> Column:
    """Number of leading elements that two arrays share."""
    eq = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(eq, False)
    return F.when(at == 0, F.size(eq)).otherwise(at - 1).cast("int")


_CLASS = ["size", "hash", "left", "right"]


def hits(doc_seeds: DataFrame, seeds: DataFrame, key: str, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(key, lo, hi): word ranges of documents that occur in an item, extended; and (key, item)."""
    classes = written(seeds.select(*_CLASS).distinct().withColumn("seed", F.monotonically_increasing_id()), "bench-classes")
    members = seeds.join(classes, _CLASS).select("seed", "item")
    d = doc_seeds.select(key, F.explode("seeds").alias("s")).select(key, "s.*")
    i = classes.select("seed", "size", "hash", F.col("left").alias("i_left"), F.col("right").alias("i_right"))
    met = (d.select(*_CLASS).distinct().join(i, ["size", "hash"])
           .withColumn("l", _common("left", "i_left")).withColumn("r", _common("right", "i_right"))
           .where((F.col("size") < 0) | (F.col("l") + F.col("size") + F.col("r") >= window)))
    met = written(met.select(*_CLASS, "l", "r", "seed"), "bench-met")
    found = written(d.join(met, _CLASS).select(
        key, (F.col("pos") - F.col("l")).alias("lo"), (F.col("pos") + F.abs("size") + F.col("r")).alias("hi"), "seed"), "bench-hits")
    return (found.select(key, "lo", "hi").distinct(),
            found.select(key, "seed").distinct().join(members, "seed").select(key, "item").distinct())


def contamination(docs: DataFrame, items: DataFrame, keep: tuple[str, ...] = ("doc_id",),
                  text: str = "text", window: int = WINDOW, k: int = KGRAM) -> DataFrame:
    """Per row: the ``keep`` columns, n_words, n_hit, n_items and the sorted item ids."""
    kept = [f"__keep{n}" for n in range(len(keep))]
    docs = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, kept)], F.col(text).alias("__text"))
    i_seeds = written(item_seeds(items, window=window, k=k), "bench-seeds")
    short = sorted(-r[0] for r in i_seeds.where("size < 0").select("size").distinct().collect())
    marked = document_seeds(docs, hash_map(i_seeds), short, "__text", window, k)
    table = written(marked.withColumn("__row", F.monotonically_increasing_id()), "doc-seeds")
    spans, found = hits(table, i_seeds, "__row", window)
    before = Window.partitionBy("__row").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.greatest("lo", F.coalesce(F.max("hi").over(before), F.lit(0)))
    covered = (spans.select("__row", F.greatest(F.col("hi") - reach, F.lit(0)).alias("new"))
               .groupBy("__row").agg(F.sum("new").alias("n_hit")))
    ids = (found.groupBy("__row")
           .agg(F.array_sort(F.collect_list("item")).alias("items")))
    out = (table.drop("seeds").join(covered.join(ids, "__row"), "__row", "left"))
    none = F.array().cast("array<string>")
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, kept)], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.coalesce("items", none).alias("items"))
