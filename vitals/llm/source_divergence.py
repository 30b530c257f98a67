"""Which sources of a language differ from one another, and by which terms.

For every (lang, source) group the chi-squared like value
``floor((p - q)^2 / q)`` compares its smoothed term shares p (per 10^9) with those q of each other
source of the language (summed over all kept terms, part ``pair``), and with those of
the whole language (per term, the ``TOP`` largest, part ``term``). All numbers are
whole and exact.

1. One pass over the texts counts terms per (lang, source) in bounded
   dictionaries of the task, so what is shuffled is counts, not words. One row
   per kept (lang, term) then holds the term's count in each source.
2. ``pair``: tasks add the values of all pairs of sources over the terms they
   hold, as matrices of a bounded block of terms, and return the sums alone.
   Terms that neither source has are part of the matrices.
3. ``term``: within a group the value rises with the group's count and falls with
   the language's, and ties go to the earlier term in UTF-8. So a term that ``TOP``
   others dominate in all three cannot be ranked: every partition keeps the
   skyband of terms with fewer dominators, the skybands of a group are merged in
   rounds of partitions, and the terms left are ranked exactly.

Null text, lang and source are empty ones. Groups without terms are compared too; a
language without kept terms has values of 0 and no ``term`` rows. Repeated
rows and doc_ids count as documents of their own. Without rows the result is empty.
One row per group reaches the driver (the result has the square of them).
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitals.llm.blocks import bounded_batches, text_blocks, utf8_list, written

TOP = 200
MIN_DOCS = 3
SCALE = 1_000_000_000

TASK_ENTRIES = 300_000
TERM_BLOCK = 256
SUM_CELLS = 1 << 22

#: Letters of A-Z in lower case, a-z and every byte of a non-ASCII letter stay; the rest parts terms.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The lower-cased terms of a UTF-8 text, in order."""
    return text.translate(_TERM_BYTES).split()


def _counted(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """Partial (lang, source, term, n, docs) of each task; the empty term marks that the group occurs."""
    src = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"),
                      F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text).alias("text"))
    names = ["lang", "source", "term", "n", "docs"]

    def rows(groups: dict):
        for (lg, so), (n, docs_with) in groups.items():
            n[b""] = docs_with[b""] = 0
            words = list(n)
            for a in range(0, len(words), 50_000):
                part = words[a:a + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lg] * len(part)), pa.array([so] * len(part)), pa.array(part, pa.binary()).cast(pa.string()),
                     pa.array([n[w] for w in part], pa.int64()), pa.array([docs_with[w] for w in part], pa.int64())], names)

    def run(batches):
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for b in text_blocks(batches, "text"):
            keys = zip(b.column("lang").to_pylist(), b.column("source").to_pylist())
            for key, t in zip(keys, utf8_list(b.column("text"))):
                own = groups.get(key) or groups.setdefault(key, (Counter(), Counter()))
                found = terms(t)
                own[0].update(found)
                own[1].update(set(found))
            if sum(len(n) for n, _ in groups.values()) >= TASK_ENTRIES:
                yield from rows(groups)
                groups.clear()
        yield from rows(groups)

    bounded_batches(docs.sparkSession)
    return src.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
                min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per kept (lang, term): total, and (source, n) of the sources that have it.

    The empty term lists the groups of the language, with n = 0.
    """
    parts = _counted(docs, text, lang, source).repartition("lang", "term")
    by_source = parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return (by_source.groupBy("lang", "term").agg(
        F.sum("n").alias("total"), F.sum("docs").alias("docs"),
        F.collect_list(F.struct("source", "n")).alias("by_source"))
        .where((F.col("term") == "") | (F.col("docs") >= min_docs)).drop("docs"))


def share(n: np.ndarray, of: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * n / of) for n <= of, by long division in steps of 1000: no product leaves 64 bits."""
    out, rest = np.ones(np.broadcast(n, of).shape, np.int64), n
    for weight in (1_000_000, 1_000, 1):
        rest = rest * 1000
        out += weight * (rest // of)
        rest = rest % of
    return out


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


class Groups:
    """Per language: its sources, count plus terms of each and of the whole, and the number of kept terms."""

    def __init__(self, rows: list[tuple[str, str, int]], langs: dict[str, tuple[int, int]]):
        self.sources: dict[str, pa.Array] = {}
        self.of: dict[str, np.ndarray] = {}
        self.terms = {lg: v for lg, (v, _) in langs.items()}
        self.whole = {lg: n + v for lg, (v, n) in langs.items()}
        by_lang: dict[str, list[tuple[str, int]]] = {}
        for lg, so, n in sorted(rows):
            by_lang.setdefault(lg, []).append((so, n))
        for lg, own in by_lang.items():
            self.sources[lg] = pa.array([so for so, _ in own], pa.string())
            self.of[lg] = np.array([n for _, n in own], np.int64) + self.terms.get(lg, 0)

    def entries(self, batch: pa.RecordBatch):
        """Per language of a batch: (lang, row numbers, and of its entries: row, source number, count)."""
        lists = batch.column("by_source")
        lens = pc.list_value_length(lists).to_numpy()
        flat = lists.flatten()
        row = np.repeat(np.arange(len(lens)), lens)
        langs = batch.column("lang").dictionary_encode()
        codes = langs.indices.to_numpy()
        for code, lg in enumerate(langs.dictionary.to_pylist()):
            use = np.flatnonzero(codes[row] == code)
            own = flat.take(pa.array(use))
            at = pc.index_in(own.field("source"), self.sources[lg]).to_numpy()
            yield lg, np.flatnonzero(codes == code), row[use], at, own.field("n").to_numpy()


def _groups(counts: DataFrame) -> Groups:
    per = counts.select("lang", "term", F.explode("by_source").alias("s")).select("lang", "term", "s.*")
    rows = per.groupBy("lang", "source").agg(F.sum("n").alias("n")).collect()
    langs = counts.where("term <> ''").groupBy("lang").agg(F.count("*"), F.sum("total")).collect()
    return Groups([tuple(r) for r in rows], {r[0]: (r[1], r[2]) for r in langs})


def pair_sums(counts: DataFrame, groups: Groups) -> DataFrame:
    """(lang, source, item, value): sums over all kept terms, for every pair of sources of a language."""
    shared = counts.sparkSession.sparkContext.broadcast(groups)
    names = ["lang", "source", "item", "value"]

    def rows(sums: dict):
        for lg, total in sums.items():
            own = shared.value.sources[lg]
            for a in range(len(own)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lg] * len(own)), pa.array([own[a].as_py()] * len(own)), own, pa.array(total[a])], names)

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lg, at, row, source, n in shared.value.entries(b):
                of = shared.value.of[lg]
                total = sums.setdefault(lg, np.zeros((len(of), len(of)), np.int64))
                dense = np.zeros((len(at), len(of)), np.int64)
                dense[np.searchsorted(at, row), source] = n
                for k in range(0, len(at), TERM_BLOCK):
                    p = share(dense[k:k + TERM_BLOCK] + 1, of)
                    for a in range(len(of)):
                        total[a] += divergence(p[:, a:a + 1], p).sum(axis=0)
            if sum(t.size for t in sums.values()) > SUM_CELLS:
                yield from rows(sums)
                sums.clear()
        yield from rows(sums)

    done = counts.where("term <> ''").mapInArrow(run, "lang string, source string, item string, value long")
    return done.where("source <> item").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def skyband(n: np.ndarray, total: np.ndarray, term: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the terms that fewer than k others dominate: n not lower, total not higher, term earlier.

    Sorted by falling n, rising total and term, all dominators of a term come before it, and
    a term with k dominators has k of them in the skyband.
    """
    place = np.empty(len(term), np.int64)
    place[np.argsort(term, kind="stable")] = np.arange(len(term))
    order = np.lexsort((place, total, -n))
    kept = np.empty(0, np.int64)
    for a in range(0, len(order), 512):
        own = order[a:a + 512]
        by = np.concatenate([kept, own])
        dominated = (total[by] <= total[own][:, None]) & (place[by] < place[own][:, None])
        dominated[:, len(kept):] &= np.tri(len(own), k=-1, dtype=bool)
        kept = np.concatenate([kept, own[dominated.sum(axis=1) < k]])
    return kept


class _Band:
    """The skyband of one group over the rows seen so far."""

    def __init__(self, k: int):
        self.k, self.columns, self.more = k, [], []
        self.waiting = 0

    def add(self, *columns: np.ndarray) -> None:
        self.more.append(columns)
        self.waiting += len(columns[0])
        if self.waiting > 8192:
            self.reduce()

    def reduce(self) -> list[np.ndarray]:
        if self.more:
            self.columns = [np.concatenate(x) for x in zip(*([self.columns] if self.columns else []), *self.more)]
            keep = skyband(*self.columns[:3], self.k)
            self.columns, self.more, self.waiting = [x[keep] for x in self.columns], [], 0
        return self.columns


_BAND = "lang string, source string, item string, n long, total long, value long"


def _bands(bands: dict):
    for (lg, so), band in bands.items():
        n, total, term, value = band.reduce()
        yield pa.RecordBatch.from_arrays(
            [pa.array([lg] * len(n)), pa.array([so] * len(n)), pa.array(term.tolist(), pa.binary()).cast(pa.string()),
             pa.array(n), pa.array(total), pa.array(value)], ["lang", "source", "item", "n", "total", "value"])


def _objects(col: pa.Array) -> np.ndarray:
    out = np.empty(len(col), object)
    out[:] = col.cast(pa.binary()).to_pylist()
    return out


def term_bands(counts: DataFrame, groups: Groups, k: int) -> DataFrame:
    """Skybands per group of each partition's terms whose share is above the language's."""
    shared = counts.sparkSession.sparkContext.broadcast(groups)

    def run(batches):
        bands: dict[tuple[str, str], _Band] = {}
        for b in batches:
            term = _objects(b.column("term"))
            total = b.column("total").to_numpy()
            for lg, _, row, source, n in shared.value.entries(b):
                p = share(n + 1, shared.value.of[lg][source])
                q = share(total[row] + 1, np.int64(shared.value.whole[lg]))
                use = np.flatnonzero((p > q) & (n > 0))
                use = use[np.argsort(source[use], kind="stable")]
                value = divergence(p[use], q[use])
                cut = np.flatnonzero(np.diff(source[use])) + 1
                for part, v in zip(np.split(use, cut), np.split(value, cut)):
                    if len(part):
                        key = lg, shared.value.sources[lg][int(source[part[0]])].as_py()
                        bands.setdefault(key, _Band(k)).add(n[part], total[row[part]], term[row[part]], v)
        yield from _bands(bands)

    return counts.where("term <> ''").mapInArrow(run, _BAND)


def merged_bands(bands: DataFrame, k: int) -> DataFrame:
    """The skybands of whatever rows of a group share a partition."""
    def run(batches):
        held: dict[tuple[str, str], _Band] = {}
        for b in batches:
            lang, source = b.column("lang").to_pylist(), b.column("source").to_pylist()
            columns = (b.column("n").to_numpy(), b.column("total").to_numpy(), _objects(b.column("item")), b.column("value").to_numpy())
            of: dict[tuple[str, str], list[int]] = {}
            for i, key in enumerate(zip(lang, source)):
                of.setdefault(key, []).append(i)
            for key, at in of.items():
                held.setdefault(key, _Band(k)).add(*(x[at] for x in columns))
        yield from _bands(held)

    return bands.mapInArrow(run, _BAND)


def _ranked(df: DataFrame, part: str, top: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = df.select("lang", "source", F.lit(part).alias("part"), "item", "value",
                    F.row_number().over(order).cast("int").alias("rank"))
    return out if top is None else out.where(F.col("rank") <= top)


def audit(docs: DataFrame, top: int = TOP, min_docs: int = MIN_DOCS, text: str = "text",
          lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value and rank of both parts."""
    counts = written(term_counts(docs, text, lang, source, min_docs), "divergence-terms")
    groups = _groups(counts)
    own = counts.where("term = ''").select("lang", F.explode("by_source.source").alias("source"))
    pairs = own.join(own.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = pairs.join(pair_sums(counts, groups), ["lang", "source", "item"], "left").withColumn(
        "value", F.coalesce("value", F.lit(0)).cast("long"))
    bands = term_bands(counts, groups, top)
    merged = merged_bands(bands.repartition("lang", "source", F.pmod(F.xxhash64("item"), F.lit(8))), top)
    return _ranked(pairs, "pair").unionByName(_ranked(merged, "term", top))
