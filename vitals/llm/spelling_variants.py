"""Words of a corpus grouped by spelling, with an index of variable-length grams.

Words are near if one inserted, deleted or replaced code point turns one into the other.

1. Tasks count the runs of letters in bounded dictionaries, so what is shuffled is
   counts. A fixed share of the (document, run) pairs loses one letter by rule.
2. The gram dictionary holds all grams of ``QMIN`` letters and, up to ``QMAX``, every
   gram whose beginning (all but its last letter) is frequent: more than one in
   ``FREQUENT`` of all grams of that length. A branch below a rarer gram is pruned, as that
   gram selects well enough. So there are at most ``FREQUENT`` branches a length,
   each with one gram per letter of the alphabet, however many words there are.
3. A word's grams are the longest dictionary gram at each place, without those
   inside an earlier one. Which of them an edit can change is known from the
   dictionary: those over the edited place, those left of it that a longer gram over the
   place could replace, and those right of it that a gram over the place could cover. The
   largest such number over all edits bounds how many grams of a word may be
   lost, so near words share at least (grams - bound) of them, at places that
   differ by the edit alone.
4. Lists of the index are kept per gram, place and word length. Of a word that must
   share T grams, the T - 1 with the longest lists are left out; the other lists are merged.
   Words with T < 1 that could only meet each other have plain ``QMIN``-grams in lists of their own,
   of which an edit changes ``QMIN`` at most.
5. Candidates are verified by edit distance.

A word's form is its near word with the largest count, if that is at least ``RATIO`` times
its own; roots follow forms by pointer doubling, as counts grow at every step.

Null texts have no words; the empty text stands for a null doc_id in the rule's key. Equal rows
count each. Without words the result is empty.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitals.llm.blocks import bounded_batches, text_blocks, written

MIN_LETTERS = 6
MIN_COUNT = 5
DROP_EVERY = 199
RATIO = 5

QMIN = 2
QMAX = 4
FREQUENT = 4096

TASK_WORDS = 500_000

#: In Latin-1: A-Z in lower case, a-z and U+00C0 to U+00FF stay; the rest parts runs.
_RUN_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 192 else 32 for b in range(256))


def corrupted(run: bytes, key: int, every: int = DROP_EVERY) -> bytes:
    """The Latin-1 run, without the letter that its checksum names where ``every`` divides that."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), key)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_COUNT,
                letters: int = MIN_LETTERS, every: int = DROP_EVERY) -> DataFrame:
    """(word, n) of the words with at least ``letters`` letters and ``least`` occurrences."""
    src = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc_id"),
                      F.coalesce(F.col(text), F.lit("")).alias("text"))

    def rows(found: Counter):
        words = list(found)
        for a in range(0, len(words), 50_000):
            part = words[a:a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in part], pa.string()),
                                              pa.array([found[w] for w in part], pa.int64())], ["word", "n"])

    def run(batches):
        found: Counter = Counter()
        for b in text_blocks(batches, "text"):
            for own, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                runs = t.encode("latin-1", "replace").translate(_RUN_BYTES).split()
                key = zlib.crc32(f"{own}:".encode())
                for r, n in Counter([r for r in runs if len(r) >= letters]).items():
                    found[corrupted(r, key, every)] += n
            if len(found) >= TASK_WORDS:
                yield from rows(found)
                found.clear()
        yield from rows(found)

    bounded_batches(docs.sparkSession)
    counts = src.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where((F.col("n") >= least) & (F.length("word") >= letters))


class GramDictionary:
    """All grams of ``qmin`` letters and the longer ones whose beginnings are in ``frequent``."""

    def __init__(self, grams: list[str], qmin: int, qmax: int):
        self.qmin, self.qmax = qmin, qmax
        self.grams = frozenset(grams)
        # beginnings and ends of longer grams: what an edited letter could complete
        self.begins = frozenset(g[:k] for g in grams for k in range(1, len(g)))
        self.ends = frozenset(g[-k:] for g in grams for k in range(1, len(g)))

    def decompose(self, word: str) -> list[tuple[int, int]]:
        """(start, end) of the word's grams: the longest at each place, none inside an earlier one."""
        out, reach = [], 0
        for a in range(len(word) - self.qmin + 1):
            b = next((a + q for q in range(min(self.qmax, len(word) - a), self.qmin, -1) if word[a:a + q] in self.grams),
                     a + self.qmin)
            if b > reach:
                out.append((a, b))
                reach = b
        return out

    def affected(self, word: str, grams: list[tuple[int, int]]) -> int:
        """The largest number of the grams that one edit can change; near an edit lie 4 * qmax grams at most."""
        q, size = self.qmax, len(word)
        # the first place from which a longer gram may reach over an edit at i, and the last that one may cover
        first = [next((a for a in range(max(0, i - q + 1), i) if word[a:i] in self.begins), i) for i in range(size + 1)]
        last = [next((b for b in range(min(size, i + q - 1), i, -1) if word[i:b] in self.ends), i) for i in range(size + 1)]
        starts = [a for a, _ in grams]
        most = 0
        for i in range(size + 1):
            near = grams[bisect_left(starts, i - q):bisect_left(starts, i + q + 1)]
            left = sum(b <= i and a >= first[i] for a, b in near)
            most = max(most, left + sum(a < i < b or (a >= i and b <= last[i]) for a, b in near))
            if i < size:
                most = max(most, left + sum(a <= i < b or (a > i and b <= last[i + 1]) for a, b in near))
        return most


def gram_dictionary(words: DataFrame, qmin: int = QMIN, qmax: int = QMAX, frequent: int = FREQUENT) -> list[str]:
    """The grams beyond ``qmin`` letters; each level looks below the frequent grams of the one before only.

    A level has at most ``frequent`` of those, so what is collected is bounded by
    that times the letters of the alphabet.
    """
    out: list[str] = []
    heads: list[str] | None = None
    for q in range(qmin, qmax):
        spots = words.select("word", F.explode(F.sequence(F.lit(1), F.length("word") - q)).alias("at")).select(
            F.substring("word", F.col("at"), F.lit(q)).alias("head"),
            F.substring("word", F.col("at"), F.lit(q + 1)).alias("gram"))
        counts = written(spots.groupBy("head", "gram").agg(F.count("*").alias("n")), "gram-counts")
        total = counts.agg(F.sum("n")).first()[0] or 0
        if heads is not None:
            counts = counts.where(F.substring("head", 1, q - 1).isin(heads))
        common = counts.groupBy("head").agg(F.sum("n").alias("n")).where(F.col("n") * frequent > total)
        heads = [r[0] for r in common.select("head").collect()]
        if not heads:
            break
        out += [r[0] for r in counts.where(F.col("head").isin(heads)).select("gram").collect()]
    return out


def _decomposed(words: DataFrame, grams: list[str], qmin: int, qmax: int) -> DataFrame:
    """word, n, need (how many grams a near word shares at least) and the ends of the grams at their starts."""
    shared = words.sparkSession.sparkContext.broadcast(GramDictionary(grams, qmin, qmax))

    def run(batches):
        for b in batches:
            need, starts, ends = [], [], []
            for w in b.column("word").to_pylist():
                found = shared.value.decompose(w)
                least = len(found) - shared.value.affected(w, found)
                need.append(least)
                starts.append([a for a, _ in found])
                ends.append([e for _, e in found])
            yield pa.RecordBatch.from_arrays(
                [b.column("word"), b.column("n"), pa.array(need, pa.int32()), pa.array(starts, pa.list_(pa.int32())),
                 pa.array(ends, pa.list_(pa.int32()))], ["word", "n", "need", "starts", "ends"])

    return words.mapInArrow(run, "word string, n long, need int, starts array<int>, ends array<int>")


def _listed(parts: DataFrame, sizes: dict[str, int], qmin: int) -> DataFrame:
    """Index entries: word, n, plain, gram, at and letters, without the need - 1 grams with the longest lists."""
    shared = parts.sparkSession.sparkContext.broadcast(sizes)

    def run(batches):
        size = shared.value
        for b in batches:
            out = defaultdict(list)
            for w, n, need, starts, ends in zip(*(b.column(c).to_pylist() for c in ("word", "n", "need", "starts", "ends"))):
                found = sorted((size[w[a:e]], w[a:e], a) for a, e in zip(starts, ends))
                entries = [(False, g, a) for _, g, a in found[:len(found) - max(need, 1) + 1]]
                if need < 1:
                    entries += [(True, w[a:a + qmin], a) for a in range(len(w) - qmin + 1)]
                for plain, g, a in entries:
                    for c, v in zip(("word", "n", "plain", "gram", "at", "letters"), (w, n, plain, g, a, len(w))):
                        out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, _LISTED)

    return parts.mapInArrow(run, "word string, n long, plain boolean, gram string, at int, letters int")


_LISTED = pa.schema([("word", pa.string()), ("n", pa.int64()), ("plain", pa.bool_()), ("gram", pa.string()),
                     ("at", pa.int32()), ("letters", pa.int32())])


def near_words(words: DataFrame, qmin: int = QMIN, qmax: int = QMAX, frequent: int = FREQUENT) -> DataFrame:
    """(word, n, other, other_n), both ways, of the distinct words that one edit turns into each other."""
    parts = written(_decomposed(words, gram_dictionary(words, qmin, qmax, frequent), qmin, qmax), "word-grams")
    spots = parts.select("word", F.explode(F.arrays_zip("starts", "ends")).alias("g"))
    sizes = spots.groupBy(F.substring("word", F.col("g.starts") + 1, F.col("g.ends") - F.col("g.starts")).alias("gram")).count()
    # one row per gram of the dictionary
    lists = written(_listed(parts, {r[0]: r[1] for r in sizes.collect()}, qmin), "gram-lists")
    # a word looks for replaced letters at its own length, for an inserted one at the next: before it, and after
    looks = F.array(F.struct(F.lit(0).alias("longer"), F.lit(0).alias("moved")),
                    F.struct(F.lit(1).alias("longer"), F.lit(0).alias("moved")),
                    F.struct(F.lit(1).alias("longer"), F.lit(1).alias("moved")))
    asked = lists.select("word", "n", "plain", "gram", "at", "letters", F.explode(looks).alias("l")).select(
        "word", "n", "plain", "gram", (F.col("at") + F.col("l.moved")).alias("at"),
        (F.col("letters") + F.col("l.longer")).alias("letters"), (F.col("l.longer") == 0).alias("same"))
    index = lists.select(F.col("word").alias("other"), F.col("n").alias("other_n"), "plain", "gram", "at", "letters")
    met = asked.join(index, ["plain", "gram", "at", "letters"]).where(
        (~F.col("same") | (F.col("word") < F.col("other"))) & (F.levenshtein("word", "other", 1) == 1))
    pairs = written(met.select("word", "n", "other", "other_n").distinct(), "near-words")
    return pairs.union(pairs.select("other", "other_n", "word", "n"))


def _roots(forms: DataFrame, ratio: int) -> DataFrame:
    """(word, root) of the words with a form; counts grow ``ratio`` times a step, which bounds the rounds."""
    hops = written(forms.select("word", F.col("form").alias("root")), "forms")
    most = forms.agg(F.max("form_n")).first()[0]
    longest = 1 if most is None else 1 + int(math.log(most, ratio))
    for _ in range(longest.bit_length()):
        onward = hops.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        hops = written(hops.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root")), "roots")
    return hops


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of every distinct word."""
    words = written(word_counts(docs, doc_id, text), "words")
    near = near_words(words)
    best = near.groupBy("word", "n").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))).alias("best"))
    enough = -F.col("best.n") >= F.col("n") * ratio
    own = written(best.select("word", "n_near", F.when(enough, F.col("best.word")).alias("form"),
                              F.when(enough, -F.col("best.n")).alias("form_n")), "near-counts")
    roots = _roots(own.where("form is not null"), ratio)
    return (words.join(own, "word", "left").join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))
