"""BPE encoding and decoding over a contiguous rank array.

A tokenizer file of the ``tokenizers`` library names the vocabulary, the merges,
the normaliser and the pre-tokeniser. A pre-token's parts are kept as an array
of boundaries with the merge rank of each adjacent pair beside it; the smallest
rank is found by scanning, its boundary is deleted and the two neighbouring
ranks are refreshed, until no pair has a rank. Words are short, so the scan
beats a heap; words are merged many at a time, a row of the two arrays each; runs of more
than ``SCAN_PARTS`` parts use a heap over linked parts. All make the same merges.

Pre-tokens are those of the library's own pre-tokenizer. Texts are cut into words that
encode alone (``pieces``); each distinct word of a block is looked up in a
bounded cache, and a text's ids, digests and decoded text are joined from its words.
Null is the empty text: no ids, empty decoding. Without rows the result is empty.
"""

from __future__ import annotations

import json
import re
from array import array
from hashlib import sha256
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType
from tokenizers import Tokenizer

from vitals.llm.blocks import bounded_batches, text_blocks
from vitals.llm.pieces import CACHE_BYTES, CutBlock, WordTable, cuts_into_words, plain

CACHE_WORDS = 500_000
MANY_WORDS = 4096
BLOCK_BYTES = 2 << 20

SCAN_PARTS = 400

_NO_RANK = 1 << 30


def merge_ids(parts: list[int], ranks_of: dict[tuple[int, int], int], merged: list[int]) -> list[int]:
    """Merge symbol ids by rank: ``ranks_of`` two ids, ``merged`` the id that a rank makes."""
    if len(parts) < 2:
        return parts
    if len(parts) > SCAN_PARTS:
        return _merge_long(parts, ranks_of, merged)
    rank = ranks_of.get
    ranks = [rank(p, _NO_RANK) for p in zip(parts, parts[1:])]
    while ranks:
        low = min(ranks)
        if low == _NO_RANK:
            break
        i = ranks.index(low)
        parts[i] = merged[low]
        del parts[i + 1], ranks[i]
        if i:
            ranks[i - 1] = rank((parts[i - 1], parts[i]), _NO_RANK)
        if i < len(ranks):
            ranks[i] = rank((parts[i], parts[i + 1]), _NO_RANK)
    return parts


def _merge_long(parts: list[int], ranks_of: dict[tuple[int, int], int], merged: list[int]) -> list[int]:
    """``merge_ids`` in n log n: the lowest rank, leftmost first, from a heap; outdated entries are skipped."""
    n = len(parts)
    rank = ranks_of.get
    ranks = [*(rank(p, _NO_RANK) for p in zip(parts, parts[1:])), _NO_RANK]
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i) for i, r in enumerate(ranks) if r != _NO_RANK]
    heapify(heap)
    gone = bytearray(n)

    def refresh(i: int) -> None:
        ranks[i] = rank((parts[i], parts[after[i]]), _NO_RANK) if after[i] < n else _NO_RANK
        if ranks[i] != _NO_RANK:
            heappush(heap, (ranks[i], i))

    while heap:
        low, i = heappop(heap)
        if gone[i] or ranks[i] != low:
            continue
        j = after[i]
        parts[i] = merged[low]
        gone[j] = 1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        refresh(i)
        if before[i] >= 0:
            refresh(before[i])
    return [p for p, g in zip(parts, gone) if not g]


class PairRanks:
    """Ranks and merged ids of symbol pairs, looked up many at a time."""

    def __init__(self, ranks_of: dict[tuple[int, int], int], merged: list[int], size: int):
        keys = np.fromiter((a * size + b for a, b in ranks_of), np.int64, len(ranks_of))
        order = np.argsort(keys)
        self.size, self.keys = size, keys[order]
        self.rank = np.fromiter(ranks_of.values(), np.int64, len(ranks_of))[order]
        self.merged = np.array(merged, np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NO_RANK)


def merge_many(parts: np.ndarray, count: np.ndarray, pairs: PairRanks) -> tuple[np.ndarray, np.ndarray]:
    """``merge_ids`` of many words: a row of ``parts`` holds ``count`` symbol ids."""
    columns = np.arange(parts.shape[1])
    ranks = np.full(parts.shape, _NO_RANK)
    row, col = np.nonzero(columns[None] < count[:, None] - 1)
    ranks[row, col] = pairs.ranks(parts[row, col], parts[row, col + 1])
    rows = np.arange(len(parts))
    while True:
        at = ranks[rows].argmin(axis=1)
        low = ranks[rows, at]
        more = low < _NO_RANK
        rows, at, low = rows[more], at[more], low[more]
        if not len(rows):
            return parts, count
        # the boundary behind the merged part goes: what follows moves up
        follows = np.minimum(columns + (columns > at[:, None]), len(columns) - 1)
        own = np.take_along_axis(parts[rows], follows, axis=1)
        own_ranks = np.take_along_axis(ranks[rows], np.minimum(columns + (columns >= at[:, None]), len(columns) - 1), axis=1)
        count[rows] -= 1
        each = np.arange(len(rows))
        own[each, at] = pairs.merged[low]
        own_ranks[columns >= count[rows][:, None] - 1] = _NO_RANK
        left = np.flatnonzero(at > 0)
        own_ranks[left, at[left] - 1] = pairs.ranks(own[left, at[left] - 1], own[left, at[left]])
        right = np.flatnonzero(at + 1 < count[rows])
        own_ranks[right, at[right]] = pairs.ranks(own[right, at[right]], own[right, at[right] + 1])
        parts[rows], ranks[rows] = own, own_ranks


class WordBPE:
    """Encoder and decoder for a byte-level BPE file with word-end suffixes."""

    def __init__(self, path: str):
        if not cuts_into_words(path):
            raise ValueError(f"{path} is not a word-level BPE file")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        library = Tokenizer.from_file(path)
        self.normalize = library.normalizer.normalize_str
        # words in the printable letters that stand for bytes, as the vocabulary has them
        self.pretokens = library.pre_tokenizer.pre_tokenize_str
        self.symbol = {c: i for c, i in vocab.items()}
        self.ranks_of = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(model["merges"])}
        self.merged = [vocab[a + b] for a, b in model["merges"]]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = added
        self.added_split = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        size = max([*vocab.values(), *added.values()]) + 1
        self.text = [""] * size
        for c, i in [*vocab.items(), *added.items()]:
            self.text[i] = c
        self.id_text = pa.array([c.encode() for c in self.text], pa.binary())
        self.id_number = pa.array([str(i).encode() for i in range(size)], pa.binary())
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        self.code = "H" if size <= 1 << 16 else "I"
        self.pairs = PairRanks(self.ranks_of, self.merged, size)
        letters = range(max(map(ord, "".join(c for c in vocab if len(c) == 1))) + 2)
        self.inner_id = np.array([self.symbol.get(chr(c), -1) for c in letters])
        self.final_id = np.array([self.symbol.get(chr(c) + self.suffix, -1) for c in letters])
        self.words = WordTable(self.encode_many, self.encode_text, list(added), CACHE_WORDS)

    def _word(self, word: str) -> list[int]:
        chars = list(word)
        chars[-1] += self.suffix
        # a byte letter without an id of its own is left out
        return merge_ids([self.symbol[c] for c in chars if c in self.symbol], self.ranks_of, self.merged)

    def _packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def encode_text(self, text: bytes) -> bytes:
        """Packed ids of a text of any kind, added tokens among it."""
        whole = text.decode("utf-8", "replace")
        out: list[int] = []
        for part in self.added_split.split(whole) if self.added_split else [whole]:
            if part in self.added:
                out.append(self.added[part])
            elif part:
                for word, _ in self.pretokens(self.normalize(part)):
                    out += self._word(word)
        return self._packed(out)

    def _cut(self, words: list[str]) -> list[list[str]]:
        """The pre-tokens of words without white space and added tokens, all in one call of the library."""
        normal = self.normalize(" ".join(words))
        ends = np.cumsum([len(w) + 1 for w in normal.split(" ")])
        if len(ends) != len(words):  # white space beyond ASCII inside a word
            return [[t for t, _ in self.pretokens(self.normalize(w))] for w in words]
        out: list[list[str]] = [[] for _ in words]
        found = self.pretokens(normal)
        at = np.searchsorted(ends, [start for _, (start, _) in found], "right")
        for (t, _), i in zip(found, at.tolist()):
            out[i].append(t)
        return out

    def encode_many(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of words without white space and added tokens."""
        out = []
        for a in range(0, len(words), MANY_WORDS):
            own = words[a:a + MANY_WORDS]
            cut = [[w.decode()] if plain(w) else None for w in own]
            other = [i for i, c in enumerate(cut) if c is None]
            for i, c in zip(other, self._cut([own[i].decode("utf-8", "replace") for i in other])):
                cut[i] = c
            merged = self._merged(list({t for c in cut for t in c}))
            out += [self._packed(merged[c[0]] if len(c) == 1 else [x for t in c for x in merged[t]]) for c in cut]
        return out

    def _merged(self, words: list[str]) -> dict[str, list[int]]:
        """The ids of pre-tokens."""
        out = {}
        short = [w for w in words if len(w) <= CACHE_BYTES and ord(max(w)) < len(self.inner_id)]
        if short:
            count = np.fromiter(map(len, short), np.int64, len(short))
            letters = np.frombuffer("".join(short).encode("utf-32-le"), np.uint32)
            last = np.cumsum(count) - 1
            ids = self.inner_id[letters]
            ids[last] = self.final_id[letters[last]]
            parts = np.full((len(short), int(count.max())), -1, np.int64)
            parts[np.arange(parts.shape[1]) < count[:, None]] = ids
            known = np.minimum.reduceat(ids, np.concatenate([[0], last[:-1] + 1])) >= 0
            parts, count = merge_many(parts[known], count[known], self.pairs)
            out = {short[i]: row[:n] for i, row, n in zip(np.flatnonzero(known).tolist(), parts.tolist(), count.tolist())}
        return {w: out[w] if w in out else self._word(w) for w in words}


_LOADED: dict[str, WordBPE] = {}


def load(path: str) -> WordBPE:
    """The encoder of a file, kept by the Python worker with its cache."""
    if path not in _LOADED:
        _LOADED[path] = WordBPE(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text",
                     ids: bool = True, decoded: bool = False, digests: bool = False) -> DataFrame:
    """Per row: the ``keep`` columns and n_tokens, and on request the ids, the
    text decoded from them, and the SHA-256 of both.

    ``ids`` is an array of ints. The digests are of the decimal ids joined by a
    space and of the decoded text in UTF-8.
    """
    src = docs.select(*keep, F.col(text).alias("__text"))
    schema = src.drop("__text").schema.add("n_tokens", "long")
    wanted = [("ids", "array<int>", ids), ("decoded", "string", decoded),
              ("ids_sha256", "string", digests), ("decoded_sha256", "string", digests)]
    for name, kind, use in wanted:
        if use:
            schema = schema.add(name, DataType.fromDDL(kind))
    names = [*keep, "n_tokens", *(n for n, _, use in wanted if use)]

    def run(batches):
        bpe = load(path)
        for b in text_blocks(batches, "__text", BLOCK_BYTES):
            block = CutBlock(b.column("__text"), bpe.words, bpe.dtype().itemsize)
            columns = [*(b.column(n) for n in keep), pa.array(block.n_ids)]
            packed = pa.array(block.packed, pa.binary())
            if ids:
                flat = np.frombuffer(b"".join(block.joined(packed, b"").to_pylist()), bpe.dtype)
                ends = np.concatenate([[0], np.cumsum(block.n_ids)])
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())))
            if decoded or digests:
                of_words = np.frombuffer(b"".join(block.packed), bpe.dtype)
                # the file has no decoder, which means the token texts joined by one space
                back = block.joined(block.texts_of_ids(of_words, bpe.id_text), b" ")
                if decoded:
                    columns.append(back.cast(pa.string()))
                if digests:
                    decimal = block.joined(block.texts_of_ids(of_words, bpe.id_number), b" ")
                    columns += [pa.array([sha256(x).hexdigest() for x in texts.to_pylist()], pa.string())
                                for texts in (decimal, back)]
            yield pa.RecordBatch.from_arrays(columns, names)
    bounded_batches(docs.sparkSession)
    return src.mapInArrow(run, schema)
