"""Cutting texts into words that a word-level tokenizer file encodes alone.

A block of texts is cut in Arrow and its words are dictionary-encoded, so Python
sees every distinct word once per block; words not seen before are encoded together, and what belongs to a
text is put together from its words in Arrow again.

For files whose normaliser is NFC, white space to one space and lower case, and
whose pre-tokeniser keeps the matches of ``WORD_PATTERN``:

* white space is never part of a match, and nothing composes over it;
* a match that holds an ASCII letter ends before ASCII punctuation, which does
  not compose with the letter before it either;
* upper and lower case of ASCII letters give the same ids, also beside other letters.

Texts that hold an added token are encoded whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_BYTES = 64

#: Fixed value: the split pattern of the tokenizer files these rules hold for.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_CUT = r"([A-Za-z])([!-/:-@\[-`{-~])"


def cuts_into_words(path: str) -> bool:
    """Whether the rules above hold for a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec.get("normalizer") or {}).get("normalizers") or []
    split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return ([s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
            and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
            and split.get("type") == "Split" and split["pattern"] == {"Regex": WORD_PATTERN}
            and split["behavior"] == "Removed" and split["invert"]
            and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or not re.search(_CUT, t["content"])
                        for t in spec["added_tokens"]))


class WordTable(dict):
    """Bounded cache from words to packed ids.

    ``encode_many`` encodes the words that are not in it, ``encode_text`` a text with added tokens.
    """

    def __init__(self, encode_many: Callable[[list[bytes]], list[bytes]], encode_text: Callable[[bytes], bytes],
                 added: list[str], most: int):
        super().__init__()
        self.encode_many, self.encode_text, self.added, self.most = encode_many, encode_text, added, most

    def many(self, words: list[bytes]) -> list[bytes]:
        found = list(map(self.get, words))
        new = [i for i, x in enumerate(found) if x is None]
        if new:
            if len(self) + len(new) > self.most:
                self.clear()
            for i, x in zip(new, self.encode_many([words[i] for i in new])):
                found[i] = x
                if len(words[i]) <= CACHE_BYTES:
                    self[words[i]] = x
        return found


def plain(word: bytes) -> bool:
    """Whether a word is one match of lower-case ASCII letters."""
    return word.isalpha() and len(word) <= CACHE_BYTES


class CutBlock:
    """The words of a block of texts; ``packed`` has the ids of each distinct one. Words without ids are left out."""

    def __init__(self, texts: pa.Array, table: WordTable, code_bytes: int):
        texts = pc.fill_null(texts, "")
        texts = texts if texts.type == pa.string() else texts.cast(pa.string())
        marked = np.zeros(len(texts), bool)
        for token in table.added:
            marked |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        whole = np.flatnonzero(marked)
        special = [table.encode_text(t) for t in texts.take(pa.array(whole)).cast(pa.binary()).to_pylist()]
        if len(whole):
            texts = pc.if_else(pa.array(marked), "", texts)
        parts = pc.ascii_split_whitespace(texts)
        coded = pc.ascii_lower(parts.flatten()).dictionary_encode()
        cut = pc.ascii_split_whitespace(pc.replace_substring_regex(coded.dictionary, _CUT, r"\1 \2"))
        words = cut.flatten().dictionary_encode()
        self.packed = table.many(words.dictionary.cast(pa.binary()).to_pylist()) + special
        self.sizes = sizes = np.fromiter(map(len, self.packed), np.int64, len(self.packed)) // code_bytes

        # the words of each piece in place of the piece
        piece, piece_at = coded.indices.to_numpy(), parts.offsets.to_numpy()
        start, count = cut.offsets.to_numpy()[:-1], np.diff(cut.offsets.to_numpy())
        n = count[piece]
        ends = np.concatenate([[0], np.cumsum(n)])
        codes = words.indices.to_numpy()[np.repeat(start[piece], n) + np.arange(ends[-1]) - np.repeat(ends[:-1], n)]
        offsets = ends[piece_at - piece_at[0]]
        if len(whole):
            codes = np.insert(codes, offsets[whole], len(words.dictionary) + np.arange(len(whole)))
            offsets = offsets + np.concatenate([[0], np.cumsum(marked)])
        used = sizes[codes] > 0
        self.codes = codes[used]
        self.offsets = np.concatenate([[0], np.cumsum(used)])[offsets]
        upto = np.concatenate([[0], np.cumsum(sizes[self.codes])])
        self.n_ids = upto[self.offsets[1:]] - upto[self.offsets[:-1]]

    def joined(self, values: pa.Array, between: bytes) -> pa.Array:
        """Per text, the values of its words (given per distinct word) with ``between`` them."""
        lists = pa.ListArray.from_arrays(pa.array(self.offsets, pa.int32()), values.take(pa.array(self.codes)))
        return pc.binary_join(lists, pa.scalar(between, pa.binary()))

    def texts_of_ids(self, ids: np.ndarray, text: pa.Array) -> pa.Array:
        """Per distinct word, the texts of its ids with a space between them; ``ids`` are those of all ``packed``."""
        ends = pa.array(np.concatenate([[0], np.cumsum(self.sizes)]), pa.int32())
        return pc.binary_join(pa.ListArray.from_arrays(ends, text.take(pa.array(ids))), pa.scalar(b" ", pa.binary()))
