"""Source divergence against plain integers, and the skyband against pairwise dominance."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from vitals.llm import source_divergence as sd

from . import brute as B


def brute(rows, top=200, min_docs=3):
    docs = [((lang or ""), (source or ""),
             re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(B.ASCII_LOWER)))
            for text, lang, source in rows]
    seen, total, count = Counter(), Counter(), Counter()
    for lang, source, words in docs:
        seen.update((lang, w) for w in set(words))
    for lang, source, words in docs:
        for w in words:
            if seen[lang, w] >= min_docs:
                total[lang, w] += 1
                count[lang, source, w] += 1
    groups = sorted({d[:2] for d in docs})
    kept = defaultdict(list)
    for lang, w in total:
        kept[lang].append(w)
    out = []

    def p(n, size, v):
        return 1 + 10 ** 9 * (n + 1) // (size + v)
    for lang, source in groups:
        v = len(kept[lang])
        size = {s: sum(count[lang, s, w] for w in kept[lang]) for x, s in groups if x == lang}
        whole = sum(total[lang, w] for w in kept[lang])
        pairs = [(-sum((a - b) ** 2 // b for w in kept[lang] for a, b in [
            (p(count[lang, source, w], size[source], v), p(count[lang, s, w], size[s], v))]), s)
            for s in size if s != source]
        terms = []
        for w in kept[lang]:
            a, q = p(count[lang, source, w], size[source], v), p(total[lang, w], whole, v)
            if count[lang, source, w] and a > q:
                terms.append((-((a - q) ** 2 // q), w.encode(), w))
        out += [(lang, source, "pair", s, -x, i) for i, (x, s) in enumerate(sorted(pairs, key=lambda t: (t[0], t[1].encode())), 1)]
        out += [(lang, source, "term", w, -x, i) for i, (x, _, w) in enumerate(sorted(terms)[:top], 1)]
    return Counter(out)


def _rows():
    rng = random.Random(9)
    vocab = ["".join(rng.choices("abcdeé日", k=rng.randint(1, 4))) for _ in range(300)]
    rows = []
    for i in range(160):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None])
        own = vocab[:200] if source == "a" else vocab[100:]
        rows.append((" ".join(rng.choices(own, k=rng.randint(0, 120))).replace("a", "A", 3) + " 12_x9", lang, source))
    rows += [(None, "en", "empty"), ("", "fr", "x"), ("only here", "fr", "y"), ("9 9", "xx", ""), ("É é É", "yy", "one"),
             (" ".join(vocab) * 300, "en", "a"), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize("top", [200, 5])
def test_audit(spark, monkeypatch, top):
    monkeypatch.setattr(sd, "TASK_ENTRIES", 500)
    monkeypatch.setattr(sd, "TERM_BLOCK", 7)
    monkeypatch.setattr(sd, "SUM_CELLS", 10)
    rows = _rows()
    docs = spark.createDataFrame([(*r, "t", 1, "v") for r in rows],
                                 "text string, lang string, source string, term string, n int, value string").repartition(4)
    got = sd.audit(docs, top=top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(map(tuple, got.collect())) == brute(rows, top)


def test_empty(spark):
    assert sd.audit(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


def test_skyband_is_pairwise_dominance():
    rng = np.random.default_rng(3)
    for size in (0, 1, 600, 1500):
        n, total = rng.integers(1, 30, size), rng.integers(1, 30, size)
        term = np.array([f"w{i:05d}".encode() for i in rng.permutation(size)], object)
        place = np.array([int(t[1:]) for t in term], np.int64)
        by = (n >= n[:, None]) & (total <= total[:, None]) & (place < place[:, None]) if size else np.zeros((0, 0), bool)
        for k in (1, 3, 200):
            assert sorted(sd.skyband(n, total, term, k)) == np.flatnonzero(by.sum(axis=1) < k).tolist()


def test_shares_are_exact_for_large_counts():
    rng = random.Random(1)
    for _ in range(200):
        of = rng.randint(1, 9 * 10 ** 15)
        n = rng.randint(1, of)
        assert sd.share(np.array([n], np.int64), np.int64(of))[0] == 1 + 10 ** 9 * n // of
