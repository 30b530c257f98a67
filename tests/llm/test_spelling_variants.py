"""Spelling variants against comparing all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from vitals.llm import spelling_variants as sv

from . import brute as B


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(B.ASCII_LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 5 * n[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w
    return Counter((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n)


def _edited(rng, w, letters):
    i = rng.randrange(len(w) + 1)
    kind = rng.randrange(3)
    if kind == 0:
        return w[:i] + rng.choice(letters) + w[i:]
    return w[:i] + (rng.choice(letters) if kind == 1 else "") + w[i + 1:]


def _rows(seed=2):
    rng = random.Random(seed)
    letters = "abcé"
    words = ["".join(rng.choices(letters, k=rng.randint(5, 11))) for _ in range(120)]
    for _ in range(3):
        words += [_edited(rng, w, letters) for w in rng.sample(words, 100)]
    words += ["aaaaaa", "aaaaaaa", "aaaaaaaa", "abababab", "babababa", "ababababa", "ÀÉîõü×÷ß", "àéîõü×÷ß", "x" * 3000, "x" * 3001]
    weight = [rng.choice([1, 1, 6, 30, 200]) for _ in words]
    rows = []
    for i in range(120):
        sep = rng.choice([" ", "-", "\n", "日", "ā", "7"])
        rows.append((i, sep.join(w.upper() if rng.random() < 0.2 else w for w in rng.choices(words, weight, k=150))))
    rows += [(500 + i, "x" * 3000 + " " + "x" * 3001) for i in range(6)]
    rows += [(700 + i, "chainword chainwordx chainwordxy " + "chainwordx " * 6 + "chainwordxy " * 50) for i in range(7)]
    return [*rows, (None, "aaaaaaa bababab"), (None, None), (7, ""), (8, " 1 "), rows[0], rows[0]]


@pytest.mark.parametrize("qmax,frequent", [(4, 4096), (4, 20), (3, 10 ** 6), (6, 10 ** 6), (2, 1)])
def test_variants(spark, monkeypatch, qmax, frequent):
    monkeypatch.setattr(sv, "TASK_WORDS", 100)
    rows = _rows()
    docs = spark.createDataFrame([(*r, 1, "f", "g") for r in rows], "doc_id long, text string, n int, form string, gram string")
    real = sv.near_words
    monkeypatch.setattr(sv, "near_words", lambda words: real(words, 2, qmax, frequent))
    got = sv.spelling_variants(docs.repartition(3))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute(rows)
    assert Counter(map(tuple, got.collect())) == want
    assert any(r[1] for r in want) and any(r[2] != r[1] and r[1] for r in want)


def test_empty(spark):
    assert sv.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_affected_bound_holds_for_every_edit():
    """No edit changes more grams than the bound says, for any dictionary."""
    rng = random.Random(6)
    letters = "abc"
    for _ in range(300):
        grams = ["".join(rng.choices(letters, k=rng.randint(3, 5))) for _ in range(rng.randint(0, 60))]
        d = sv.GramDictionary(grams, 2, 5)
        w = "".join(rng.choices(letters, k=rng.randint(6, 12)))
        own = d.decompose(w)
        bound = d.affected(w, own)
        for i in range(len(w) + 1):
            edits = [(w[:i] + c + w[i:], 1) for c in "abcd"]
            if i < len(w):
                edits += [(w[:i] + c + w[i + 1:], 0) for c in "abcd" if c != w[i]] + [(w[:i] + w[i + 1:], -1)]
            for x, shift in edits:
                theirs = {(a, x[a:b]) for a, b in d.decompose(x)}
                kept = sum((a, w[a:b]) in theirs if b <= i else (a + shift, w[a:b]) in theirs and a >= i + (shift < 1)
                           for a, b in own)
                assert len(own) - kept <= bound
