"""Plain single-process versions of the training-data contracts."""

from __future__ import annotations

import hashlib
import re

import xxhash

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def base_spans(text: str | None) -> list[tuple[int, int, str, int]]:
    text = text or ""
    out = []
    assign = r"(?a)(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    for rank, (kind, pattern, ok) in enumerate([
            ("assign", assign, lambda m: len(m[2]) >= 12),
            ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
            ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16)]):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text) if ok(m)]
    return sorted(out)


def simhash(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids: list, codes: list[int], radius: int = 2) -> list:
    """Smallest non-null id reachable, per row."""
    parent = list(range(len(codes)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    low: dict[int, int] = {}
    for i, x in enumerate(ids):
        if x is not None:
            low[find(i)] = min(x, low.get(find(i), x))
    return [low.get(find(i)) for i in range(len(codes))]


def bench_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))


def contamination(text: str | None, items: list[tuple], window: int = 10) -> tuple[int, int, list[str]]:
    words = bench_words(text)
    hit, found = set(), set()
    for item, item_text in items:
        b = bench_words(item_text)
        if item is None or not b:
            continue
        n = min(window, len(b))
        wins = {tuple(b[i:i + n]) for i in range(len(b) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i:i + n]) in wins:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


def quality(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    twice = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(twice)
