"""Epsilon grid order join against brute force."""

import math
from collections import Counter

import numpy as np
import pytest

from vitals.llm import grid_order

SCHEMA = "vec_id long, embedding array<float>, label int, entry string, n string, root string"


def brute(rows, least=0.9):
    usable = {}
    for i, r in enumerate(rows):
        v = r[1]
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(np.float64)
            usable[i] = x / np.sqrt(x @ x)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    links = Counter()
    for i in usable:
        for j in usable:
            if i < j and len(usable[i]) == len(usable[j]) and usable[i] @ usable[j] >= least:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(r[0], low.get(find(i), r[0]))
    return Counter((r[0], links[i], low.get(find(i)), r[0] is not None and r[0] == low.get(find(i)))
                   for i, r in enumerate(rows))


def _rows():
    rng = np.random.default_rng(4)
    vecs = []
    for k in range(40):  # groups of near copies of every size, in few dimensions so that groups touch
        c = rng.normal(size=12)
        c /= np.linalg.norm(c)
        vecs += [c + rng.normal(size=12) * s for s in rng.uniform(0.01, 0.2, k % 9 + 1)]
    vecs += [vecs[3] * 5, vecs[3], vecs[3], *([vecs[10]] * 30)]
    odd = [None, [], [0.0] * 12, [1.0, None] + [0.0] * 10, [float("nan")] + [1.0] * 11, [float("inf")] * 12,
           [1.0, 0.0], [1.0, 0.1], [1e30, 1e30] + [0.0] * 10, [1e-30, 1e-30] + [0.0] * 10, [-0.0, 1.0], [0.0, 1.0]]
    rows = [[float(x) for x in v] for v in vecs] + odd
    ids = rng.permutation(len(rows)).tolist()
    out = [(ids[i], v, 1, "x", "y", "z") for i, v in enumerate(rows)]
    return [*out, out[0], (None, rows[0], 1, "x", "y", "z"), (None, None, 1, "x", "y", "z"), (None, rows[40], 1, None, None, None)]


@pytest.mark.parametrize("interval,leaf", [(4096, 512), (16, 4)])
def test_links_and_components(spark, monkeypatch, interval, leaf):
    monkeypatch.setattr(grid_order, "INTERVAL_ROWS", interval)
    monkeypatch.setattr(grid_order, "LEAF_ROWS", leaf)
    monkeypatch.setattr(grid_order, "RUN_INTERVALS", 5)
    rows = _rows()
    got = grid_order.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_every_interval_count(spark, monkeypatch):
    """Each pair of intervals is joined once, for odd and even numbers of them."""
    monkeypatch.setattr(grid_order, "INTERVAL_ROWS", 3)
    monkeypatch.setattr(grid_order, "RUN_INTERVALS", 2)
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 12, 17):
        rows = [(i, [float(x) for x in rng.normal(size=3)], 0, "", "", "") for i in range(n)]
        got = grid_order.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(1), least=0.5)
        assert Counter(map(tuple, got.collect())) == brute(rows, 0.5)


def test_empty(spark):
    assert grid_order.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_distant_blocks_are_skipped(monkeypatch):
    """Blocks in distant cells are left out without a comparison."""
    rng = np.random.default_rng(2)
    base = np.repeat(np.eye(8), 200, axis=0) + rng.normal(size=(1600, 8)) * 0.01
    dim, axes = grid_order.directions(base[::10].tolist(), 8)
    p = grid_order.Projection(dim, axes, math.sqrt(0.2))
    x = grid_order._Interval.__new__(grid_order._Interval)
    order = np.lexsort(p.cells(grid_order.unit(base)).T[::-1])
    x.exact = grid_order.unit(base[order])
    x.ids, x.rough, x.at, x.boxes = np.arange(1600), x.exact.astype(np.float32), p.coordinates(x.exact), {}
    monkeypatch.setattr(grid_order, "LEAF_ROWS", 50)
    compared = []
    pairs = 0
    real = np.nonzero
    monkeypatch.setattr(grid_order.np, "nonzero", lambda s: (compared.append(s.size), real(s))[1])
    for i, _ in grid_order._close_pairs(x, x, 0.9, 0.2, True):
        pairs += len(i)
    assert pairs == 8 * 200 * 199 // 2
    assert sum(compared) < 0.25 * 1600 * 1600
