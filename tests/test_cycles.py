"""Medians by rank counting against all pairs."""

import datetime as dt
import random
import statistics

import numpy as np
import pytest

from vitals.operators import cycles
from vitals.operators.metrics import pr_cycles

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id string, type string, repo_name string, actor_login string, created_at timestamp_ntz, payload string"


def _event(i, repo, number, action, ts):
    return (str(i), "PullRequestEvent", repo, "a", ts, f'{{"action":"{action}","number":{number}}}')


def _brute(rows):
    opens, closes = {}, {}
    for _, _, repo, _, ts, p in rows:
        side = opens if "opened" in p else closes
        side.setdefault((repo, p.split(":")[-1]), []).append(ts)
    hours = {}
    for key, cs in closes.items():
        for c in cs:
            for o in opens.get(key, []):
                if o < c:
                    hours.setdefault((key[0], c.date()), []).append((c - o).total_seconds() / 3600)
    return {k: (statistics.median(v), len(v)) for k, v in hours.items()}


@pytest.mark.parametrize("few,cells", [(4096, 1 << 20), (3, 64)])
def test_medians_equal_all_pairs(spark, monkeypatch, few, cells):
    monkeypatch.setattr(cycles, "FEW", few)
    monkeypatch.setattr(cycles, "CELLS", cells)
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        ts = T0 + dt.timedelta(microseconds=rng.choice([rng.randrange(20 * 86400 * 10 ** 6), rng.randrange(100) * 3600 * 10 ** 6]))
        rows.append(_event(i, f"r{i % 3}", rng.choice([1, 1, 1, rng.randrange(60)]), rng.choice(["opened", "closed"]), ts))
    rows += [_event(9000, "only", 1, "closed", T0), _event(9001, "same", 1, "opened", T0), _event(9002, "same", 1, "closed", T0)]
    got = pr_cycles(spark.createDataFrame(rows, SCHEMA)).collect()
    want = _brute(rows)
    assert {(r["repo_name"], r["close_date"]) for r in got} == set(want)
    for r in got:
        median, n = want[r["repo_name"], r["close_date"]]
        assert r["n_pairs"] == n and r["median_hours"] == pytest.approx(median, abs=1e-9)
    assert pr_cycles(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_pull_request_of_ten_thousand_reopenings(spark):
    """25 million pairs a day, none of them a row; the plan joins pull requests only."""
    from pyspark.sql import functions as F
    step = 10 * 60 * 10 ** 6 // 10
    ids = spark.range(20_000)
    ts = F.timestamp_add("MICROSECOND", F.col("id") * step, F.lit(T0))
    rows = ids.select(F.col("id").cast("string").alias("id"), F.lit("PullRequestEvent").alias("type"), F.lit("o/r").alias("repo_name"),
                      F.lit("a").alias("actor_login"), ts.alias("created_at"),
                      F.when(F.col("id") % 2 == 0, '{"action":"opened","number":5}').otherwise('{"action":"closed","number":5}').alias("payload"))
    got = pr_cycles(rows).collect()
    t = np.arange(20_000, dtype=np.int64) * step
    opens, closes = t[::2], t[1::2]
    want = {}
    for day in np.unique(closes // 86_400_000_000):
        c = closes[closes // 86_400_000_000 == day]
        v = np.concatenate([x - opens[opens < x] for x in c])
        want[int(day)] = (float(np.median(v)) / 3.6e9, len(v))
    assert len(got) == len(want)
    for r in got:
        median, n = want[(r["close_date"] - T0.date()).days]
        assert r["n_pairs"] == n and r["median_hours"] == pytest.approx(median, abs=1e-9)


def test_key_counts_by_borders_and_by_values():
    rng = np.random.default_rng(5)
    for _ in range(50):
        opens, closes = np.sort(rng.integers(0, 5000, 60)), np.sort(rng.integers(0, 5000, 40))
        v = (closes[:, None] - opens).ravel()
        for shift, low, bits in [(0, 0, 63), (4, 0, 63), (9, 0, 63), (3, 512, 9), (0, 64, 6), (12, 0, 63)]:
            inside = v[(v > 0) & (v >= low) & (v < low + (1 << min(bits, 40)))]
            keys, counts = np.unique(inside >> shift, return_counts=True)
            k, n = cycles.key_counts(opens, closes, shift, low, bits)
            assert k.tolist() == keys.tolist() and n.tolist() == counts.tolist()


def test_coarse_medians_are_within_their_resolution(spark):
    rows = [_event(i, "r", i % 7, "opened" if i < 100 else "closed", T0 + dt.timedelta(hours=i, seconds=i * i)) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    exact = {r["close_date"]: r["median_hours"] for r in pr_cycles(df).collect()}
    for r in pr_cycles(df, resolution_bits=20).collect():
        assert abs(r["median_hours"] - exact[r["close_date"]]) <= 2 ** 20 / 3.6e9


def test_counts_of_many_rows_together():
    """A batch's rows of few pairs are counted at once, the same as one by one."""
    from collections import Counter

    import pyarrow as pa

    from vitals.operators import cycles as C
    rng = np.random.default_rng(5)
    times = lambda n: np.sort(rng.integers(0, 2 ** 43, n)).tolist()
    rows = [(times(rng.integers(0, 8)), times(rng.integers(0, 8))) for _ in range(200)] + [(times(100), times(100)), ([], [1]), ([7], [7])]
    sides = [C._flat(pa.array([r[i] for r in rows], pa.list_(pa.int64()))) for i in (0, 1)]
    n = len(rows)
    for low, bits, shift in ((0, 63, C.FIRST_SHIFT), (5 << 36, 36, 24), (5 << 36, 36, 0)):
        got, want = Counter(), Counter()
        for r, a, s, k, m in zip(*C._batch_counts(*sides, np.arange(n), np.full(n, low), np.full(n, bits), np.full(n, shift))):
            got[r, a, s, k] += m
        for r, (o, c) in enumerate(rows):
            for k, m in zip(*C.key_counts(np.array(o, np.int64), np.array(c, np.int64), shift, low, bits)):
                want[r, low, shift, k] += m
        assert got == want and got
