"""Exact medians of open-to-close times without open x close pairs.

The metric of a (repository, day) is the median over all (close, earlier open)
pairs of its pull requests, quadratic for one that is reopened often. Here a
pull request sends counts instead of pairs, and the two middle values are found by rank
counting:

1. One row per (pull request, close day): its sorted opens and the day's sorted closes.
2. Durations are counted by key (duration >> shift, in microseconds) from the sorted
   lists, the pull requests of few pairs many at a time in numpy; where a close has more
   opens than there are keys, by binary search of the key borders, so the work is closes x keys and not closes x opens.
3. Counts are added up per group (partial aggregation first); the keys that
   hold the two middle ranks become the ranges of the next round. A range with few
   durations is counted by its exact values at once, a fuller one by keys of
   ``STEP_BITS`` more bits.

Two rounds settle all but very full groups; 64-bit durations need six at
most. A busy repository's day is spread over its pull requests, and a group
meets in one task as at most ``2 ** STEP_BITS`` counts per range. The timestamps of
one pull request (8 bytes each) travel as one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIRST_SHIFT = 36          # about 19 hours
STEP_BITS = 12
FEW = 1 << STEP_BITS
CELLS = 1 << 20

_HOUR_US = 3.6e9


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def close_days(opens: DataFrame, closes: DataFrame) -> DataFrame:
    """opens and closes (repo_name, number, ts) -> (repo_name, number, close_date, opens, closes), sorted microseconds."""
    o = opens.groupBy("repo_name", "number").agg(F.sort_array(F.collect_list(micros(F.col("ts")))).alias("opens"))
    c = closes.groupBy("repo_name", "number", F.to_date("ts").alias("close_date")).agg(
        F.sort_array(F.collect_list(micros(F.col("ts")))).alias("closes"))
    # an open after the day's last close pairs with none of them
    return c.join(o, ["repo_name", "number"]).withColumn(
        "opens", F.filter("opens", lambda x: x < F.element_at("closes", -1)))


def key_counts(opens: np.ndarray, closes: np.ndarray, shift: int, low: int = 0,
               bits: int = 63) -> tuple[np.ndarray, np.ndarray]:
    """(key, count) of the durations close - open > 0 in [low, low + 2^bits), key = duration >> shift."""
    if not len(opens) or not len(closes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    before = np.searchsorted(opens, closes, "left")
    longest = int(closes[-1] - opens[0])
    if longest < max(low, 1):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    high = longest + 1 if bits >= 63 else min(low + (1 << bits), longest + 1)
    first = np.searchsorted(opens, closes - high, "right")
    last = np.minimum(before, np.searchsorted(opens, closes - low, "right"))
    per_close = np.maximum(last - first, 0)
    keys = ((high - 1) >> shift) - (low >> shift) + 1
    if int(per_close.sum()) <= len(closes) * (keys + 1):
        out: list[np.ndarray] = []
        for a, b in _spans(per_close):
            n = per_close[a:b]
            at = np.repeat(first[a:b], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out.append((np.repeat(closes[a:b], n) - opens[at]) >> shift)
        return np.unique(np.concatenate(out), return_counts=True)
    base = low >> shift
    total = np.zeros(keys, np.int64)
    rows, part = max(1, CELLS // min(keys + 1, CELLS)), min(keys, CELLS)
    for a in range(0, len(closes), rows):
        c = closes[a:a + rows, None]
        for k in range(0, keys, part):
            border = np.arange(base + k, base + min(k + part, keys) + 1) << shift
            at_least = np.searchsorted(opens, c - border, "right")
            at_least = np.minimum(at_least, before[a:a + rows, None])
            total[k:k + part] += (at_least[:, :-1] - at_least[:, 1:]).sum(axis=0)
    some = np.flatnonzero(total)
    return some + base, total[some]


def _spans(sizes: np.ndarray):
    """Runs of rows with at most ``CELLS`` cells in all (one row at least)."""
    ends = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CELLS, "right")))
        yield a, b
        a = b


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, starts, lengths) of a list column."""
    lens = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lens) - lens, lens


def _groups(b: pa.RecordBatch, key: list[str]) -> tuple[np.ndarray, pa.Array]:
    """The number of each row's key in the batch, and a row with that key by number."""
    code = np.zeros(b.num_rows, np.int64)
    for c in key:
        words = b.column(c).dictionary_encode("encode")
        code = code * (len(words.dictionary) + 1) + words.indices.to_numpy(zero_copy_only=False)
    _, place, group = np.unique(code, return_index=True, return_inverse=True)
    return group, pa.array(place)


def _batch_counts(opens: tuple, closes: tuple, row: np.ndarray, low: np.ndarray, bits: np.ndarray,
                  shift: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, low, shift, key, count) of the durations of many rows, each within its range: rows of few pairs
    together, ``CELLS`` pairs at a time, fuller ones by ``key_counts``."""
    (o, o_at, o_len), (c, c_at, c_len) = opens, closes
    pairs = o_len[row] * c_len[row]
    parts = []
    few = np.flatnonzero((pairs > 0) & (pairs <= FEW))
    for a, z in _spans(pairs[few]):
        own = few[a:z]
        n = pairs[own]
        which = np.repeat(own, n)
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        r = row[which]
        span = c[c_at[r] + nth // o_len[r]] - o[o_at[r] + nth % o_len[r]]
        beyond = span - low[which] >> np.minimum(bits[which], 62)  # 0 within the range
        use = np.flatnonzero((span > 0) & (span >= low[which]) & ((beyond == 0) | (bits[which] >= 63)))
        which, span = which[use], span[use]
        parts.append((row[which], low[which], shift[which], span >> shift[which], np.ones(len(use), np.int64)))
    for j in np.flatnonzero(pairs > FEW).tolist():
        r = row[j]
        k, n = key_counts(o[o_at[r]:o_at[r] + o_len[r]], c[c_at[r]:c_at[r] + c_len[r]], int(shift[j]), int(low[j]), int(bits[j]))
        parts.append((np.full(len(k), r), np.full(len(k), low[j]), np.full(len(k), shift[j]), k, n))
    return tuple(np.concatenate(p).astype(np.int64) if parts else np.empty(0, np.int64) for p in (zip(*parts) if parts else [()] * 5))


_COUNTS = "repo_name string, close_date date, low long, shift int, key long, n long"


def _counted(units: DataFrame, ranges: DataFrame | None) -> DataFrame:
    """Counts by key of every (repo_name, close_date) and range."""
    key = ["repo_name", "close_date"]
    src = units.select(*key, "opens", "closes")
    narrowed = ranges is not None
    if narrowed:
        src = src.join(ranges, key)

    def run(batches):
        for b in batches:
            opens, closes = (_flat(b.column(c)) for c in ("opens", "closes"))
            row = np.arange(b.num_rows)
            low, bits, shift = np.zeros(len(row), np.int64), np.full(len(row), 63), np.full(len(row), FIRST_SHIFT)
            if narrowed:
                spans = b.column("ranges")
                row = np.repeat(row, np.diff(spans.offsets.to_numpy()))
                low, bits, shift = (spans.flatten().field(f).to_numpy().astype(np.int64) for f in ("low", "bits", "next"))
            at, *counted = _batch_counts(opens, closes, row, low, bits, shift)
            # one row per group of the batch, range and key: pull requests of one day meet here already
            group, place = _groups(b, key)
            t = pa.table([group[at], *counted], ["group", "low", "shift", "key", "n"])
            t = t.group_by(["group", "low", "shift", "key"]).aggregate([("n", "sum")]).combine_chunks()
            own = place.take(t.column("group").combine_chunks())
            yield from pa.table([*(b.column(c).take(own) for c in key), t.column("low"), t.column("shift").cast(pa.int32()), t.column("key"),
                                 t.column("n_sum")], [*key, "low", "shift", "key", "n"]).to_batches()

    return (src.mapInArrow(run, _COUNTS).groupBy(*key, "low", "shift", "key").agg(F.sum("n").alias("n")))


def cycle_medians(units: DataFrame, resolution_bits: int = 0) -> DataFrame:
    """(repo_name, close_date, median_hours, n_pairs) of ``close_days`` rows.

    ``resolution_bits`` > 0 stops at keys of that many bits (20: about a
    second) and takes their middle. Days without a close after an open are left out.
    """
    key = ["repo_name", "close_date"]
    units = units.select(*key, "opens", "closes").checkpoint()
    counts = _counted(units, None)
    group = Window.partitionBy(*key, "low").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n_pairs = F.sum("n").over(Window.partitionBy(*key))
    ranked = counts.withColumn("n_pairs", n_pairs).withColumn("upto", F.sum("n").over(group))
    wanted = ranked.select("*", F.posexplode(F.array(F.floor((F.col("n_pairs") - 1) / 2).cast("long"),
                                                     F.floor(F.col("n_pairs") / 2).cast("long"))).alias("which", "rank"))
    found = []
    while True:
        # the key of each wanted rank, and the rank that is left within it
        held = wanted.where((F.col("upto") - F.col("n") <= F.col("rank")) & (F.col("rank") < F.col("upto"))).select(
            *key, "which", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "n_pairs",
            F.expr("shiftleft(key, shift)").alias("low"), F.col("shift").alias("bits"), "n").checkpoint()
        done = held.where(F.col("bits") <= resolution_bits)
        found.append(done)
        left = held.where(F.col("bits") > resolution_bits)
        if left.isEmpty():
            break
        follow = F.when(F.col("n") <= FEW, F.lit(resolution_bits)).otherwise(
            F.greatest(F.lit(resolution_bits), F.col("bits") - STEP_BITS))
        ranges = left.select(*key, "low", "bits", follow.cast("int").alias("next")).distinct().groupBy(*key).agg(
            F.collect_list(F.struct("low", "bits", "next")).alias("ranges"))
        ranked = _counted(units, ranges).withColumn("upto", F.sum("n").over(group))
        wanted = ranked.join(left.select(*key, "low", "which", "rank", "n_pairs"), [*key, "low"])
    values = found[0]
    for more in found[1:]:
        values = values.unionByName(more)
    middle = F.col("low") + F.expr("shiftleft(1L, bits)") / 2 - F.when(F.col("bits") == 0, 0.5).otherwise(0.0)
    return values.groupBy(*key).agg((F.sum(middle) / 2 / F.lit(_HOUR_US)).alias("median_hours"),
                                    F.max("n_pairs").alias("n_pairs"))
