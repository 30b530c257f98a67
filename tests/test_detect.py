"""Robust z-score, gates and the backfill/one-window equivalence."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vitals.operators.detect import detect_backfill, detection_audit

WE = dt.date(2024, 3, 31)


def _daily(spark, rows):
    """rows: list of (repo, day offset from WE, issue_opened, pr_hours, stars)."""
    data = [(r, WE - dt.timedelta(days=o), i, h, s) for r, o, i, h, s in rows]
    return spark.createDataFrame(
        data, "repo_name string, date date, issue_opened long, pr_median_merge_hours double, star_count long")


def _z(audit, repo, atype):
    r = audit.filter((F.col("repo_name") == repo) & (F.col("anomaly_type") == atype)).first()
    return r


def test_normal_mad(spark):
    # prior (offsets 7..34): values 10, 12, 14 cycling; recent: 30
    rows = [("r", o, [10, 12, 14][o % 3], None, 0) for o in range(7, 35)] + [("r", o, 30, None, 0) for o in range(7)]
    a = detection_audit(_daily(spark, rows), WE)
    r = _z(a, "r", "issue_spike")
    prior = sorted([10, 12, 14][o % 3] for o in range(7, 35))
    med = (prior[13] + prior[14]) / 2
    dev = sorted(abs(x - med) for x in prior)
    mad = (dev[13] + dev[14]) / 2
    assert r["n_prior"] == 28 and r["n_recent"] == 7
    assert r["baseline_value"] == pytest.approx(med)
    assert r["mad"] == pytest.approx(mad)
    assert r["z_score"] == pytest.approx(0.6745 * (30 - med) / mad)
    assert r["status"] == "anomaly"


def test_mad_zero_and_median_zero(spark):
    rows = [("flat", o, 4, None, 0) for o in range(7, 35)] + [("flat", o, 6, None, 0) for o in range(7)]
    a = detection_audit(_daily(spark, rows), WE)
    r = _z(a, "flat", "issue_spike")
    assert r["mad"] == 0 and r["z_score"] == pytest.approx((6 - 4) / 4 * 10)
    s = _z(a, "flat", "star_spike")  # all zeros: median 0 -> z 0 and low baseline gate
    assert s["z_score"] == 0.0 and s["status"] == "low_baseline"


def test_empty_recent_and_short_history(spark):
    rows = [("old", o, 5, 2.0, 9) for o in range(7, 35)] + [("new", o, 5, 2.0, 9) for o in range(0, 10)]
    a = detection_audit(_daily(spark, rows), WE)
    r = _z(a, "old", "issue_spike")
    assert r["n_recent"] == 0 and r["z_score"] == 0.0 and r["observed_value"] == 0.0
    n = _z(a, "new", "issue_spike")
    assert n["n_prior"] == 3 and n["status"] == "insufficient_history"


def test_null_metric_values_are_skipped(spark):
    rows = [("r", o, 3, (None if o % 2 else 5.0), 0) for o in range(0, 35)]
    a = detection_audit(_daily(spark, rows), WE)
    r = _z(a, "r", "pr_slowdown")
    assert r["n_prior"] == len([o for o in range(7, 35) if o % 2 == 0])


def test_backfill_matches_single_window(spark):
    rows = [("r%d" % (i % 3), o, (o * 7 + i) % 11, float((o * 3 + i) % 5), (o + i) % 13)
            for i in range(3) for o in range(0, 60)]
    d = _daily(spark, rows)
    ends = [WE - dt.timedelta(days=k) for k in (0, 5, 17)]
    bf = detect_backfill(d, min(ends), max(ends))
    for e in ends:
        one = detection_audit(d, e).filter("n_prior > 0 OR n_recent > 0")
        cols = ["repo_name", "anomaly_type", "n_prior", "n_recent", "baseline_value", "mad", "observed_value",
                "z_score", "status"]
        got = sorted(tuple(x) for x in bf.filter(F.col("window_end") == F.lit(e)).select(*cols).collect())
        want = sorted(tuple(x) for x in one.select(*cols).collect())
        assert got == want


def test_zero_fill_option(spark):
    # events on only 10 of the 35 days: without zero-fill the series is short
    rows = [("r", o, 4, None, 7) for o in range(7, 35, 3)] + [("r", o, 9, None, 7) for o in (0, 2)]
    d = _daily(spark, rows)
    a = _z(detection_audit(d, WE), "r", "issue_spike")
    z = _z(detection_audit(d, WE, zero_fill=True), "r", "issue_spike")
    assert a["n_prior"] == 10 and z["n_prior"] == 28 and z["n_recent"] == 7
    assert z["baseline_value"] == 0.0                 # most days now count 0 issues
    p = _z(detection_audit(d, WE, zero_fill=True), "r", "pr_slowdown")
    assert p["n_prior"] == 0                          # the median time is not filled
    bf = detect_backfill(d, WE, WE, zero_fill=True).filter(F.col("anomaly_type") == "issue_spike").first()
    assert bf["n_prior"] == 28 and bf["baseline_value"] == z["baseline_value"]


def test_merged_only_option(spark):
    from vitals.operators.metrics import pr_cycles
    import json
    ev = [("1", "PullRequestEvent", "o/r", "2024-01-01 00:00:00", {"action": "opened", "number": 5}),
          ("2", "PullRequestEvent", "o/r", "2024-01-01 10:00:00",
           {"action": "closed", "number": 5, "pull_request": {"merged": False}}),
          ("3", "PullRequestEvent", "o/r", "2024-01-01 04:00:00", {"action": "closed", "number": 5})]
    df = spark.createDataFrame([(i, t, r, None, ts, json.dumps(p)) for i, t, r, ts, p in ev],
                               "id string, type string, repo_name string, actor_login string, created_at string, "
                               "payload string").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    assert pr_cycles(df).first()["median_hours"] == pytest.approx(7.0)
    assert pr_cycles(df, merged_only=True).first()["median_hours"] == pytest.approx(4.0)
