"""Late and repeated deliveries."""

import json

from vitals.operators.metrics import daily_metrics
from vitals.streaming.streams import EVENT_TABLE, daily_metrics_stream, dedup_stream, window_counts, window_counts_stream


def _line(i, day, kind="WatchEvent", hour=1, payload=None):
    return json.dumps({"id": i, "type": kind, "created_at": f"2024-01-{day:02d}T{hour:02d}:00:00.000000",
                       "repo": {"name": "o/r"}, "actor": {"login": "a"}, "payload": payload or {}})


def _pr(i, day, hour, action, number):
    return _line(i, day, "PullRequestEvent", hour, {"action": action, "number": number})


def test_one_id_on_two_days_is_stored_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text(_line("1", 5) + "\n" + _line("2", 9))
    args = (spark, f"{src}/*.json", str(tmp_path / "out"), str(tmp_path / "ckpt"))
    dedup_stream(*args)
    (src / "b.json").write_text(_line("1", 6) + "\n" + _line("3", 1))
    dedup_stream(*args)
    rows = spark.read.schema(EVENT_TABLE).parquet(str(tmp_path / "out")).collect()
    assert sorted((r["id"], r["created_at"].day) for r in rows) == [("1", 5), ("2", 9), ("3", 1)]


def test_new_late_days_are_counted(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text(_line("1", 20) + "\n" + _line("2", 3))
    args = (spark, f"{src}/*.json", str(tmp_path / "out"), str(tmp_path / "ckpt"))
    window_counts_stream(*args)
    (src / "b.json").write_text(_line("3", 3) + "\n" + _line("4", 1, "ForkEvent"))
    window_counts_stream(*args)
    got = {r["date"].day: (r["star_count"], r["fork_count"]) for r in window_counts(spark, str(tmp_path / "out")).collect()}
    assert got == {20: (1, 0), 3: (2, 0), 1: (0, 1)}


def test_a_day_delivered_again_counts_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    day = "\n".join(_line(str(i), 10) for i in range(7))
    (src / "a.json").write_text(day)
    args = (spark, f"{src}/*.json", str(tmp_path / "out"), str(tmp_path / "ckpt"))
    window_counts_stream(*args)
    (src / "b.json").write_text(day + "\n" + _line("late", 2))
    window_counts_stream(*args)
    got = {r["date"].day: r["star_count"] for r in window_counts(spark, str(tmp_path / "out")).collect()}
    assert got == {10: 7, 2: 1}


def _files(root):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in root.rglob("*.parquet")}


def test_late_epochs_touch_changed_days_only(spark, tmp_path):
    """The same late epoch over a short and a long history: same result, same days rewritten, and
    nothing of the stored events is read."""
    touched = {}
    for name, days in (("short", 4), ("long", 14)):
        root = tmp_path / name
        src = root / "in"
        src.mkdir(parents=True)
        lines = [_pr(f"o{d}", d, 2, "opened", d) for d in range(1, days)] + [_pr(f"c{d}", d + 1, 9, "closed", d) for d in range(1, days)]
        lines += [_line(f"w{d}", d) for d in range(1, days)]
        (src / "a.json").write_text("\n".join(lines))
        args = (spark, f"{src}/*.json", str(root / "ev"), str(root / "out"), str(root / "ckpt"))
        daily_metrics_stream(*args)
        before = {t: _files(root / t) for t in ("ev", "out", "ev-close-days")}
        # a late open of pull request 1 moves the median of its close day (2), a repeated close changes nothing
        (src / "b.json").write_text("\n".join([_pr("late", 1, 20, "opened", 1), _pr("c2", 3, 9, "closed", 2)]))
        daily_metrics_stream(*args)
        after = {t: _files(root / t) for t in before}
        gone = {t: sorted({f.split("/")[0] for f in before[t] if f not in after[t]}) for t in before}
        new = {t: sorted({f.split("/")[0] for f in after[t] if f not in before[t]}) for t in before}
        touched[name] = gone, new
        events = spark.read.schema(EVENT_TABLE).parquet(str(root / "ev"))
        want = {tuple(r) for r in daily_metrics(events.drop("event_date")).collect()}
        cols = daily_metrics(events).columns
        assert {tuple(r) for r in spark.read.parquet(str(root / "out")).select(*cols).collect()} == want
        assert {r[0] for r in events.select("id").collect()} >= {"late", "o1"} and events.count() == len(lines) + 1
    assert touched["short"] == touched["long"]
    gone, new = touched["long"]
    assert gone == {"ev": [], "out": ["date=2024-01-01", "date=2024-01-02"], "ev-close-days": ["close_date=2024-01-02"]}
    assert new["ev"] == ["event_date=2024-01-01"]


def test_observed_zero_has_a_label(spark):
    from vitals.operators.reports import feed_cards
    row = [(1, "o/r", "star_spike", "star_count", 4.0, 0.0, -3.0), (2, "o/r", "star_spike", "star_count", 8.0, 2.0, -3.0)]
    feed = spark.createDataFrame(row, "id long, repo string, anomaly_type string, metric_name string, baseline double, "
                                      "observed double, z_score double")
    got = {r["id"]: r["change_label"] for r in feed_cards(feed).collect()}
    assert got[1] == "100% below normal" and got[2].startswith("4")
