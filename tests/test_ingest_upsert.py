"""Event-line scan edge cases, normaliser, and upsert properties."""

import json

from pyspark.sql import functions as F

from vitals.operators.ingest import normalize_events, payload_fields
from vitals.operators.upsert import upsert_ignore, upsert_partial, upsert_replace
from vitals.sources.event_files import read_event_lines


def test_scan_skips_bad_lines_and_normalises(spark, tmp_path):
    good = {"id": "1", "type": "PullRequestEvent", "created_at": "2024-01-02T03:04:05.000006",
            "repo": {"name": "o/r"}, "actor": {"login": "a"},
            "payload": {"action": "closed", "number": 7, "pull_request": {"merged": False, "title": "x\u0000y"}}}
    no_actor = {"id": "2", "type": "WatchEvent", "created_at": "2024-01-02T05:00:00.000000", "repo": {"name": "o/r"}}
    new_fmt = {"id": "3", "type": "PullRequestEvent", "created_at": "2024-01-03T00:00:00.000000",
               "repo": {"name": "o/r"}, "payload": {"action": "closed", "pull_request": {"number": 8}}}
    lines = [json.dumps(good), "{not json", "", json.dumps(no_actor), json.dumps(new_fmt)]
    p = tmp_path / "2024-01-02-3.json"
    p.write_text("\n".join(lines) + "\n")
    ev = normalize_events(read_event_lines(spark, str(p)))
    rows = {r["id"]: r for r in ev.collect()}
    assert set(rows) == {"1", "2", "3"}
    assert rows["2"]["actor_login"] is None and rows["2"]["payload"] == "{}"
    assert "\\u0000" not in rows["1"]["payload"]
    f = {r["id"]: r for r in payload_fields(ev).collect()}
    assert f["1"]["number"] == 7 and f["1"]["merged"] is False
    assert f["3"]["number"] == 8 and f["3"]["merged"] is None


def test_upserts(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, ver long")
    b = spark.createDataFrame([(2, "B", 2), (3, "c", 2), (3, "c2", 3)], "k long, v string, ver long")
    ign = {r["k"]: r["v"] for r in upsert_ignore(t, b, ["k"], ["ver"]).collect()}
    assert ign == {1: "a", 2: "b", 3: "c"}
    again = upsert_ignore(upsert_ignore(t, b, ["k"], ["ver"]), b, ["k"], ["ver"])
    assert again.count() == 3                              # re-running is a no-op
    rep = {r["k"]: r["v"] for r in upsert_replace(t, b, ["k"], ["ver"]).collect()}
    assert rep == {1: "a", 2: "B", 3: "c"}


def test_partial_upsert_keeps_first_values(spark):
    v = spark.createDataFrame(
        [(1, "t1", "b1", "open", 1), (1, "t2", "b2", "closed", 2), (2, None, "x", "open", 1),
         (2, "late title", "y", "open", 5)],
        "k long, title string, body string, state string, fetched long")
    out = {r["k"]: r for r in upsert_partial(v, ["k"], "fetched", ["body", "state"]).collect()}
    assert (out[1]["title"], out[1]["body"], out[1]["state"], out[1]["fetched"]) == ("t1", "b2", "closed", 2)
    assert out[2]["title"] is None and out[2]["body"] == "y"


def test_golden_cases_and_scores_sink(spark, tmp_path):
    from vitals.operators.evaluate import write_scores
    from vitals.sources.event_files import read_golden_cases
    cases = [{"id": "c1", "repo": "o/r", "anomaly_type": "pr_slowdown", "metric_name": "pr_median_merge_hours",
              "window_start": "2024-03-04", "window_end": "2024-03-10",
              "expected_evidence_urls": ["https://github.com/o/r/pull/1"], "accepted_explanation": "x",
              "expected_confidences": ["high"], "z_score": 3.5, "baseline_value": 10.0,
              "observed_value": 31.0, "limitation_notes": "n"},
             {"id": "c2", "repo": "o/r", "anomaly_type": "star_spike", "metric_name": "star_count",
              "window_start": "2024-02-12", "window_end": "2024-02-18", "expected_evidence_urls": [],
              "accepted_explanation": "y", "expected_confidences": ["low", "medium"], "z_score": 6.25,
              "baseline_value": 8.0, "observed_value": 58.0, "limitation_notes": ""}]
    p = tmp_path / "golden.json"
    p.write_text(json.dumps(cases, indent=2))
    df = read_golden_cases(spark, str(p))
    rows = {r["id"]: r for r in df.collect()}
    assert set(rows) == {"c1", "c2"} and str(rows["c1"]["window_end"]) == "2024-03-10"
    assert rows["c2"]["expected_evidence_urls"] == []
    out = tmp_path / "scores"
    write_scores(df.select(F.col("id").alias("case_id"), "z_score"), str(out))
    assert spark.read.json(str(out)).count() == 2


def test_reingest_is_insert_if_absent(spark, tmp_path):
    from vitals.operators.ingest import reingest
    e = {"id": "9", "type": "PushEvent", "created_at": "2024-01-05T00:00:00.000000", "repo": {"name": "o/r"},
         "actor": {"login": "new"}, "payload": {}}
    old = dict(e, actor={"login": "old"})
    fresh = dict(e, id="10")
    p = tmp_path / "f.jsonl"
    p.write_text("\n".join([json.dumps(e), "", "garbage", json.dumps(fresh)]) + "\n")
    target = normalize_events(spark.createDataFrame([json.dumps(old)], "string").select(
        F.from_json("value", "id string, type string, created_at timestamp_ntz, repo struct<name:string>, "
                             "actor struct<login:string>, payload string").alias("r")).select("r.*"))
    out = {r["id"]: r["actor_login"] for r in reingest(spark, str(p), target).collect()}
    assert out == {"9": "old", "10": "new"}
    assert reingest(spark, str(p), reingest(spark, str(p), target)).count() == 2


def test_feed_and_detail_sinks(spark, tmp_path):
    from vitals.plans.queries import REGISTRY
    from vitals.operators.reports import (flatten_citations, latest_reports, read_details, report_detail, write_details,
                                          write_feed)
    from vitals.sources import bindings as B
    sf = "/root/testdata/sf0.01"
    feed = REGISTRY["report_feed"][0](spark, sf)
    write_feed(feed, str(tmp_path / "feed"))
    back = spark.read.json(str(tmp_path / "feed"))
    assert back.count() == feed.count()
    reps = B.load(spark, sf, "reports")
    det = report_detail(latest_reports(reps, B.load(spark, sf, "anomalies")), flatten_citations(reps))
    write_details(det, str(tmp_path / "detail"))
    want = sorted(r["id"] for r in det.select("id").collect())
    assert sorted(r["id"] for r in read_details(spark, str(tmp_path / "detail"), det.schema).collect()) == want
    one = read_details(spark, str(tmp_path / "detail"), det.schema, [want[0]]).collect()
    assert [r["id"] for r in one] == want[:1] and len(one[0]["citations"]) == det.where(F.col("id") == want[0]).first()["citations"].__len__()


def test_integrity_rules_in_one_pass(spark):
    from vitals.operators import integrity as I
    rules = [*I.not_null("child", "a"), *I.check("child", "kinds", "kind", ["x", "y"]), *I.unique("child", "pair", "a", "kind"),
             *I.foreign("child", "parent", "a", "parent", "id"), *I.unique("parent", "id", "id")]
    child = spark.createDataFrame([(1, "x"), (1, "x"), (2, "z"), (3, None), (None, "y"), (None, "y"), (9, "x")], "a long, kind string")
    parent = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id long")
    got = {(r["table_name"], r["rule"]): r["violations"] for r in I.constraint_violations({"child": child, "parent": parent}, rules).collect()}
    assert got == {("child", "not_null_a"): 2, ("child", "kinds"): 1, ("child", "pair"): 1, ("child", "parent"): 2, ("parent", "id"): 1}
    empty = I.constraint_violations({"child": child.limit(0), "parent": parent.limit(0)}, rules)
    assert [r["violations"] for r in empty.collect()] == [0] * 5


def test_upserts_plan_without_sorted_aggregates(spark):
    from vitals.operators.upsert import first_per_key
    df = spark.createDataFrame([(1, "a", 1, "w")], "k long, v string, ver long, wide string").repartition(3)
    for plan in (first_per_key(df, ["k"], ["ver"]), upsert_partial(df, ["k"], "ver", ["v"])):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in text and text.count("Exchange hashpartitioning") == 1
