"""Stored report text, latest rows and artifact numbering."""

import json

from pyspark.sql import functions as F

from vitals.operators.reports import last_per_key, parse_reports, report_contract
from vitals.sources.bindings import artifact_key, bound_events, document_artifacts


def test_parse_reports_defines_missing_and_broken_text(spark):
    whole = {"summary": "s", "root_cause": "r", "confidence": "low", "evidence": ["a", "b"],
             "citations": [{"citation_type": "sql_result", "source_url": "SQL: q", "excerpt": "e"}], "limitations": "l"}
    part = {"summary": "s", "confidence": "high", "evidence": None}
    df = spark.createDataFrame([(1, 7, json.dumps(whole)), (2, 7, json.dumps(part)), (3, 8, "no report"), (4, 8, None), (5, 9, "")],
                               "id long, anomaly_id long, raw_output string")
    got = {r["id"]: r for r in parse_reports(df).collect()}
    assert got[1]["evidence"] == ["a", "b"] and got[1]["citations"][0]["source_url"] == "SQL: q"
    assert got[2]["confidence"] == "high" and got[2]["evidence"] == [] and got[2]["citations"] == []
    for i in (3, 4, 5):
        assert got[i]["summary"] is None and got[i]["evidence"] == [] and got[i]["citations"] == []
    valid = {r["id"]: r["valid"] for r in report_contract(parse_reports(df)).collect()}
    assert valid == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_last_per_key(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, None, "x"), (2, 1, "y"), (None, 9, "z")],
                               "k int, o int, v string")
    assert sorted((r["k"], r["v"]) for r in last_per_key(df, "k", ["o"]).collect()) == [(1, "c"), (2, "y")]
    plan = last_per_key(df, "k", ["o"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "SortAggregate" not in plan


def test_artifact_numbers_grow_and_meet_their_documents(spark):
    ids = [0, 9_999, 10_000, 25_003]
    ev = spark.createDataFrame([(i, 13, "signup", '{"k": 42}') for i in ids],
                               "event_id long, user_id long, event_type string, props string") \
        .withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    keys = bound_events(ev).select("repo_name", F.get_json_object("payload", "$.number").cast("int").alias("n")) \
        .select(artifact_key(F.col("repo_name"), F.col("n")).alias("key")).distinct()
    assert sorted(r["key"] for r in keys.collect()) == [342, 1342, 2342]
    docs = spark.createDataFrame([(342, "t"), (2342, "u")], "doc_id long, text string")
    back = document_artifacts(docs).select("artifact_id", artifact_key(F.col("repo_name"), F.col("number")).alias("key"))
    assert all(r["artifact_id"] == r["key"] for r in back.collect())
