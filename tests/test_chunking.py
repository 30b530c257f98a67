"""Sliding chunks: counts for boundary lengths and reassembly of the text."""

import pytest
from pyspark.sql import functions as F

from vitals.operators.retrieval import chunk_artifacts


def _chunks(spark, texts):
    rows = [(i, "org/r", "pull_request", i, "t", t, "u") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "artifact_id long, repo_name string, type string, number long, "
                                     "title string, body string, url string")
    return chunk_artifacts(df)


@pytest.mark.parametrize("n,expected", [(0, 0), (1, 1), (2000, 1), (2001, 2), (3800, 2), (3801, 3), (5600, 3),
                                        (5601, 4)])
def test_chunk_counts(spark, n, expected):
    text = "".join(chr(97 + i % 26) for i in range(n))
    assert _chunks(spark, [text]).count() == expected


def test_reassembles_and_header(spark):
    text = "".join(chr(65 + (i * 7) % 50) for i in range(7777))
    rows = _chunks(spark, ["  \n" + text + "\n "]).orderBy("chunk_index").collect()
    header = "[PULL_REQUEST #0] t\n\n"
    parts = [r["text"] for r in rows]
    assert all(p.startswith(header) for p in parts)
    body = [p[len(header):] for p in parts]
    rebuilt = body[0] + "".join(b[200:] for b in body[1:])
    assert rebuilt == text
    assert all(len(b) == 2000 for b in body[:-1])


def test_blank_body_has_no_chunk(spark):
    assert _chunks(spark, ["   \n\t ", None]).count() == 0
