"""Fixed schemas of the engine's tables (no inference anywhere).

``payload`` stays a JSON text column: its two generations differ and only a
few paths are read (see ``functions.json_paths``).
"""

from __future__ import annotations

from pyspark.sql import types as T

# Raw hourly event line, as landed in the JSON-lines files.
RAW_EVENT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("repo", T.StructType([T.StructField("name", T.StringType())])),
    T.StructField("actor", T.StructType([T.StructField("login", T.StringType())])),
    # An object in the file; read as its JSON text.
    T.StructField("payload", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])

# Normalised event table (primary key ``id``).
EVENT = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("repo_name", T.StringType(), False),
    T.StructField("actor_login", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType(), False),
    T.StructField("payload", T.StringType()),
])

DAILY_METRICS = T.StructType([
    T.StructField("repo_name", T.StringType(), False),
    T.StructField("date", T.DateType(), False),
    T.StructField("star_count", T.LongType()),
    T.StructField("fork_count", T.LongType()),
    T.StructField("issue_opened", T.LongType()),
    T.StructField("issue_closed", T.LongType()),
    T.StructField("pr_opened", T.LongType()),
    T.StructField("pr_merged", T.LongType()),
    T.StructField("pr_median_merge_hours", T.DoubleType()),
    T.StructField("commit_count", T.LongType()),
])

CITATION = T.StructType([
    T.StructField("citation_type", T.StringType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("excerpt", T.StringType()),
])

REPORT = T.StructType([
    T.StructField("summary", T.StringType()),
    T.StructField("root_cause", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("evidence", T.ArrayType(T.StringType())),
    T.StructField("citations", T.ArrayType(CITATION)),
    T.StructField("limitations", T.StringType()),
])

GOLDEN_CASE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("repo", T.StringType()),
    T.StructField("anomaly_type", T.StringType()),
    T.StructField("metric_name", T.StringType()),
    T.StructField("window_start", T.DateType()),
    T.StructField("window_end", T.DateType()),
    T.StructField("expected_evidence_urls", T.ArrayType(T.StringType())),
    T.StructField("accepted_explanation", T.StringType()),
    T.StructField("expected_confidences", T.ArrayType(T.StringType())),
    T.StructField("z_score", T.DoubleType()),
    T.StructField("baseline_value", T.DoubleType()),
    T.StructField("observed_value", T.DoubleType()),
    T.StructField("limitation_notes", T.StringType()),
])

# Fixed values of the detector: (anomaly_type, metric column, minimum baseline).
ANOMALY_CHECKS = [
    ("issue_spike", "issue_opened", 2.0),
    ("pr_slowdown", "pr_median_merge_hours", 1.0),
    ("star_spike", "star_count", 5.0),
]
DEFAULT_Z_THRESHOLD = 3.5
RECENT_DAYS = 7
PRIOR_DAYS = 28
MIN_PRIOR_DAYS = 7

# Fixed enumerations of the report contract.
CONFIDENCES = ["high", "medium", "low"]
CITATION_TYPES = ["sql_result", "artifact_chunk", "release_note"]
ANOMALY_TYPES = ["issue_spike", "pr_slowdown", "star_spike"]
ANOMALY_STATUSES = ["pending", "investigating", "done"]

# Evaluation thresholds.
MAX_TOOL_CALLS = 8
LATENCY_THRESHOLD_S = 90.0

# Chunking and retrieval parameters.
CHUNK_SIZE = 2000
CHUNK_OVERLAP = 200
RRF_K = 60
