"""Scoring reports against golden cases, for all cases in one job.

Case -> anomaly is a natural-key join on (repo, type, window_start,
window_end) (duplicate keys fan in to the same anomaly); anomaly -> latest
report is a partial ``max_by`` over (created_at, id). Array membership
(expected URLs vs cited URLs) stays inside each row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import CONFIDENCES, LATENCY_THRESHOLD_S, MAX_TOOL_CALLS

NATURAL_KEY = ["repo_name", "anomaly_type", "window_start", "window_end"]


def _case_keys(cases: DataFrame) -> DataFrame:
    return cases.withColumnRenamed("repo", "repo_name")


def latest_report_any(reports: DataFrame) -> DataFrame:
    """Most recent report per anomaly, whatever its confidence."""
    from .reports import last_per_key
    return last_per_key(reports, "anomaly_id", ["created_at", "id"])


def resolve_cases(cases: DataFrame, anomalies: DataFrame, reports: DataFrame) -> DataFrame:
    """Cases with the id of their anomaly (NULL if none) and latest report."""
    a = anomalies.select(*NATURAL_KEY, F.col("id").alias("anomaly_id"))
    c = _case_keys(cases).join(a, NATURAL_KEY, "left")
    r = latest_report_any(reports).select(
        "anomaly_id", F.col("id").alias("report_id"), "confidence", "citations",
        "tool_calls_used", "duration_seconds", "summary")
    return c.join(r, "anomaly_id", "left")


def coverage_expr(expected, cited_urls):
    """hits / len(expected) rounded to 2 dp; NULL when nothing is expected.
    Expected URLs count with multiplicity."""
    hits = F.size(F.filter(expected, lambda x: F.array_contains(cited_urls, x)))
    return F.when(F.size(F.coalesce(expected, F.array())) == 0, F.lit(None).cast("double")) \
        .otherwise(F.round(hits / F.size(expected), 2))


def citation_coverage(cases: DataFrame, anomalies: DataFrame, reports: DataFrame) -> DataFrame:
    """Coverage of expected evidence URLs by the latest report's citations."""
    r = resolve_cases(cases, anomalies, reports).filter(F.col("report_id").isNotNull())
    cited = F.array_distinct(F.transform(F.coalesce("citations", F.array()), lambda c: c["source_url"]))
    return r.select(F.col("id").alias("case_id"), "anomaly_id", "report_id",
                    coverage_expr(F.col("expected_evidence_urls"), cited).alias("citation_coverage"))


def eval_scores(cases: DataFrame, anomalies: DataFrame, reports: DataFrame,
                max_tool_calls: int = MAX_TOOL_CALLS, latency_s: float = LATENCY_THRESHOLD_S) -> DataFrame:
    """One scored row per case that resolves to an anomaly; an anomaly
    without a report scores as a failed run (all checks false)."""
    r = resolve_cases(cases, anomalies, reports).filter(F.col("anomaly_id").isNotNull())
    ok = F.col("report_id").isNotNull()
    cited = F.array_distinct(F.transform(F.coalesce("citations", F.array()), lambda c: c["source_url"]))
    accepted = F.coalesce(F.col("expected_confidences"), F.array(*[F.lit(c) for c in CONFIDENCES]))
    return r.select(
        F.col("id").alias("case_id"), F.col("repo_name").alias("repo"), "anomaly_type",
        F.when(ok, coverage_expr(F.col("expected_evidence_urls"), cited)).alias("citation_coverage"),
        (ok & (F.size(F.coalesce("citations", F.array())) > 0)).alias("has_citations"),
        (ok & (F.col("tool_calls_used") <= max_tool_calls)).alias("budget_ok"),
        (ok & (F.col("duration_seconds") <= latency_s)).alias("latency_ok"),
        (ok & F.coalesce(F.array_contains(accepted, F.col("confidence")), F.lit(False))).alias("confidence_match"),
        F.when(ok, F.col("confidence")).otherwise(F.lit("error")).alias("confidence"),
        F.when(ok, F.col("tool_calls_used")).otherwise(F.lit(0)).alias("tool_calls"),
        F.when(ok, F.round("duration_seconds", 1)).alias("latency_s"),
        F.when(ok, F.left("summary", F.lit(120))).otherwise(F.lit("ERROR: no report")).alias("summary"))


def eval_summary(scores: DataFrame) -> DataFrame:
    """Scorecard: cases, mean coverage of scored cases, pass counts, mean latency."""
    return scores.agg(
        F.count("*").alias("n_cases"),
        F.round(F.avg("citation_coverage"), 4).alias("avg_citation_coverage"),
        F.count_if("budget_ok").alias("budget_ok"),
        F.count_if("latency_ok").alias("latency_ok"),
        F.count_if("confidence_match").alias("confidence_match"),
        F.round(F.avg("latency_s"), 4).alias("avg_latency_s"))


def ensure_anomalies(cases: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Anomaly table after inserting a row for every case whose natural key
    is missing (values from the case); duplicate case keys insert once."""
    c = _case_keys(cases)
    missing = (c.join(anomalies.select(*NATURAL_KEY), NATURAL_KEY, "left_anti")
               .groupBy(*NATURAL_KEY)
               .agg(F.min_by(F.struct("metric_name", "baseline_value", "observed_value", "z_score"),
                             F.col("id")).alias("v"))
               .select(*NATURAL_KEY, "v.*", F.lit(True).alias("inserted")))
    existing = anomalies.select(*NATURAL_KEY, "metric_name", "baseline_value", "observed_value", "z_score",
                                F.lit(False).alias("inserted"))
    return existing.unionByName(missing)


def write_scores(scores: DataFrame, path: str) -> None:
    """Eval-result sink (A14): scored rows as JSON lines."""
    scores.orderBy("case_id").write.mode("overwrite").json(path)
