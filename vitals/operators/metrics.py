"""Daily roll-up of events per repository (one row per repo and UTC day).

Plan shape: one scan of the events, JSON paths read once per row, then a single
partial+final ``HashAggregate`` keyed by (repo_name, date) for the seven counts.
PR cycle times come from the sorted opens and closes of each pull request, by
rank counting (``cycles``): no open x close pairs, and a busy repository is
spread over its pull requests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import json_paths as J
from ..functions.time import filter_days
from .cycles import close_days, cycle_medians

METRIC_COLUMNS = ["star_count", "fork_count", "issue_opened", "issue_closed",
                  "pr_opened", "pr_merged", "pr_median_merge_hours", "commit_count"]


def _typed(events: DataFrame) -> DataFrame:
    return events.select(
        "repo_name", "type", "created_at",
        J.action().alias("action"),
        J.merged_or_true().alias("merged"),
    )


def daily_counts(events: DataFrame, start=None, end=None) -> DataFrame:
    """Seven conditional counts per (repo_name, date) in one aggregate."""
    e = events if start is None else filter_days(events, start, end)
    e = _typed(e)
    t, a = F.col("type"), F.col("action")
    pr = t == "PullRequestEvent"
    return (e.groupBy("repo_name", F.to_date("created_at").alias("date"))
            .agg(F.count_if(t == "WatchEvent").alias("star_count"),
                 F.count_if(t == "ForkEvent").alias("fork_count"),
                 F.count_if((t == "IssuesEvent") & (a == "opened")).alias("issue_opened"),
                 F.count_if((t == "IssuesEvent") & (a == "closed")).alias("issue_closed"),
                 F.count_if(pr & (a == "opened")).alias("pr_opened"),
                 F.count_if(pr & (a == "closed") & F.col("merged")).alias("pr_merged"),
                 F.count_if(t == "PushEvent").alias("commit_count")))


def pr_close_days(events: DataFrame, start=None, end=None, merged_only: bool = False) -> DataFrame:
    """One row per pull request and close day with its sorted opens and closes.

    Only the close side is date-filtered (lookback is unbounded). By default every
    close counts (the metric is open->close); with ``merged_only`` a close
    needs the merged flag (absent flag = merged).
    """
    def typed(df):
        return df.select("repo_name", F.col("created_at").alias("ts"), J.action().alias("action"),
                         J.pr_number().alias("number"), J.merged_or_true().alias("merged"))
    prs = events.filter(F.col("type") == "PullRequestEvent")
    closes = typed(filter_days(prs, start, end) if start is not None else prs).filter(F.col("action") == "closed")
    if merged_only:
        closes = closes.filter(F.col("merged"))
    return close_days(typed(prs).filter(F.col("action") == "opened"), closes)


def pr_cycles(events: DataFrame, start=None, end=None, merged_only: bool = False,
              resolution_bits: int = 0) -> DataFrame:
    """Median open->close hours per (repo_name, close_date) over every (close, earlier open) pair.

    Same as PERCENTILE_CONT(0.5) over the pairs; ``resolution_bits`` trades
    exactness for fewer rounds (see ``cycle_medians``).
    """
    return cycle_medians(pr_close_days(events, start, end, merged_only), resolution_bits)


def daily_metrics(events: DataFrame, start=None, end=None, merged_only: bool = False) -> DataFrame:
    """``repo_metrics_daily``: counts LEFT JOIN cycle medians on (repo, day)."""
    d = daily_counts(events, start, end)
    c = pr_cycles(events, start, end, merged_only=merged_only).select(
        "repo_name", F.col("close_date").alias("date"),
        F.col("median_hours").alias("pr_median_merge_hours"))
    return d.join(c, ["repo_name", "date"], "left").select("repo_name", "date", *METRIC_COLUMNS)


def event_date_range(events: DataFrame) -> DataFrame:
    """First and last event day per repository (D10): the range that a roll-up
    without given dates covers."""
    day = F.to_date("created_at")
    return events.groupBy("repo_name").agg(F.min(day).alias("first_date"), F.max(day).alias("last_date"))
