"""PR artifacts around anomaly windows: slow PRs, releases, enrichment
candidates, assembled discussion text and the daily work queues.

Window (range) joins keep an equi key: each 7-day anomaly window is exploded
into its days and joined on (repo_name, day), so the join is a plain hash /
sort-merge equi-join spread over (repo, day) keys instead of a nested loop or
one partition per busy repository. Per-anomaly top-k is a ``row_number``
filter, which Spark plans as a ``WindowGroupLimit`` (partial top-k before the
shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import json_paths as J
from ..functions.text import strip
from ..functions.time import event_day, hours_between


def window_days(anomalies: DataFrame, id_col: str = "id") -> DataFrame:
    """(anomaly id, repo_name, window_start, window_end, day) for every day of each window."""
    return anomalies.select(
        F.col(id_col).alias("anomaly_id"), "repo_name", "window_start", "window_end",
        F.explode(F.sequence("window_start", "window_end")).alias("day"))


def top_k(df: DataFrame, part: list[str], order: list, k: int, rank_col: str = "rank") -> DataFrame:
    """First ``k`` rows per ``part`` by ``order`` with a 1-based bigint rank.

    The filter sits directly on ``row_number`` so Spark inserts a partial
    ``WindowGroupLimit`` before the shuffle.
    """
    w = Window.partitionBy(*part).orderBy(*order)
    return (df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)
            .withColumn(rank_col, F.col(rank_col).cast("long")))


def slow_prs(anomalies: DataFrame, artifacts: DataFrame, k: int = 10, keep: tuple[str, ...] = ()) -> DataFrame:
    """Slowest PRs closed inside each anomaly window (F1), hours DESC NULLS LAST,
    with the columns ``keep`` (``artifact_id``, ``repo_name``) besides."""
    days = window_days(anomalies)
    a = artifacts.filter((F.col("type") == "pull_request") & F.col("closed_at").isNotNull()).select(
        "artifact_id", "repo_name", "number", F.left("title", F.lit(80)).alias("title"),
        F.round(hours_between(F.col("created_at"), F.col("closed_at"))).alias("hours_open"),
        F.to_date("created_at").alias("opened"), F.to_date("closed_at").alias("closed"), "url")
    j = days.join(a, (days["repo_name"] == a["repo_name"]) & (days["day"] == a["closed"])) \
        .drop(a["repo_name"])
    return top_k(j, ["anomaly_id"], [F.col("hours_open").desc_nulls_last(), F.col("number").asc()], k) \
        .select("anomaly_id", "rank", "number", "title", "hours_open", "opened", "closed", "url", *keep)


def releases(events: DataFrame) -> DataFrame:
    """Release events with tag, name and notes (first 300 characters)."""
    return events.filter(F.col("type") == "ReleaseEvent").select(
        "repo_name", "created_at", event_day(events).alias("release_date"),
        J.release_tag().alias("tag"), J.release_name().alias("release_name"),
        F.left(J.release_body(), F.lit(300)).alias("notes"))


def release_lookup(anomalies: DataFrame, events: DataFrame, k: int = 10) -> DataFrame:
    """Releases of the anomaly's repository since its window start, newest first.

    The newest ``k`` releases on/after a date are always among the
    repository's newest ``k`` overall (same order), so the per-repository
    top-k is taken first and only those rows meet the anomalies: the join
    is bounded by anomalies x k instead of anomalies x releases. Days before the
    earliest window start are not read.
    """
    order = [F.col("created_at").desc(), F.col("tag").asc()]
    since = anomalies.agg(F.min("window_start")).first()[0]
    newest = top_k(releases(events.where(event_day(events) >= F.lit(since))), ["repo_name"], order, k).drop("rank")
    a = anomalies.select(F.col("id").alias("anomaly_id"), "repo_name", "window_start")
    j = a.join(newest, "repo_name").filter(F.col("release_date") >= F.col("window_start"))
    return top_k(j, ["anomaly_id"], order, k) \
        .select("anomaly_id", "rank", "release_date", "tag", "release_name", "notes")


def enrichment_candidates(anomalies: DataFrame, events: DataFrame, artifacts: DataFrame,
                          k: int = 30) -> DataFrame:
    """PR numbers to fetch for each distinct anomaly window (D11, G1, F2):
    PRs with events in the window UNION PRs closed in the window, largest
    numbers first, first ``k``."""
    win = anomalies.select("repo_name", "window_start", "window_end").distinct()
    wd = win.select("*", F.explode(F.sequence("window_start", "window_end")).alias("day"))
    from_events = (events.filter(F.col("type") == "PullRequestEvent")
                   .select("repo_name", event_day(events).alias("day"),
                           J.jtext("payload", "$.pull_request.number").try_cast("int").alias("number"))
                   .filter(F.col("number").isNotNull()).distinct())
    from_closed = artifacts.filter(F.col("closed_at").isNotNull()).select(
        "repo_name", F.to_date("closed_at").alias("day"), "number")
    keys = ["repo_name", "window_start", "window_end", "number"]
    c = (wd.join(from_events, ["repo_name", "day"]).select(*keys)
         .unionByName(wd.join(from_closed, ["repo_name", "day"]).select(*keys))
         .distinct())
    return top_k(c, ["repo_name", "window_start", "window_end"], [F.col("number").desc()], k)


def artifact_text(artifacts: DataFrame, comments: DataFrame) -> DataFrame:
    """Document text of each PR (H2): ``PR #n: title``, blank line, body or
    ``(no description)``, then ``Discussion comments`` with ``@author: text``
    in position order (blank comments skipped, missing author ``unknown``)."""
    c = (comments.groupBy("artifact_id")
         .agg(F.array_sort(F.collect_list(F.struct("position", "author_login", "body"))).alias("cs")))
    lines = F.transform(
        F.filter(F.col("cs"), lambda x: strip(F.coalesce(x["body"], F.lit(""))) != ""),
        lambda x: F.concat(F.lit("\n@"), F.coalesce(x["author_login"], F.lit("unknown")),
                           F.lit(": "), strip(x["body"])))
    discussion = F.when(F.size(F.coalesce(F.col("cs"), F.array())) > 0, F.concat(
        F.lit("\n\n---\nDiscussion comments:"),
        F.when(F.size(lines) > 0, F.concat(F.lit("\n"), F.array_join(lines, "\n"))).otherwise(F.lit(""))
    )).otherwise(F.lit(""))
    head = F.concat(F.lit("PR #"), F.col("number").cast("string"), F.lit(": "),
                    F.coalesce(F.col("title"), F.lit("None")), F.lit("\n\n"),
                    F.when(F.coalesce(F.col("body"), F.lit("")) == "", F.lit("(no description)"))
                    .otherwise(F.col("body")))
    return artifacts.join(c, "artifact_id", "left").select(
        "artifact_id", "repo_name", "number", F.concat(head, discussion).alias("text"))


def unembedded_artifacts(artifacts: DataFrame, chunks: DataFrame, k: int = 100) -> DataFrame:
    """Artifacts with no chunk yet, per repository by number DESC, first ``k``."""
    todo = artifacts.join(chunks.select("artifact_id").distinct(), "artifact_id", "left_anti")
    return top_k(todo.select("artifact_id", "repo_name", "number"), ["repo_name"],
                 [F.col("number").desc()], k)


def unenriched_windows(anomalies: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Distinct anomaly windows without any artifact *created* inside."""
    win = anomalies.select("repo_name", "window_start", "window_end").distinct()
    wd = win.select("*", F.explode(F.sequence("window_start", "window_end")).alias("day"))
    hit = (wd.join(artifacts.select("repo_name", F.to_date("created_at").alias("day")).distinct(),
                   ["repo_name", "day"], "left_semi")
           .select("repo_name", "window_start", "window_end"))
    return win.join(hit, ["repo_name", "window_start", "window_end"], "left_anti")


def investigation_queue(anomalies: DataFrame, reports: DataFrame, k: int = 5) -> DataFrame:
    """Anomalies without a report, highest z first, first ``k``."""
    todo = anomalies.join(reports.select(F.col("anomaly_id").alias("id")).distinct(), "id", "left_anti")
    # A global top-k: Spark plans this as TakeOrderedAndProject (per-task top-k,
    # then a merge of k rows per task) — no full sort or single-partition shuffle.
    return (todo.orderBy(F.col("z_score").desc(), F.col("id").asc()).limit(k)
            .select("id", "repo_name", "anomaly_type", "z_score"))
