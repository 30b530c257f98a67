"""Robust anomaly detection: mean of the last 7 daily values against the
median / MAD of the prior 28, for every repository x check at once.

* The repo x check product is an ``explode`` of the fixed three-entry check
  list per daily row (a generator, no join).
* The MAD needs the group's own median first; that median is a window
  aggregate over the (repo, check[, window_end]) partition, so the following
  group-by reuses the same hash partitioning: one shuffle in total.
* ``detect_backfill`` scores every window end in one job: a range frame gathers the
  values of the 35 days up to each day, and median and MAD come from that
  array, so a row of the roll-up is shuffled once and not copied to the window ends it
  belongs to. Arrays hold at most 35 values, so skew cannot build up here.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import ANOMALY_CHECKS, DEFAULT_Z_THRESHOLD, MIN_PRIOR_DAYS, PRIOR_DAYS, RECENT_DAYS

SPAN = PRIOR_DAYS + RECENT_DAYS  # 35 days


def metric_long(daily: DataFrame, checks=ANOMALY_CHECKS) -> DataFrame:
    """Unpivot the checked metrics: (repo_name, date, anomaly_type,
    metric_name, min_baseline, value); NULL values are dropped."""
    items = F.array(*[
        F.struct(F.lit(t).alias("anomaly_type"), F.lit(m).alias("metric_name"),
                 F.lit(float(mb)).alias("min_baseline"),
                 F.col(m).cast("double").alias("value"))
        for t, m, mb in checks])
    return (daily.select("repo_name", "date", F.explode(items).alias("c"))
            .select("repo_name", "date", "c.*")
            .filter(F.col("value").isNotNull()))


def robust_z(n_prior: Column, n_recent: Column, median: Column, mad: Column,
             observed: Column) -> Column:
    """0.6745 (obs - median) / MAD; MAD = 0 -> (obs - median) / median * 10;
    median = 0 there, or an empty side -> 0."""
    return (F.when((n_prior == 0) | (n_recent == 0), F.lit(0.0))
            .when(mad == 0, F.when(median == 0, F.lit(0.0))
                  .otherwise((observed - median) / median * 10.0))
            .otherwise(F.lit(0.6745) * (observed - median) / mad))


def _median(values: Column) -> Column:
    """Median of an array of doubles; null for an empty one."""
    s = F.array_sort(values)
    n = F.size(s)
    low = F.get(s, F.floor((n - 1) / 2).cast("int"))
    return F.when(n > 0, (low + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def _verdict(g: DataFrame, keys: list[str], z_threshold: float) -> DataFrame:
    """z and status of keys + min_baseline, n_prior, n_recent, baseline_value, mad and _obs."""
    observed = F.coalesce(F.col("_obs"), F.lit(0.0))
    z = robust_z(F.col("n_prior"), F.col("n_recent"), F.col("baseline_value"), F.col("mad"), observed)
    status = (F.when(F.col("n_prior") < MIN_PRIOR_DAYS, "insufficient_history")
              .when(F.col("baseline_value") < F.col("min_baseline"), "low_baseline")
              .when(z >= F.lit(float(z_threshold)), "anomaly")
              .otherwise("normal"))
    return g.select(*keys, "min_baseline", "n_prior", "n_recent", "baseline_value", "mad",
                    observed.alias("observed_value"), z.alias("z_score"), status.alias("status"))


def _score(series: DataFrame, keys: list[str], z_threshold: float) -> DataFrame:
    """series: keys + min_baseline + value + is_prior (bool)."""
    w = Window.partitionBy(*keys)
    prior_v = F.when(F.col("is_prior"), F.col("value"))
    s = series.withColumn("_med", F.median(prior_v).over(w))
    g = s.groupBy(*keys).agg(
        F.first("min_baseline").alias("min_baseline"),
        F.count(prior_v).alias("n_prior"),
        F.count_if(~F.col("is_prior")).alias("n_recent"),
        F.first("_med", ignorenulls=True).alias("baseline_value"),
        F.median(F.abs(prior_v - F.col("_med"))).alias("mad"),
        F.avg(F.when(~F.col("is_prior"), F.col("value"))).alias("_obs"),
    )
    return _verdict(g, keys, z_threshold)


COUNT_METRICS = ["star_count", "fork_count", "issue_opened", "issue_closed", "pr_opened", "pr_merged",
                 "commit_count"]


def zero_filled(daily: DataFrame, first, last) -> DataFrame:
    """Daily metrics with a row for every repository and every day in
    [first, last]: missing days count 0 events (the median time stays NULL).
    The calendar is generated per repository (``explode(sequence)``), no join
    with a cross product."""
    f = _dt.date.fromisoformat(str(first))
    l = _dt.date.fromisoformat(str(last))
    cal = daily.select("repo_name").distinct().select(
        "repo_name", F.explode(F.sequence(F.lit(f), F.lit(l))).alias("date"))
    d = cal.join(daily.filter(F.col("date").between(F.lit(f), F.lit(l))), ["repo_name", "date"], "left")
    return d.select("repo_name", "date", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
                                           for c in COUNT_METRICS if c in daily.columns],
                    *[c for c in daily.columns if c not in COUNT_METRICS + ["repo_name", "date"]])


def metric_series(daily: DataFrame, window_end, checks=ANOMALY_CHECKS) -> DataFrame:
    """Non-NULL daily values of each repo x check in the 35 days up to
    ``window_end``, tagged prior (first 28) or recent (last 7)."""
    we = _dt.date.fromisoformat(str(window_end))
    lo = we - _dt.timedelta(days=SPAN - 1)
    split = we - _dt.timedelta(days=RECENT_DAYS)
    d = daily.filter(F.col("date").between(F.lit(lo), F.lit(we)))
    return (metric_long(d, checks)
            .withColumn("is_prior", F.col("date") <= F.lit(split))
            .withColumn("side", F.when(F.col("is_prior"), "prior").otherwise("recent")))


def detection_audit(daily: DataFrame, window_end, z_threshold: float = DEFAULT_Z_THRESHOLD,
                    checks=ANOMALY_CHECKS, repos: DataFrame | None = None,
                    zero_fill: bool = False) -> DataFrame:
    """One row per repository x check with counts, baseline, MAD, observed,
    z and a status (insufficient_history / low_baseline / anomaly / normal).

    ``repos`` (column repo_name) lists the watched repositories; by default
    every repository present in ``daily``. Repositories without values in
    the 35 days get a row with n_prior = 0.
    """
    we = _dt.date.fromisoformat(str(window_end))
    if zero_fill:
        daily = zero_filled(daily, we - _dt.timedelta(days=SPAN - 1), we)
    s = metric_series(daily, we, checks)
    scored = _score(s.select("repo_name", "anomaly_type", "metric_name", "min_baseline",
                             "value", "is_prior"),
                    ["repo_name", "anomaly_type", "metric_name"], z_threshold)
    repos = (repos if repos is not None else daily.select("repo_name")).distinct()
    check_rows = F.array(*[F.struct(F.lit(t).alias("anomaly_type"), F.lit(m).alias("metric_name"),
                                    F.lit(float(mb)).alias("min_baseline")) for t, m, mb in checks])
    grid = repos.select("repo_name", F.explode(check_rows).alias("c")).select("repo_name", "c.*")
    empty = _score_empty(grid, z_threshold)
    out = (empty.join(scored.select("repo_name", "anomaly_type", "metric_name"),
                      ["repo_name", "anomaly_type", "metric_name"], "left_anti")
           .unionByName(scored))
    return out.select(
        "repo_name", "anomaly_type", "metric_name",
        F.lit(we - _dt.timedelta(days=RECENT_DAYS - 1)).alias("window_start"),
        F.lit(we).alias("window_end"),
        "n_prior", "n_recent", "baseline_value", "mad", "observed_value", "z_score", "status")


def _score_empty(grid: DataFrame, z_threshold: float) -> DataFrame:
    return grid.select(
        "repo_name", "anomaly_type", "metric_name", "min_baseline",
        F.lit(0).cast("long").alias("n_prior"), F.lit(0).cast("long").alias("n_recent"),
        F.lit(None).cast("double").alias("baseline_value"), F.lit(None).cast("double").alias("mad"),
        F.lit(0.0).alias("observed_value"), F.lit(0.0).alias("z_score"),
        F.lit("insufficient_history").alias("status"))


def detect_anomalies(daily: DataFrame, window_end, z_threshold: float = DEFAULT_Z_THRESHOLD,
                     checks=ANOMALY_CHECKS) -> DataFrame:
    """Rows of the ``anomalies`` table: scored checks with z >= threshold."""
    a = detection_audit(daily, window_end, z_threshold, checks)
    return a.filter(F.col("status") == "anomaly").select(
        "repo_name", "anomaly_type", "window_start", "window_end", "metric_name",
        "baseline_value", "observed_value", "z_score")


def detect_backfill(daily: DataFrame, first_end, last_end,
                    z_threshold: float = DEFAULT_Z_THRESHOLD, checks=ANOMALY_CHECKS,
                    zero_fill: bool = False) -> DataFrame:
    """Score every window end in [first_end, last_end] in one job.

    Emits one row per (repo, check, window_end) that has at least one value
    in its 35-day span.
    """
    f = _dt.date.fromisoformat(str(first_end))
    l = _dt.date.fromisoformat(str(last_end))
    d = daily.filter(F.col("date").between(F.lit(f - _dt.timedelta(days=SPAN - 1)), F.lit(l)))
    if zero_fill:
        d = zero_filled(d, f - _dt.timedelta(days=SPAN - 1), l)
    series = ["repo_name", "anomaly_type", "metric_name"]
    number = F.datediff("date", F.lit(_dt.date(1970, 1, 1)))
    w = Window.partitionBy(*series).orderBy(number)
    held = metric_long(d, checks).select(
        *series, "min_baseline", "date",
        F.collect_list(F.struct("date", "value")).over(w.rangeBetween(-(SPAN - 1), 0)).alias("held"),
        F.lead("date").over(w).alias("next"))
    # between two days with a value, window ends hold the values of the earlier one that are young enough
    until = F.least(F.date_add("date", SPAN - 1), F.coalesce(F.date_sub("next", 1), F.date_add("date", SPAN - 1)), F.lit(l))
    since = F.greatest("date", F.lit(f))
    ends = held.where(since <= until).select(
        *series, "min_baseline", "held", F.explode(F.sequence(since, until)).alias("window_end"))
    first_prior = F.date_sub("window_end", SPAN - 1)
    last_prior = F.date_sub("window_end", RECENT_DAYS)
    values = ends.select(
        *series, "window_end", "min_baseline",
        F.transform(F.filter("held", lambda x: (x["date"] >= first_prior) & (x["date"] <= last_prior)), lambda x: x["value"]).alias("prior"),
        F.transform(F.filter("held", lambda x: x["date"] > last_prior), lambda x: x["value"]).alias("recent"))
    middle = values.withColumn("baseline_value", _median(F.col("prior")))
    keys = [*series, "window_end"]
    n_recent = F.size("recent")
    total = F.aggregate("recent", F.lit(0.0).cast("double"), lambda a, x: a + x)
    scored = _verdict(middle.select(
        *keys, "min_baseline", F.size("prior").cast("long").alias("n_prior"), n_recent.cast("long").alias("n_recent"),
        "baseline_value", _median(F.transform("prior", lambda x: F.abs(x - F.col("baseline_value")))).alias("mad"),
        F.when(n_recent > 0, total / n_recent).alias("_obs")), keys, z_threshold)
    return scored.select(
        "repo_name", "anomaly_type", "metric_name",
        F.date_sub(F.col("window_end"), RECENT_DAYS - 1).alias("window_start"), "window_end",
        "n_prior", "n_recent", "baseline_value", "mad", "observed_value", "z_score", "status")
