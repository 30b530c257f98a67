"""Structured Streaming: incremental file ingest, keyed de-duplication and the
daily roll-up, including late data.

* ``ingest_stream`` (K1, K2) — a file stream of archive lines with a fixed
  schema; ids already seen are keyed state, so an epoch looks up its own
  ids only. The event table (partitioned by ``event_date``) is written by the exactly-once
  file sink; the checkpoint skips done files.
* ``window_counts_stream`` (K3) — the same de-duplication before tumbling
  day windows, whose counts are state. There is no watermark: a row per repository and
  day is all the state, and late days must count.
* ``daily_metrics_stream`` (K4, K5) — the event table in turn is the source of
  day counts and of the opens and closes per pull request, both keyed state; an epoch
  rewrites the days that changed and reads no others.

State lives in the RocksDB provider (``state_on_disk``), whose snapshots lie in the
checkpoint folder, so a lost executor's state is loaded by another.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import json_paths as J
from ..operators.cycles import close_days, cycle_medians
from ..operators.detect import SPAN, detect_backfill
from ..operators.ingest import normalize_events
from ..operators.metrics import METRIC_COLUMNS
from ..schemas import DEFAULT_Z_THRESHOLD, EVENT, RAW_EVENT
from ..session import scratch_path
from ..sources.event_files import TS_FORMAT

MAX_FILES_PER_TRIGGER = 16
# The event table: normalised events plus their UTC day as partition column.
EVENT_TABLE = T.StructType(EVENT.fields + [T.StructField("event_date", T.DateType())])


# --------------------------------------------------------------------------- sources and table helpers

def event_file_stream(spark: SparkSession, glob: str, max_files: int = MAX_FILES_PER_TRIGGER,
                      clean_source: str | None = None, archive_dir: str | None = None) -> DataFrame:
    """Archive lines as a stream; malformed lines are dropped.

    ``clean_source`` = ``"delete"`` removes raw files once committed (or
    ``"archive"`` moves them to ``archive_dir``).
    """
    reader = spark.readStream.schema(RAW_EVENT)
    if clean_source:
        reader = reader.option("cleanSource", clean_source)
        if archive_dir:
            reader = reader.option("sourceArchiveDir", archive_dir)
    raw = (reader
           .option("maxFilesPerTrigger", max_files)
           .option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_corrupt_record")
           .option("timestampNTZFormat", TS_FORMAT)
           .json(glob))
    raw = raw.filter(F.col("_corrupt_record").isNull() & F.col("id").isNotNull()).drop("_corrupt_record")
    return normalize_events(raw)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a Parquet table exists at ``path`` (any file system)."""
    from pyspark.errors import AnalysisException
    try:
        spark.read.parquet(path).schema
        return True
    except AnalysisException:
        return False


def _read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) \
        else spark.createDataFrame([], schema)


def _days(rows: DataFrame, column: str) -> list[_dt.date]:
    """The days of ``rows``: one value per calendar day at most."""
    return [r[0] for r in rows.select(column).distinct().collect()]


def replace_partitions(spark: SparkSession, rows: DataFrame, path: str, key: list[str], part_col: str,
                       schema) -> None:
    """Upsert ``rows`` (replace on ``key``) into a Parquet table partitioned by
    the day ``part_col``; only the partitions present in ``rows`` are read and rewritten.

    The merged partitions are checkpointed (reliable, in the shared
    checkpoint folder) before the overwrite, so the write never reads the
    files it replaces.
    """
    rows = rows.select(*schema.fieldNames())
    old = _read_or_empty(spark, path, schema).where(F.col(part_col).isin(_days(rows, part_col)))
    merged = old.join(rows.select(*key), key, "left_anti").unionByName(rows).checkpoint()
    (merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(part_col).parquet(path))


def merge_columns(spark: SparkSession, rows: DataFrame, path: str, key: list[str], part_col: str, schema) -> None:
    """Upsert some columns: those of ``rows`` replace the stored ones on ``key``, the others stay."""
    old = _read_or_empty(spark, path, schema).where(F.col(part_col).isin(_days(rows, part_col)))
    new = rows.select(*key, *[F.col(c).alias(f"new_{c}") for c in rows.columns if c not in key], F.lit(True).alias("is_new"))
    merged = old.join(new, key, "full").select(*[
        F.when(F.col("is_new"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if f"new_{c}" in new.columns else F.col(c)
        for c in schema.fieldNames()]).checkpoint()
    (merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(part_col).parquet(path))


def state_on_disk(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB where the session names no provider of its own."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(key, None) or ""):
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _run(writer, checkpoint: str) -> None:
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


# --------------------------------------------------------------------------- jobs

def new_events(spark: SparkSession, glob: str) -> DataFrame:
    """The file stream with every id once, however late it comes again.

    The ids seen are state keyed by id, without expiry, so no new late event is
    lost. Of equal ids in one epoch one row stays (they are deliveries of one event).
    """
    state_on_disk(spark)
    return event_file_stream(spark, glob).dropDuplicates(["id"])


def ingest_stream(spark: SparkSession, glob: str, table_path: str, checkpoint: str) -> None:
    """K1/K2: run the file stream up to now into the event table, which the stream owns."""
    ev = new_events(spark, glob).withColumn("event_date", F.to_date("created_at"))
    _run(ev.writeStream.format("parquet").option("path", table_path).partitionBy("event_date"), checkpoint)


def dedup_stream(spark: SparkSession, glob: str, out_path: str, checkpoint: str) -> None:
    """K2: every id once, however late it comes."""
    ingest_stream(spark, glob, out_path, checkpoint)


COUNT_COLUMNS = ["star_count", "fork_count", "issue_opened", "issue_closed", "pr_opened", "pr_merged", "commit_count"]
_COUNTS = T.StructType([T.StructField("repo_name", T.StringType()), T.StructField("date", T.DateType())]
                       + [T.StructField(c, T.LongType()) for c in COUNT_COLUMNS])


def day_counts(events: DataFrame) -> DataFrame:
    """The seven counts per repository and tumbling UTC day; on a stream, the totals of the days that changed."""
    t, a = F.col("type"), J.action()
    pr = t == "PullRequestEvent"
    return (events.groupBy("repo_name", F.window("created_at", "1 day").alias("day"))
            .agg(F.count_if(t == "WatchEvent").alias("star_count"),
                 F.count_if(t == "ForkEvent").alias("fork_count"),
                 F.count_if((t == "IssuesEvent") & (a == "opened")).alias("issue_opened"),
                 F.count_if((t == "IssuesEvent") & (a == "closed")).alias("issue_closed"),
                 F.count_if(pr & (a == "opened")).alias("pr_opened"),
                 F.count_if(pr & (a == "closed") & J.merged_or_true()).alias("pr_merged"),
                 F.count_if(t == "PushEvent").alias("commit_count"))
            .select("repo_name", F.to_date("day.start").alias("date"), *COUNT_COLUMNS))


def window_counts_stream(spark: SparkSession, glob: str, out_path: str, checkpoint: str) -> None:
    """K3: daily conditional counts per repository, by tumbling UTC day.

    Ids count once. An epoch's totals replace those of the days they belong to,
    so a retried epoch changes nothing.
    """
    def epoch(df: DataFrame, _number: int) -> None:
        replace_partitions(spark, df.checkpoint(), out_path, ["repo_name", "date"], "date", _COUNTS)

    _run(day_counts(new_events(spark, glob)).writeStream.outputMode("update").foreachBatch(epoch), checkpoint)


def window_counts(spark: SparkSession, path: str) -> DataFrame:
    """The daily counts that ``window_counts_stream`` keeps."""
    return spark.read.schema(_COUNTS).parquet(path)


def pr_histories(events: DataFrame) -> DataFrame:
    """(repo_name, number, opened, closed): all times of each pull request; on a stream, of those that changed."""
    pr = events.where(F.col("type") == "PullRequestEvent").select(
        "repo_name", J.pr_number().alias("number"), J.action().alias("action"), "created_at")
    when = lambda action: F.collect_list(F.when(F.col("action") == action, F.col("created_at")))
    return pr.where(F.col("number").isNotNull()).groupBy("repo_name", "number").agg(
        when("opened").alias("opened"), when("closed").alias("closed"))


_CLOSE_DAYS = T.StructType([
    T.StructField("repo_name", T.StringType()), T.StructField("number", T.IntegerType()),
    T.StructField("close_date", T.DateType()), T.StructField("closes", T.ArrayType(T.LongType())),
    T.StructField("opens", T.ArrayType(T.LongType()))])
_METRICS = T.StructType([T.StructField("repo_name", T.StringType()), T.StructField("date", T.DateType())]
                        + [T.StructField(c, T.DoubleType() if c == "pr_median_merge_hours" else T.LongType())
                           for c in METRIC_COLUMNS])


def daily_metrics_stream(spark: SparkSession, glob: str, events_path: str, metrics_path: str,
                         checkpoint: str, audit_path: str | None = None,
                         z_threshold: float = DEFAULT_Z_THRESHOLD) -> None:
    """K4/K5: exact daily metrics under late data, refreshed per epoch.

    The new events go to the event table. Its stream feeds the day counts, and the
    opens and closes per pull request; of the latter the (pull request, close day) rows
    that changed are stored by close day in ``<events_path>-close-days``, and the medians of those days are computed
    from that table alone. With ``audit_path`` every window end the refreshed
    days can move (day .. day+34, up to the last day with data) is re-scored and
    its partition replaced.
    """
    ingest_stream(spark, glob, events_path, f"{checkpoint}/events")
    key, close_days_path = ["repo_name", "date"], f"{events_path}-close-days"

    def refreshed(rows: DataFrame) -> None:
        merge_columns(spark, rows, metrics_path, key, "date", _METRICS)
        if audit_path is not None:
            detect_on_arrival(spark, rows.select("date").distinct(), metrics_path, audit_path, z_threshold)

    def counted(df: DataFrame, _number: int) -> None:
        refreshed(df.checkpoint())

    def paired(df: DataFrame, _number: int) -> None:
        pr = df.checkpoint()
        times = lambda c: pr.select("repo_name", "number", F.explode(c).alias("ts"))
        units = close_days(times("opened"), times("closed")).select(*_CLOSE_DAYS.fieldNames()).checkpoint()
        old = _read_or_empty(spark, close_days_path, _CLOSE_DAYS).where(
            F.col("close_date").isin(_days(units, "close_date")))
        changed = units.join(old, _CLOSE_DAYS.fieldNames(), "left_anti").checkpoint()
        # medians first, stored rows last: an epoch that is run again still finds its changes
        days = _days(changed, "close_date")
        kept = old.join(changed, ["repo_name", "number", "close_date"], "left_anti").where(F.col("close_date").isin(days))
        refreshed(cycle_medians(kept.unionByName(changed)).select("repo_name", F.col("close_date").alias("date"),
                                                                  F.col("median_hours").alias("pr_median_merge_hours")).checkpoint())
        replace_partitions(spark, changed, close_days_path, ["repo_name", "number", "close_date"], "close_date", _CLOSE_DAYS)

    events = lambda: spark.readStream.schema(EVENT_TABLE).parquet(events_path)
    _run(day_counts(events()).writeStream.outputMode("update").foreachBatch(counted), f"{checkpoint}/counts")
    _run(pr_histories(events()).writeStream.outputMode("update").foreachBatch(paired), f"{checkpoint}/cycles")


AUDIT_SCHEMA = T.StructType([
    T.StructField("repo_name", T.StringType()), T.StructField("anomaly_type", T.StringType()),
    T.StructField("metric_name", T.StringType()), T.StructField("window_start", T.DateType()),
    T.StructField("window_end", T.DateType()), T.StructField("n_prior", T.LongType()),
    T.StructField("n_recent", T.LongType()), T.StructField("baseline_value", T.DoubleType()),
    T.StructField("mad", T.DoubleType()), T.StructField("observed_value", T.DoubleType()),
    T.StructField("z_score", T.DoubleType()), T.StructField("status", T.StringType())])


def detect_on_arrival(spark: SparkSession, dates: DataFrame, metrics_path: str, audit_path: str,
                      z_threshold: float = DEFAULT_Z_THRESHOLD) -> None:
    """K5: re-score the window ends that a refreshed day reaches, day .. day+34,
    and no others between a late day and the newest one."""
    metrics = spark.read.parquet(metrics_path)
    lo, hi = dates.agg(F.min("date"), F.max("date")).first()
    last = metrics.agg(F.max("date")).first()[0]
    if lo is None or last is None:
        return
    hi = min(hi + _dt.timedelta(days=SPAN - 1), last)
    ends = dates.select(F.explode(F.sequence("date", F.date_add("date", SPAN - 1))).alias("window_end")).distinct()
    # the values of a window end come from the 35 days up to it
    days = ends.select(F.explode(F.sequence(F.date_sub("window_end", SPAN - 1), "window_end")).alias("date")).distinct()
    scope = metrics.join(days, "date", "left_semi").select(*metrics.columns)
    audit = detect_backfill(scope, lo, hi, z_threshold).join(ends, "window_end", "left_semi")
    replace_partitions(spark, audit, audit_path, ["repo_name", "anomaly_type", "window_end"], "window_end",
                       AUDIT_SCHEMA)


# --------------------------------------------------------------------------- fixtures for the registered queries

def stage_day_files(raw: DataFrame, root: str, phase: str, day_filter) -> None:
    """Write archive lines as one folder per UTC day below ``root/phase``."""
    (raw.filter(day_filter).withColumn("event_date", F.to_date("created_at"))
     .hint("rebalance", "event_date")
     .write.mode("overwrite").option("timestampNTZFormat", TS_FORMAT)
     .partitionBy("event_date").json(f"{root}/{phase}"))


def staged_run(spark: SparkSession, raw: DataFrame, name: str, first, second, job) -> dict:
    """Stage ``first`` days, run ``job`` to completion, stage ``second``
    (late / duplicate deliveries), run ``job`` again from its checkpoint."""
    root = scratch_path(spark, f"{name}-in")
    paths = {"root": root, "glob": f"{root}/*/event_date=*/*.json",
             "out": scratch_path(spark, f"{name}-out"), "out2": scratch_path(spark, f"{name}-out2"),
             "out3": scratch_path(spark, f"{name}-out3"), "ckpt": scratch_path(spark, f"{name}-ckpt")}
    stage_day_files(raw, root, "a", first)
    job(paths)
    stage_day_files(raw, root, "b", second)
    job(paths)
    return paths


def day_is(d: str):
    return F.to_date("created_at") == F.lit(_dt.date.fromisoformat(d))
