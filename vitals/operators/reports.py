"""Investigation reports: contract check, flattening, latest-report
assembly, the report feed and its presentation columns.

The reference attaches citations with one query per report; here the
citations table is grouped once by report id and joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import CITATION_TYPES, CONFIDENCES, REPORT
from .artifacts import top_k

# Citation labels and metric units of the report pages.
CITATION_LABELS = {"sql_result": "Query", "artifact_chunk": "GitHub PR", "release_note": "Release"}
METRIC_UNITS = {"pr_median_merge_hours": "h", "issue_opened": " /day", "star_count": " /day"}
ANOMALY_LABELS = {"pr_slowdown": "PR Slowdown", "issue_spike": "Issue Spike", "star_spike": "Star Spike"}


# --------------------------------------------------------------------------- contract

def report_contract(reports: DataFrame) -> DataFrame:
    """Violation flags per report; ``valid`` when none is set.

    Required text fields present; confidence one of high/medium/low; every
    citation type known; evidence non-empty requires citations non-empty.
    """
    conf_ok = F.col("confidence").isNotNull() & F.col("confidence").isin(*CONFIDENCES)
    types = F.transform(F.coalesce("citations", F.array()), lambda c: c["citation_type"])
    bad_type = F.exists(types, lambda t: t.isNull() | ~t.isin(*CITATION_TYPES))
    missing = (F.col("summary").isNull() | F.col("root_cause").isNull()
               | F.col("limitations").isNull() | F.col("evidence").isNull()
               | F.col("citations").isNull())
    uncited = (F.size(F.coalesce("evidence", F.array())) > 0) & \
              (F.size(F.coalesce("citations", F.array())) == 0)
    return reports.select(
        "id", "anomaly_id", missing.alias("missing_fields"), (~conf_ok).alias("bad_confidence"),
        bad_type.alias("bad_citation_type"), uncited.alias("uncited_evidence"),
        (~(missing | ~conf_ok | bad_type | uncited)).alias("valid"))


def split_valid(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid reports, quarantined reports with their violation flags)."""
    c = report_contract(reports)
    j = reports.join(c.drop("anomaly_id"), "id")
    return j.filter("valid").select(*reports.columns), j.filter(~F.col("valid"))


# --------------------------------------------------------------------------- stored reports

def parse_reports(stored: DataFrame, raw: str = "raw_output") -> DataFrame:
    """Stored report text (one JSON object per row) -> the nested report columns
    beside the other columns of ``stored``.

    A missing or null list is empty; text that is no JSON object gives null
    fields and empty lists, which the contract check then rejects.
    """
    lists = {"evidence", "citations"}
    parsed = stored.withColumn("__r", F.from_json(raw, REPORT))
    return parsed.select(*[c for c in stored.columns if c != raw], *[
        (F.coalesce(F.col("__r")[f.name], F.array().cast(f.dataType)) if f.name in lists else F.col("__r")[f.name])
        .alias(f.name) for f in REPORT.fields])


# --------------------------------------------------------------------------- flatten

def flatten_citations(reports: DataFrame) -> DataFrame:
    """Nested reports -> ``report_citations`` rows (one NULL row for a report
    without citations, as ``explode_outer`` does)."""
    return reports.select("id", "anomaly_id", F.posexplode_outer("citations").alias("pos", "c")).select(
        F.col("id").alias("report_id"), "anomaly_id", F.col("pos").cast("long").alias("pos"),
        F.col("c.citation_type").alias("citation_type"), F.col("c.source_url").alias("source_url"),
        F.col("c.excerpt").alias("excerpt"))


# --------------------------------------------------------------------------- latest report

def last_per_key(df: DataFrame, key: str, order_cols: list[str]) -> DataFrame:
    """Row with the greatest ``order_cols`` per ``key`` (DISTINCT ON ... DESC).

    ``row_number`` = 1 is planned with a partial ``WindowGroupLimit``: every task
    passes on one row per key, so a key with a huge number of reports does not
    meet in one task. Rows with a null key have no last row.
    """
    first = top_k(df.filter(F.col(key).isNotNull()), [key], [F.col(c).desc() for c in order_cols], 1, "__place")
    return first.drop("__place").select(key, *[c for c in df.columns if c != key])


def latest_reports(reports: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Latest report per anomaly among ``confidence != 'error'`` (which also
    drops NULL confidence), joined to its anomaly."""
    latest = last_per_key(reports.filter(F.col("confidence") != "error"), "anomaly_id", ["created_at", "id"])
    a = anomalies.select(F.col("id").alias("anomaly_id"), "repo_name", "anomaly_type", "window_start",
                         "window_end", "metric_name", "baseline_value", "observed_value", "z_score")
    return latest.join(a, "anomaly_id")


def _r(c: str, dp: int) -> Column:
    return F.round(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), dp)


def report_feed(latest: DataFrame, citations: DataFrame) -> DataFrame:
    """Feed index rows (A12): summary fields, rounded numbers, citation count."""
    n = citations.filter(F.col("citation_type").isNotNull()).groupBy("report_id") \
        .agg(F.count("*").alias("citations_count"))
    j = latest.join(n, latest["id"] == n["report_id"], "left")
    return j.select(
        "id", "anomaly_id", F.col("repo_name").alias("repo"), "anomaly_type", "window_start", "window_end",
        "metric_name", _r("baseline_value", 1).alias("baseline"), _r("observed_value", 1).alias("observed"),
        _r("z_score", 2).alias("z_score"), "confidence", "summary", "root_cause",
        F.coalesce("citations_count", F.lit(0)).cast("long").alias("citations_count"),
        F.col("tool_calls_used").alias("tool_calls"), _r("duration_seconds", 1).alias("duration_s"),
        "created_at")


def feed_order(feed: DataFrame) -> DataFrame:
    """Feed order: newest window first, ties by anomaly id."""
    return feed.orderBy(F.col("window_end").desc(), F.col("anomaly_id").asc())


def report_detail(latest: DataFrame, citations: DataFrame) -> DataFrame:
    """One detail document per report (I6, A13): anomaly fields, evidence
    and the citations in their original order."""
    c = (citations.filter(F.col("citation_type").isNotNull()).groupBy("report_id")
         .agg(F.array_sort(F.collect_list(F.struct("pos", "citation_type", "source_url", "excerpt")))
              .alias("cs")))
    j = latest.join(c, latest["id"] == c["report_id"], "left")
    cites = F.transform(F.coalesce(F.col("cs"), F.array()), lambda x: F.struct(
        x["citation_type"].alias("type"), x["source_url"].alias("url"), x["excerpt"].alias("excerpt")))
    return j.select(
        "id", F.col("repo_name").alias("repo"), "anomaly_type", "window_start", "window_end", "metric_name",
        _r("baseline_value", 1).alias("baseline"), _r("observed_value", 1).alias("observed"),
        _r("z_score", 2).alias("z_score"), "summary", "root_cause", "confidence",
        F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"),
        cites.alias("citations"), "limitations", F.col("tool_calls_used").alias("tool_calls"),
        _r("duration_seconds", 1).alias("duration_s"), "created_at")


def write_feed(feed: DataFrame, path: str) -> None:
    """Feed sink: JSON-lines index, newest window first. The global sort
    range-partitions the rows, so part files are in feed order and no single
    task holds the whole feed."""
    feed_order(feed).write.mode("overwrite").json(path)


def read_feed_order(spark: SparkSession, path: str, schema) -> DataFrame:
    """The stored feed with a place per row: lines count on along the part files (one size per file is gathered)."""
    file = F.col("_metadata.file_path")
    rows = spark.read.schema(schema).json(path).select("*", file.alias("file"), F.monotonically_increasing_id().alias("line"))
    sizes = {r["file"]: r["n"] for r in rows.groupBy("file").agg(F.count("*").alias("n")).collect()}
    before, start = 0, []
    for name in sorted(sizes):
        start.append((name, before))
        before += sizes[name]
    base = spark.createDataFrame(start or [("", 0)], "file string, before long")
    w = Window.partitionBy("file").orderBy("line")
    return rows.join(base, "file").withColumn("place", F.col("before") + F.row_number().over(w)).drop("file", "line", "before")


DETAIL_SPAN = 10_000


def write_details(detail: DataFrame, path: str) -> None:
    """Detail sink: one JSON document per report, a line each, in id order within a folder per
    ``DETAIL_SPAN`` ids (``part=<n>/``), so a lookup opens one folder and millions of reports do not make as many."""
    part = F.floor(F.col("id") / DETAIL_SPAN)
    (detail.withColumn("part", part).hint("rebalance", "part").sortWithinPartitions("part", "id")
     .write.mode("overwrite").partitionBy("part").json(path))


def read_details(spark: SparkSession, path: str, schema, ids: list[int] | None = None) -> DataFrame:
    """The stored documents; of ``ids`` only, where given, reading their folders alone."""
    df = spark.read.schema(T.StructType([*schema.fields, T.StructField("part", T.LongType())])).json(path)
    if ids is not None:
        df = df.where(F.col("part").isin(sorted({i // DETAIL_SPAN for i in ids})) & F.col("id").isin(ids))
    return df.drop("part")


# --------------------------------------------------------------------------- presentation

def _fmt(v: Column, metric: Column) -> Column:
    """Value with one decimal unless integral, plus the metric's unit."""
    unit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in METRIC_UNITS.items() for x in kv]),
                                   metric), F.lit(""))
    num = F.when(v % 1 == 0, v.cast("long").cast("string")).otherwise(F.round(v, 1).cast("string"))
    return F.concat(num, unit)


def feed_cards(feed: DataFrame) -> DataFrame:
    """Card columns: owner/name, change multiplier label and detail, delta arrow, headline,
    high-severity flag (z > 5). An observed 0 is ``100% below normal``."""
    # label and headline wordings are fixed values: the feed page shows them
    b, o = F.col("baseline"), F.col("observed")
    mult = o / b
    pct = lambda x: F.round(x * 100).cast("long").cast("string")
    times = lambda x: F.round(x).cast("long").cast("string")
    obs, base = _fmt(o, F.col("metric_name")), _fmt(b, F.col("metric_name"))
    has_base = b.isNotNull() & (b != 0)
    label = (F.when(~has_base, F.lit(None).cast("string"))
             .when(mult >= 2, F.concat(times(mult), F.lit("× normal")))
             .when(mult > 1.1, F.concat(pct(mult - 1), F.lit("% above normal")))
             .when((mult < 0.5) & (mult != 0), F.concat(times(F.try_divide(F.lit(1.0), mult)), F.lit("× below normal")))
             .when(mult < 0.9, F.concat(pct(1 - mult), F.lit("% below normal")))
             .otherwise(obs))
    detail = F.when(~has_base, F.lit(None).cast("string")).when(
        (mult >= 2) | (mult > 1.1) | (mult < 0.9), F.concat(obs, F.lit(" vs "), base, F.lit(" typical"))
    ).otherwise(F.concat(F.lit("vs "), base, F.lit(" typical")))
    hm = F.when(b > 0, mult).otherwise(F.lit(0.0))
    mx = (F.when(hm >= 2, F.concat(times(hm), F.lit("×")))
          .when(hm > 1.05, F.concat(F.lit("+"), pct(hm - 1), F.lit("%"))).otherwise(F.lit("")))
    short = F.try_element_at(F.split(F.col("repo"), "/"), F.lit(2))
    t = F.col("anomaly_type")
    delta = (F.when(~has_base, F.lit("")).when(mult >= 2, F.concat(F.lit("↑"), times(mult), F.lit("×")))
             .when(mult > 1, F.concat(F.lit("↑"), pct(mult - 1), F.lit("%")))
             .when(mult < 1, F.concat(F.lit("↓"), pct(1 - mult), F.lit("%"))).otherwise(F.lit("")))
    with_mx = mx != ""
    headline = (F.when(t == "pr_slowdown", F.when(with_mx, F.concat(short, F.lit(": PR merge time was "), mx,
                                                                    F.lit(" slower than normal")))
                       .otherwise(F.concat(short, F.lit(": PR merge time anomaly detected"))))
                .when(t == "issue_spike", F.when(with_mx, F.concat(short, F.lit(": issue rate spiked "), mx,
                                                                   F.lit(" above normal")))
                      .otherwise(F.concat(short, F.lit(": unusual spike in new issues"))))
                .when(t == "star_spike", F.when(with_mx, F.concat(short, F.lit(": starred "), mx,
                                                                  F.lit(" more than usual this week")))
                      .otherwise(F.concat(short, F.lit(": unusual star activity detected"))))
                .otherwise(F.concat(short, F.lit(": "), t, F.lit(" detected"))))
    return feed.select(
        "id", F.try_element_at(F.split(F.col("repo"), "/"), F.lit(1)).alias("owner"), short.alias("name"),
        label.alias("change_label"), detail.alias("change_detail"), delta.alias("delta"), headline.alias("headline"),
        (F.col("z_score") > 5).alias("high_severity"))


def feed_filtered(feed: DataFrame, repo: str | None = None, anomaly_type: str | None = None,
                  confidence: str | None = None) -> DataFrame:
    """Conjunction of the optional equality filters of the feed page."""
    cond = F.lit(True)
    for col, v in (("repo", repo), ("anomaly_type", anomaly_type), ("confidence", confidence)):
        if v is not None:
            cond = cond & (F.col(col) == v)
    return feed.filter(cond)


def feed_stats(feed: DataFrame) -> DataFrame:
    """Header numbers: reports, distinct repositories, first and last window."""
    return feed.agg(F.count("*").alias("n_reports"), F.count_distinct("repo").alias("n_repos"),
                    F.min("window_start").alias("first_window_start"),
                    F.max("window_end").alias("last_window_end"))


def citation_view(citations: DataFrame) -> DataFrame:
    """Citation rows as shown: label by type, link unless the source starts
    with ``SQL``, path of the URL without its leading slash, 100-char excerpt."""
    u = F.col("source_url")
    labels = F.create_map(*[F.lit(x) for kv in CITATION_LABELS.items() for x in kv])
    is_link = u.isNotNull() & ~u.startswith("SQL")
    path = F.regexp_replace(F.try_parse_url(u, F.lit("PATH")), "^/", "")
    return citations.filter(F.col("citation_type").isNotNull()).select(
        "report_id", "pos",
        F.coalesce(F.try_element_at(labels, F.col("citation_type")), F.col("citation_type")).alias("label"),
        is_link.alias("is_link"),
        F.when(is_link, F.coalesce(path, u)).otherwise(F.coalesce(u, F.lit(""))).alias("short_url"),
        F.left(F.col("excerpt"), F.lit(100)).alias("excerpt"))
