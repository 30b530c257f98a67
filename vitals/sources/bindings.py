"""Bindings from the provided test tables to the engine's data model.

The provided Parquet tables are generic (``events``, ``documents`` ...); these
deterministic column mappings turn them into the engine's own tables so that
every job runs over the whole provided data and grows with it. Each binding is
a pure projection/aggregation (no driver-side work) and has a line-for-line
twin in ``plans.oracle`` for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables as _t

GITHUB = "https://github.com/"
N_REPOS = 10
EVENTS_PER_SERIES = 10_000


def _repo_of(idx: Column) -> Column:
    return F.concat(F.lit("org/repo"), idx.cast("string"))


def repo_index(repo_name: Column) -> Column:
    """``org/repoN`` -> N."""
    return F.regexp_extract(repo_name, r"(\d+)$", 1).cast("long")


def artifact_key(repo_name: Column, number: Column) -> Column:
    """(repository, number) -> the document id that ``document_artifacts`` maps to the same pair."""
    return F.floor(number / 100) * 1000 + repo_index(repo_name) * 100 + number % 100


def pr_url(repo_name: Column, number: Column) -> Column:
    return F.concat(F.lit(GITHUB), repo_name, F.lit("/pull/"), number.cast("string"))


# --------------------------------------------------------------------------- events

def bound_events(events: DataFrame) -> DataFrame:
    """``events`` -> normalised event table (id, type, repo_name, actor_login,
    created_at, payload JSON text).

    event_type view -> WatchEvent; error -> IssuesEvent opened (k<60) / closed;
    signup -> PullRequestEvent opened; purchase -> PullRequestEvent closed with
    merged NULL (k%10=1, newer payload), false (k%10=0) or true; click ->
    ForkEvent (k%4=0), ReleaseEvent (k=1) or PushEvent. Issue and PR numbers are
    k plus 100 per 10,000 event ids, so artifacts grow with the event table.
    """
    # props.k is parsed once in an inner projection; the payload is built from
    # the projected column.
    base = events.select("event_id", "ts", "user_id", "event_type",
                         F.get_json_object("props", "$.k").try_cast("int").alias("k"))
    k, et = F.col("k"), F.col("event_type")
    etype = (F.when(et == "view", "WatchEvent")
             .when(et == "error", "IssuesEvent")
             .when(et.isin("signup", "purchase"), "PullRequestEvent")
             .when(et == "click",
                   F.when(k % 4 == 0, "ForkEvent").when(k == 1, "ReleaseEvent")
                   .otherwise("PushEvent")))
    act = (F.when(et == "error", F.when(k < 60, "opened").otherwise("closed"))
           .when(et == "signup", "opened")
           .when(et == "purchase", "closed"))
    merged = F.when(et == "purchase",
                    F.when(k % 10 == 1, F.lit(None).cast("boolean"))
                    .when(k % 10 == 0, F.lit(False)).otherwise(F.lit(True)))
    tag = F.concat(F.lit("v"), (F.col("user_id") % N_REPOS).cast("string"), F.lit("."),
                   (F.col("event_id") % 100).cast("string"))
    is_pr = et.isin("signup", "purchase")
    number = (F.floor(F.col("event_id") / EVENTS_PER_SERIES) * 100 + k).cast("int")
    is_release = (et == "click") & (k == 1)
    payload = F.to_json(F.struct(
        act.alias("action"),
        F.when(is_pr | (et == "error"), number).alias("number"),
        F.when(is_pr, F.struct(number.alias("number"), merged.alias("merged"))).alias("pull_request"),
        F.when(is_release, F.struct(
            tag.alias("tag_name"),
            F.concat(F.lit("Release "), tag).alias("name"),
            F.repeat(F.concat(F.lit("Notes for "), tag, F.lit(". ")), 30).alias("body"),
        )).alias("release"),
    ))
    return base.select(
        F.col("event_id").cast("string").alias("id"),
        etype.alias("type"),
        _repo_of(F.col("user_id") % N_REPOS).alias("repo_name"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("actor_login"),
        F.col("ts").alias("created_at"),
        payload.alias("payload"),
    )


def raw_events(events: DataFrame) -> DataFrame:
    """The same events in the nested shape of an hourly archive line."""
    b = bound_events(events)
    return b.select(
        "id", "type", "created_at",
        F.struct(F.col("repo_name").alias("name")).alias("repo"),
        F.struct(F.col("actor_login").alias("login")).alias("actor"),
        F.from_json("payload", "action string, number int, "
                    "pull_request struct<number:int, merged:boolean>, "
                    "release struct<tag_name:string, name:string, body:string>").alias("payload"),
    )


def repos(spark: SparkSession) -> DataFrame:
    """The watched repositories (id, name)."""
    return spark.range(N_REPOS).select((F.col("id") + 1).alias("id"), _repo_of(F.col("id")).alias("name"))


# --------------------------------------------------------------------------- artifacts

def bound_artifacts(events: DataFrame, documents: DataFrame) -> DataFrame:
    """Pull-request artifacts from the raw ``events`` table (see
    ``artifacts_from_events``)."""
    return artifacts_from_events(bound_events(events), documents)


def artifacts_from_events(events: DataFrame, documents: DataFrame) -> DataFrame:
    """Pull-request artifacts: one row per (repo, number) with an open event.

    created_at = first open, closed_at = last close when it is later than the
    open; body = the document ``artifact_key(repo, number)`` (may be absent),
    title = its first 80 characters, labels = its language and source. The title is
    cut before the join, so a caller that drops ``body`` has no text shuffled.
    """
    from ..functions.json_paths import label_names_json
    pr = (events
          .filter(F.col("type") == "PullRequestEvent")
          .select("repo_name", "actor_login", "created_at",
                  F.get_json_object("payload", "$.action").alias("action"),
                  F.get_json_object("payload", "$.number").cast("int").alias("number")))
    opened = F.when(F.col("action") == "opened", F.col("created_at"))
    g = (pr.groupBy("repo_name", "number")
         .agg(F.min(opened).alias("created_at"),
              F.max(F.when(F.col("action") == "closed", F.col("created_at"))).alias("last_close"),
              F.min_by(F.when(F.col("action") == "opened", F.col("actor_login")), opened)
              .alias("author_login"))
         .filter(F.col("created_at").isNotNull()))
    docs = documents.select(F.col("doc_id"), F.left("text", F.lit(80)).alias("title"), F.col("text").alias("body"), "lang", "source")
    a = g.withColumn("artifact_id", artifact_key(F.col("repo_name"), F.col("number")))
    a = a.join(docs, a["artifact_id"] == docs["doc_id"], "left")
    closed_at = F.when(F.col("last_close") > F.col("created_at"), F.col("last_close"))
    return a.select(
        "artifact_id", "repo_name", F.lit("pull_request").alias("type"), "number",
        "title", "body",
        F.when(closed_at.isNotNull(), "closed").otherwise("open").alias("state"),
        "author_login", "created_at", closed_at.alias("closed_at"),
        label_names_json(F.when(F.col("doc_id").isNotNull(), F.array(
            F.struct(F.col("lang").alias("name")), F.struct(F.col("source").alias("name"))))).alias("labels"),
        pr_url(F.col("repo_name"), F.col("number")).alias("url"),
    )


def bound_comments(conversations: DataFrame) -> DataFrame:
    """Discussion comments: conversation ``conv_id`` is the artifact id."""
    return conversations.select(
        F.col("conv_id").alias("artifact_id"),
        F.col("turn").alias("position"),
        F.col("role").alias("author_login"),
        F.col("text").alias("body"),
    )


# --------------------------------------------------------------------------- chunk sources

def document_artifacts(documents: DataFrame) -> DataFrame:
    """Every document as a pull-request artifact to chunk and search.

    doc_id d -> repo ``org/repo((d div 100) % 10)``, number
    ``d % 100 + 100 * (d div 1000)`` (so ids coincide with those of
    ``bound_artifacts``), title = first 80 characters.
    """
    d = F.col("doc_id")
    number = d % 100 + F.floor(d / 1000).cast("long") * 100
    repo = _repo_of(F.floor(d / 100).cast("long") % N_REPOS)
    return documents.select(
        d.alias("artifact_id"), repo.alias("repo_name"), F.lit("pull_request").alias("type"),
        number.alias("number"), F.left("text", F.lit(80)).alias("title"),
        F.col("text").alias("body"), pr_url(repo, number).alias("url"),
    )


def search_queries(benchmark: DataFrame) -> DataFrame:
    """One search per benchmark item: query text = all its distinct non-stop tokens, vector =
    that of the query text, repo ``org/repo(item_id % 10)``."""
    from ..functions.text import query_terms_expr
    from ..operators.embedding import embed_text
    terms = query_terms_expr(F.col("text"))
    q = benchmark.select(
        F.col("item_id").alias("query_id"),
        _repo_of(F.col("item_id") % N_REPOS).alias("repo_name"),
        F.array_join(terms, " ").alias("query_text"),
    )
    return embed_text(q, "query_text", "query_vec")


# --------------------------------------------------------------------------- anomalies, reports, cases

LOW_Z, CASE_Z = 1.5, 1.0
REPORT_TYPES = ["pr_slowdown", "issue_spike", "star_spike"]


def anomaly_id(repo_name: Column, anomaly_type: Column, window_end: Column) -> Column:
    """The id of an anomaly: 48 bits of the MD5 of its natural key."""
    key = F.concat_ws("|", repo_name, anomaly_type, window_end.cast("string"))
    return F.conv(F.substring(F.md5(F.encode(key, "UTF-8")), 1, 12), 16, 10).cast("long")


def scored_checks(daily: DataFrame) -> DataFrame:
    """The checks of every window end with data whose z reaches ``CASE_Z``, with the id of their anomaly."""
    from ..operators.detect import detect_backfill
    first, last = daily.agg(F.min("date"), F.max("date")).first()
    audit = detect_backfill(daily, first, last, CASE_Z).where(F.col("status") == "anomaly")
    return audit.select(
        anomaly_id(F.col("repo_name"), F.col("anomaly_type"), F.col("window_end")).alias("id"), "repo_name", "anomaly_type",
        "window_start", "window_end", "metric_name", "baseline_value", "observed_value", "z_score")


def _numbers() -> list[Column]:
    return [F.round(c, 6).alias(c) for c in ("baseline_value", "observed_value", "z_score")]


def bound_anomalies(scored: DataFrame) -> DataFrame:
    """The detected anomalies: scored checks with z >= 1.5, numbers to 6 places."""
    return scored.where(F.col("z_score") >= LOW_Z).select(
        "id", "repo_name", "anomaly_type",
        F.timestamp_add("DAY", F.lit(1), F.col("window_end").cast("timestamp_ntz")).alias("detected_at"),
        "window_start", "window_end", "metric_name", *_numbers(), F.lit("pending").alias("status"))


def bound_reports(documents: DataFrame) -> DataFrame:
    """Investigation reports, one per document, in the nested report shape.

    The anomaly is that of the document's repository, of type ``doc_id div 10 % 3`` and of the window
    that ends ``doc_id % 10`` days before Jan 30 (not every such anomaly exists); created
    2024-02-01 + doc_id minutes; confidence
    cycles high/medium/low/NULL; evidence = every line; no citations
    when doc_id % 5 = 0 (those break the contract), else an artifact citation for every line
    and one SQL citation.
    """
    d, text = F.col("doc_id"), F.col("text")
    repo = _repo_of(F.floor(d / 100).cast("long") % N_REPOS)
    kind = F.element_at(F.array(*[F.lit(t) for t in REPORT_TYPES]), (F.floor(d / 10) % 3 + 1).cast("int"))
    aid = anomaly_id(repo, kind, F.date_sub(F.lit("2024-01-30").cast("date"), (d % 10).cast("int")))
    conf = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low"),
                                F.lit(None).cast("string")),
                        ((F.floor(d / 40) + d) % 4 + 1).cast("int"))
    lines = F.split(text, "\n")
    cited = F.transform(lines, lambda line, i: F.struct(
        F.lit("artifact_chunk").alias("citation_type"),
        pr_url(repo, (aid * 7 + (i + d % 3) * 13) % 100).alias("source_url"), line.alias("excerpt")))
    queried = F.array(F.struct(F.lit("sql_result").alias("citation_type"), F.lit("SQL: daily metrics").alias("source_url"),
                               F.try_element_at(lines, F.lit(1)).alias("excerpt")))
    cites = F.when(d % 5 == 0, F.array().cast("array<struct<citation_type:string,source_url:string,excerpt:string>>")) \
        .otherwise(F.concat(cited, queried))
    return documents.select(
        d.alias("id"), aid.alias("anomaly_id"),
        F.timestamp_add("MINUTE", d, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")).alias("created_at"),
        F.try_element_at(lines, F.lit(1)).alias("summary"),
        F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit("")).alias("root_cause"),
        conf.alias("confidence"),
        lines.alias("evidence"),
        cites.alias("citations"),
        F.lit("Inline review comments were not fetched.").alias("limitations"),
        (1 + d % 10).cast("int").alias("tool_calls_used"),
        ((F.col("n_chars") % 1200) / 10.0).alias("duration_seconds"),
    )


def stored_reports(documents: DataFrame) -> DataFrame:
    """The reports as stored: (id, anomaly_id, raw_output), the report a JSON text.

    Reports without citations leave the key out; ids with ``id % 11 = 7`` hold
    an error message that is no JSON.
    """
    cites = F.when(F.size("citations") > 0, F.col("citations")).alias("citations")
    raw = F.to_json(F.struct("summary", "root_cause", "confidence", "evidence", cites, "limitations"))
    return bound_reports(documents).select(
        "id", "anomaly_id", F.when(F.col("id") % 11 == 7, "model stopped: no report").otherwise(raw).alias("raw_output"))


def bound_cases(scored: DataFrame) -> DataFrame:
    """Golden cases: all scored checks (those with z below 1.5 have no anomaly row)."""
    i = F.col("id")
    urls = F.when(i % 6 == 4, F.array().cast("array<string>")).otherwise(
        F.array(*[pr_url(F.col("repo_name"), (i * 7 + j * 13) % 100) for j in range(3)]))
    confs = F.when(i % 2 == 0, F.array(F.lit("high"), F.lit("medium"))) \
        .otherwise(F.array(F.lit("low"), F.lit("medium")))
    baseline, observed, z = _numbers()
    return scored.select(
        F.concat(F.lit("case_"), i.cast("string")).alias("id"), i.alias("anomaly_ref"),
        F.col("repo_name").alias("repo"), "anomaly_type", "metric_name",
        "window_start", "window_end", urls.alias("expected_evidence_urls"),
        F.lit("").alias("accepted_explanation"), confs.alias("expected_confidences"),
        z, baseline, observed, F.lit("").alias("limitation_notes"),
    )


# --------------------------------------------------------------------------- loaders

_EVENT_TABLES: dict[tuple[str, str], str] = {}


def event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as stored in production: normalised events in Parquet
    partitioned by ``event_date``, written once per session into the shared
    scratch folder (``spark.checkpoint.dir``) and read back from there."""
    from ..schemas import EVENT
    from ..session import scratch_path
    from pyspark.sql import types as T
    from ..session import session_key
    key = (session_key(spark), sf_dir)
    path = _EVENT_TABLES.get(key)
    if path is None:
        path = scratch_path(spark, "events")
        (bound_events(_t.table(spark, sf_dir, "events"))
         .withColumn("event_date", F.to_date("created_at"))
         .sortWithinPartitions("event_date")
         .write.mode("overwrite").option("compression", "zstd").partitionBy("event_date").parquet(path))
        _EVENT_TABLES[key] = path
    schema = T.StructType(EVENT.fields + [T.StructField("event_date", T.DateType())])
    return spark.read.schema(schema).parquet(path)


_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Write ``build()`` once per session into the shared scratch folder and
    read it back (the engine's persisted tables: chunk store, index)."""
    from ..session import scratch_path, session_key
    key = (session_key(spark), sf_dir, name)
    path = _STORED.get(key)
    if path is None:
        path = scratch_path(spark, name)
        build().write.mode("overwrite").option("compression", "zstd").parquet(path)
        _STORED[key] = path
    return spark.read.parquet(path)


def early_chunks(spark: SparkSession, sf_dir: str) -> str:
    """The chunk store after an embedding run over the artifacts created before Jan 15 (once per session)."""
    from ..operators.embedding import append_missing
    from ..session import scratch_path, session_key
    key = (session_key(spark), sf_dir, "early-chunks")
    if key not in _STORED:
        path = scratch_path(spark, "early-chunks")
        early = load(spark, sf_dir, "artifacts").where(F.col("created_at") < F.lit("2024-01-15 00:00:00"))
        append_missing(spark, early, path)
        _STORED[key] = path
    return _STORED[key]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Bound table by name, read from ``sf_dir``."""
    t = lambda n: _t.table(spark, sf_dir, n)
    if name == "events":
        return event_table(spark, sf_dir)
    if name == "daily":
        from ..operators.metrics import daily_metrics
        return stored(spark, sf_dir, "repo-metrics-daily", lambda: daily_metrics(event_table(spark, sf_dir)))
    if name == "artifacts":
        return stored(spark, sf_dir, "artifacts",
                      lambda: artifacts_from_events(event_table(spark, sf_dir), t("documents")))
    if name == "artifact_heads":  # without their texts
        return stored(spark, sf_dir, "artifact-heads",
                      lambda: artifacts_from_events(event_table(spark, sf_dir), t("documents")).drop("body"))
    if name == "comments":
        return bound_comments(t("conversations"))
    if name == "doc_artifacts":
        return document_artifacts(t("documents"))
    if name == "chunk_store":
        from ..operators.embedding import embed_chunks
        from ..operators.retrieval import chunk_artifacts
        return stored(spark, sf_dir, "chunk-store", lambda: embed_chunks(chunk_artifacts(document_artifacts(t("documents")))))
    if name == "postings":
        from ..operators.fulltext import build_lists
        return stored(spark, sf_dir, "postings", lambda: build_lists(load(spark, sf_dir, "chunk_store")))
    if name == "stemmed_postings":
        from ..operators.fulltext import build_lists
        return stored(spark, sf_dir, "stemmed-postings", lambda: build_lists(load(spark, sf_dir, "chunk_store"), stem=True))
    if name == "directory":
        from ..operators.fulltext import build_directory
        return stored(spark, sf_dir, "directory", lambda: build_directory(load(spark, sf_dir, "chunk_store")))
    if name == "early_chunks":
        return spark.read.parquet(early_chunks(spark, sf_dir))
    if name == "queries":
        return search_queries(t("benchmark"))
    if name == "anomalies":
        return bound_anomalies(load(spark, sf_dir, "scored_checks"))
    if name == "scored_checks":
        return stored(spark, sf_dir, "scored-checks", lambda: scored_checks(load(spark, sf_dir, "daily")))
    if name == "reports":
        return bound_reports(t("documents"))
    if name == "stored_reports":
        return stored_reports(t("documents"))
    if name == "cases":
        return bound_cases(load(spark, sf_dir, "scored_checks"))
    raise KeyError(name)
