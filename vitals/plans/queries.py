"""Registered queries: name -> (Spark builder, DuckDB oracle SQL or None).

Each Spark builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over
the whole provided tables. Doubles are rounded to 6 places on both sides so
the comparison is not thrown by summation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.integrity import RULES
from ..sources import bindings as B
from ..sources import tables as _tables
from . import oracle as O

WINDOW_END = "2024-01-30"
BACKFILL_FIRST, BACKFILL_LAST = O.BACKFILL_FIRST, O.BACKFILL_LAST
LOW_Z = B.LOW_Z
DP = 6

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, oracle_sql: str | None):
    def deco(fn: Builder) -> Builder:
        REGISTRY[name] = (fn, oracle_sql)
        return fn
    return deco


def rounded(df: DataFrame, dp: int = DP) -> DataFrame:
    """Round every double column (top level) to ``dp`` places."""
    return df.select(*[
        F.round(F.col(f.name), dp).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        else F.col(f.name) for f in df.schema.fields])


def _daily(spark, sf):
    """The stored ``repo_metrics_daily`` table (the roll-up job's output)."""
    return B.load(spark, sf, "daily")


# ============================================================================ metrics

@register("daily_metrics", O.sql(
    "SELECT repo_name, date, star_count, fork_count, issue_opened, issue_closed, pr_opened, "
    "pr_merged, round(pr_median_merge_hours, 6) AS pr_median_merge_hours, commit_count "
    "FROM daily_metrics", "daily_metrics"))
def q_daily_metrics(spark, sf):
    from ..operators.metrics import daily_metrics
    return rounded(daily_metrics(B.load(spark, sf, "events")))


@register("event_date_range", O.sql(
    "SELECT repo_name, min(CAST(created_at AS DATE)) AS first_date, max(CAST(created_at AS DATE)) AS last_date "
    "FROM bound_events GROUP BY repo_name", "bound_events"))
def q_event_date_range(spark, sf):
    from ..operators.metrics import event_date_range
    return event_date_range(B.load(spark, sf, "events"))


@register("pr_cycles", O.sql(
    "SELECT repo_name, close_date, round(median_hours, 6) AS median_hours, n_pairs FROM pr_cycles",
    "pr_cycles"))
def q_pr_cycles(spark, sf):
    from ..operators.metrics import pr_cycles
    return rounded(pr_cycles(B.load(spark, sf, "events")))


# ============================================================================ detection

_AUDIT_COLS = ("repo_name, anomaly_type, metric_name, window_start, window_end, n_prior, n_recent, "
               "round(baseline_value, 6) AS baseline_value, round(mad, 6) AS mad, "
               "round(observed_value, 6) AS observed_value, round(z_score, 6) AS z_score, status")


@register("metric_series", O.sql(
    f"SELECT repo_name, anomaly_type, metric_name, date, round(value, 6) AS value, "
    f"CASE WHEN date <= {O.shift(WINDOW_END, -7)} THEN 'prior' ELSE 'recent' END AS side "
    f"FROM metric_long WHERE date BETWEEN {O.shift(WINDOW_END, -34)} AND {O.d(WINDOW_END)}",
    "metric_long"))
def q_metric_series(spark, sf):
    from ..operators.detect import metric_series
    s = metric_series(_daily(spark, sf), WINDOW_END)
    return rounded(s.select("repo_name", "anomaly_type", "metric_name", "date", "value", "side"))


@register("detection_audit", O.detection_sql(
    WINDOW_END, 3.5, "SELECT " + _AUDIT_COLS + " FROM audit2"))
def q_detection_audit(spark, sf):
    from ..operators.detect import detection_audit
    return rounded(detection_audit(_daily(spark, sf), WINDOW_END, 3.5))


@register("mad_zscore", O.detection_sql(
    WINDOW_END, 3.5, "SELECT repo_name, anomaly_type, round(z_score, 6) AS z_score FROM audit2"))
def q_mad_zscore(spark, sf):
    from ..operators.detect import detection_audit
    a = detection_audit(_daily(spark, sf), WINDOW_END, 3.5)
    return rounded(a.select("repo_name", "anomaly_type", "z_score"))


@register("detect_anomalies", O.detection_sql(
    WINDOW_END, LOW_Z,
    "SELECT repo_name, anomaly_type, window_start, window_end, metric_name, "
    "round(baseline_value, 6) AS baseline_value, round(observed_value, 6) AS observed_value, "
    "round(z_score, 6) AS z_score FROM audit2 WHERE status = 'anomaly'"))
def q_detect_anomalies(spark, sf):
    from ..operators.detect import detect_anomalies
    return rounded(detect_anomalies(_daily(spark, sf), WINDOW_END, LOW_Z))


@register("detect_backfill", O.backfill_sql(
    3.5, "SELECT " + _AUDIT_COLS + " FROM backfill"))
def q_detect_backfill(spark, sf):
    from ..operators.detect import detect_backfill
    return rounded(detect_backfill(_daily(spark, sf), BACKFILL_FIRST, BACKFILL_LAST, 3.5))


# ============================================================================ ingest

def _events(spark, sf):
    return B.load(spark, sf, "events")


_WATCH_SQL = ", ".join(f"'{r}'" for r in ["org/repo0", "org/repo3", "org/repo7"])
_EV_COLS = "id, type, repo_name, actor_login, created_at, action, number"


@register("ingest_scan", O.sql(f"SELECT {_EV_COLS} FROM bound_events", "bound_events"))
def q_ingest_scan(spark, sf):
    """Round trip: archive-shaped JSON lines (gzip, per day/hour) -> scan -> normalise."""
    from ..operators.ingest import normalize_events, payload_fields
    from ..session import scratch_path
    from ..sources.event_files import read_event_lines, write_event_lines
    path = scratch_path(spark, "event-lines")
    write_event_lines(B.raw_events(_tables.table(spark, sf, "events")), path)
    ev = normalize_events(read_event_lines(spark, path))
    return payload_fields(ev, keep=("actor_login",)).select(
        "id", "type", "repo_name", "actor_login", "created_at", "action", "number")


@register("reingest", O.sql(f"SELECT {_EV_COLS} FROM bound_events", "bound_events"))
def q_reingest(spark, sf):
    """Filtered event files read again over a table that lost its odd ids: every event once."""
    from ..operators.ingest import payload_fields, reingest
    from ..session import scratch_path
    from ..sources.event_files import write_event_lines
    path = scratch_path(spark, "event-lines-again")
    write_event_lines(B.raw_events(_tables.table(spark, sf, "events")), path)
    left = _events(spark, sf).where(F.col("id").cast("long") % 2 == 0)
    return payload_fields(reingest(spark, path, left), keep=("actor_login",)).select(
        "id", "type", "repo_name", "actor_login", "created_at", "action", "number")


@register("watchlist_filter", O.sql(
    f"SELECT id, type, repo_name FROM bound_events WHERE repo_name IN ({_WATCH_SQL})", "bound_events"))
def q_watchlist_filter(spark, sf):
    from ..operators.ingest import WATCHED_REPOS, watchlist_filter
    return watchlist_filter(_events(spark, sf), WATCHED_REPOS).select("id", "type", "repo_name")


@register("normalize_events", O.sql(f"SELECT {_EV_COLS}, merged FROM bound_events", "bound_events"))
def q_normalize_events(spark, sf):
    from ..operators.ingest import normalize_events, payload_fields
    ev = normalize_events(B.raw_events(_tables.table(spark, sf, "events")))
    return payload_fields(ev, keep=("actor_login",)).select(
        "id", "type", "repo_name", "actor_login", "created_at", "action", "number", "merged")


@register("json_paths", O.sql(
    "SELECT id, type, repo_name, created_at, action, number, merged, release_tag, "
    "'Release ' || release_tag AS release_name, "
    "left(repeat('Notes for ' || release_tag || '. ', 30), 300) AS release_notes FROM bound_events",
    "bound_events"))
def q_json_paths(spark, sf):
    from ..operators.ingest import payload_fields
    return payload_fields(_events(spark, sf))


@register("upsert_ignore", O.sql(
    "SELECT id, CASE WHEN created_at < TIMESTAMP '2024-01-16 00:00:00' THEN actor_login "
    "ELSE 'late-' || actor_login END AS actor_login, created_at FROM bound_events", "bound_events"))
def q_upsert_ignore(spark, sf):
    """Existing rows (before Jan 16) win over a re-delivered batch (from Jan 10);
    inside the batch the earlier delivery wins over a later duplicate."""
    from ..operators.upsert import upsert_ignore
    ev = _events(spark, sf).select("id", "actor_login", "created_at")
    target = ev.filter(F.col("created_at") < F.lit("2024-01-16 00:00:00"))
    late = ev.filter(F.col("created_at") >= F.lit("2024-01-10 00:00:00"))
    batch = (late.select("id", F.concat(F.lit("late-"), "actor_login").alias("actor_login"),
                         "created_at", F.lit(0).alias("delivery"))
             .unionByName(late.filter(F.col("created_at") >= F.lit("2024-01-20 00:00:00"))
                          .select("id", F.concat(F.lit("later-"), "actor_login").alias("actor_login"),
                                  "created_at", F.lit(1).alias("delivery"))))
    return upsert_ignore(target, batch, ["id"], ["delivery"]).select("id", "actor_login", "created_at")


@register("upsert_replace", O.sql(
    "SELECT repo_name, date, star_count, fork_count, issue_opened, issue_closed, pr_opened, "
    "pr_merged, round(pr_median_merge_hours, 6) AS pr_median_merge_hours, commit_count "
    "FROM daily_metrics", "daily_metrics"))
def q_upsert_replace(spark, sf):
    """A roll-up taken mid-day on Jan 20 is refreshed by a re-aggregation of
    Jan 20..30: the result equals a full roll-up."""
    from ..operators.metrics import daily_metrics
    from ..operators.upsert import upsert_replace
    ev = _events(spark, sf)
    target = daily_metrics(ev.filter(F.col("created_at") < F.lit("2024-01-20 12:00:00")))
    batch = daily_metrics(ev, "2024-01-20", "2024-01-30")
    return rounded(upsert_replace(target, batch, ["repo_name", "date"]))


O.artifacts_cte("artifacts_v1", "2024-01-20 00:00:00")


@register("upsert_partial", O.sql(
    "SELECT v2.artifact_id, v2.repo_name, v2.type, v2.number, "
    "CASE WHEN v1.number IS NULL THEN '[v2] ' || v2.title ELSE v1.title END AS title, "
    "v2.body || ' [refetched]' AS body, v2.state, "
    "coalesce(v1.author_login, v2.author_login) AS author_login, "
    "CASE WHEN v1.number IS NULL THEN v2.created_at ELSE v1.created_at END AS created_at, "
    "v2.closed_at, v2.url, TIMESTAMP '2024-01-31 00:00:00' AS fetched_at "
    "FROM bound_artifacts v2 LEFT JOIN artifacts_v1 v1 USING (repo_name, type, number)",
    "bound_artifacts", "artifacts_v1"))
def q_upsert_partial(spark, sf):
    """Two fetches of the PR artifacts (Jan 20 and Jan 31): body, state and
    closed_at follow the later fetch; title, author, created_at, url stay."""
    from ..operators.upsert import upsert_partial
    ev, docs = _tables.table(spark, sf, "events"), _tables.table(spark, sf, "documents")
    cols = ["artifact_id", "repo_name", "type", "number", "title", "body", "state",
            "author_login", "created_at", "closed_at", "url"]
    v1 = (B.bound_artifacts(ev.filter(F.col("ts") < F.lit("2024-01-20 00:00:00")), docs).select(*cols)
          .withColumn("fetched_at", F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")))
    v2 = (B.bound_artifacts(ev, docs).select(*cols)
          .withColumn("title", F.concat(F.lit("[v2] "), "title"))
          .withColumn("body", F.concat("body", F.lit(" [refetched]")))
          .withColumn("fetched_at", F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")))
    return upsert_partial(v1.unionByName(v2), ["repo_name", "type", "number"], "fetched_at",
                          ["body", "state", "closed_at"])


_CAL_SQL = ("SELECT CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour FROM ("
            "SELECT unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00', "
            "TIMESTAMP '2024-01-31 23:00:00', INTERVAL 1 HOUR)) AS ts)")
_KEPT_SQL = (f"SELECT CAST(created_at AS DATE) AS date, CAST(hour(created_at) AS INTEGER) AS hour, "
             f"count(*) AS events_kept FROM bound_events WHERE repo_name IN ({_WATCH_SQL}) GROUP BY 1, 2")


@register("ingest_coverage", O.sql(
    f"SELECT c.date, c.hour, coalesce(k.events_kept, 0) AS events_kept, "
    f"k.events_kept IS NOT NULL AS ingested FROM ({_CAL_SQL}) c "
    f"LEFT JOIN ({_KEPT_SQL}) k USING (date, hour)", "bound_events"))
def q_ingest_coverage(spark, sf):
    from ..operators.ingest import WATCHED_REPOS, ingest_coverage, watchlist_filter
    ev = watchlist_filter(_events(spark, sf), WATCHED_REPOS)
    return ingest_coverage(spark, ev, "2024-01-01", "2024-01-31")


@register("missing_hours", O.sql(
    f"SELECT c.date, c.hour FROM ({_CAL_SQL}) c ANTI JOIN ({_KEPT_SQL}) k USING (date, hour)",
    "bound_events"))
def q_missing_hours(spark, sf):
    from ..operators.ingest import WATCHED_REPOS, missing_hours, watchlist_filter
    ev = watchlist_filter(_events(spark, sf), WATCHED_REPOS)
    return missing_hours(spark, ev, "2024-01-01", "2024-01-31")


# ============================================================================ artifacts

def _anoms(spark, sf):
    return B.load(spark, sf, "anomalies")


def _artifacts(spark, sf):
    return B.load(spark, sf, "artifacts")


def _rank_sql(inner: str, part: str, order: str, k: int, cols: str) -> str:
    return (f"SELECT {cols} FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {part} ORDER BY {order}) "
            f"AS BIGINT) AS rank FROM ({inner})) WHERE rank <= {k}")


@register("slow_prs", O.sql(_rank_sql(
    "SELECT a.id AS anomaly_id, g.number, left(g.title, 80) AS title, "
    "round(date_diff('microsecond', g.created_at, g.closed_at) / 3.6e9) AS hours_open, "
    "CAST(g.created_at AS DATE) AS opened, CAST(g.closed_at AS DATE) AS closed, g.url "
    "FROM bound_anomalies a JOIN bound_artifacts g ON g.repo_name = a.repo_name "
    "AND CAST(g.closed_at AS DATE) BETWEEN a.window_start AND a.window_end "
    "WHERE a.anomaly_type = 'pr_slowdown'",
    "anomaly_id", "hours_open DESC NULLS LAST, number", 10,
    "anomaly_id, rank, number, title, hours_open, opened, closed, url"),
    "bound_anomalies", "bound_artifacts"))
def q_slow_prs(spark, sf):
    from ..operators.artifacts import slow_prs
    a = _anoms(spark, sf).filter(F.col("anomaly_type") == "pr_slowdown")
    return slow_prs(a, _artifacts(spark, sf), 10)


@register("release_lookup", O.sql(_rank_sql(
    "SELECT a.id AS anomaly_id, e.created_at, CAST(e.created_at AS DATE) AS release_date, "
    "e.release_tag AS tag, 'Release ' || e.release_tag AS release_name, "
    "left(repeat('Notes for ' || e.release_tag || '. ', 30), 300) AS notes "
    "FROM bound_anomalies a JOIN bound_events e ON e.repo_name = a.repo_name "
    "AND e.type = 'ReleaseEvent' AND CAST(e.created_at AS DATE) >= a.window_start",
    "anomaly_id", "created_at DESC, tag", 10,
    "anomaly_id, rank, release_date, tag, release_name, notes"),
    "bound_anomalies", "bound_events"))
def q_release_lookup(spark, sf):
    from ..operators.artifacts import release_lookup
    return release_lookup(_anoms(spark, sf), _events(spark, sf), 10)


@register("enrichment_candidates", O.sql(_rank_sql(
    "SELECT * FROM cand", "repo_name, window_start, window_end", "number DESC", 30,
    "repo_name, window_start, window_end, number, rank"), "cand"))
def q_enrichment_candidates(spark, sf):
    from ..operators.artifacts import enrichment_candidates
    return enrichment_candidates(_anoms(spark, sf), _events(spark, sf), _artifacts(spark, sf), 30)


@register("artifact_text", O.sql(
    "SELECT g.artifact_id, g.repo_name, g.number, "
    "'PR #' || CAST(g.number AS VARCHAR) || ': ' || coalesce(g.title, 'None') || chr(10) || chr(10) || "
    "CASE WHEN coalesce(g.body, '') = '' THEN '(no description)' ELSE g.body END || "
    "CASE WHEN c.n_c > 0 THEN chr(10) || chr(10) || '---' || chr(10) || 'Discussion comments:' || "
    "CASE WHEN c.lines IS NOT NULL THEN chr(10) || c.lines ELSE '' END ELSE '' END AS text "
    "FROM bound_artifacts g LEFT JOIN comments_agg c USING (artifact_id)",
    "bound_artifacts", "comments_agg"))
def q_artifact_text(spark, sf):
    from ..operators.artifacts import artifact_text
    return artifact_text(_artifacts(spark, sf), B.load(spark, sf, "comments"))


_STRIPPED = "length(regexp_replace(coalesce(body, ''), '^\\s+|\\s+$', '', 'g'))"


@register("unembedded_artifacts", O.sql(_rank_sql(
    "SELECT artifact_id, repo_name, number FROM bound_artifacts WHERE artifact_id NOT IN ("
    "SELECT artifact_id FROM bound_artifacts WHERE created_at < TIMESTAMP '2024-01-15 00:00:00' "
    f"AND {_STRIPPED} > 0)", "repo_name", "number DESC", 100,
    "artifact_id, repo_name, number, rank"), "bound_artifacts"))
def q_unembedded_artifacts(spark, sf):
    """Chunk store = artifacts embedded by a run on Jan 15; the rest is due."""
    from ..operators.artifacts import unembedded_artifacts
    return unembedded_artifacts(_artifacts(spark, sf), B.load(spark, sf, "early_chunks"), 100)


@register("unenriched_windows", O.sql(
    "SELECT DISTINCT a.repo_name, a.window_start, a.window_end FROM bound_anomalies a "
    "WHERE NOT EXISTS (SELECT 1 FROM artifacts_v1 g WHERE g.repo_name = a.repo_name "
    "AND CAST(g.created_at AS DATE) BETWEEN a.window_start AND a.window_end)",
    "bound_anomalies", "artifacts_v1"))
def q_unenriched_windows(spark, sf):
    """Artifact store = the enrichment fetch of Jan 20."""
    from ..operators.artifacts import unenriched_windows
    ev, docs = _tables.table(spark, sf, "events"), _tables.table(spark, sf, "documents")
    snap = B.bound_artifacts(ev.filter(F.col("ts") < F.lit("2024-01-20 00:00:00")), docs)
    return unenriched_windows(_anoms(spark, sf), snap)


@register("investigation_queue", O.sql(
    "SELECT id, repo_name, anomaly_type, z_score FROM bound_anomalies "
    "WHERE id NOT IN (SELECT anomaly_id FROM bound_reports) ORDER BY z_score DESC, id LIMIT 5",
    "bound_anomalies", "bound_reports"))
def q_investigation_queue(spark, sf):
    from ..operators.artifacts import investigation_queue
    return investigation_queue(_anoms(spark, sf), B.load(spark, sf, "reports"), 5)


# ============================================================================ retrieval

def _doc_chunks(spark, sf):
    from ..operators.retrieval import chunk_artifacts
    return chunk_artifacts(B.load(spark, sf, "doc_artifacts"))


def _chunk_vecs(spark, sf):
    """The stored chunk table, a vector per chunk (built once per session)."""
    return B.load(spark, sf, "chunk_store")


def _index(spark, sf):
    return {"lists": B.load(spark, sf, "postings"), "directory": B.load(spark, sf, "directory")}


_VECTOR_SQL = ("CAST(len(embedding) AS INTEGER) AS dim, round(sqrt(list_dot_product(embedding, embedding)), 4) AS norm, "
               "array_to_string(list_transform(embedding, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ' ') AS vector")


def _vector_columns():
    whole = F.transform("embedding", lambda x: x.cast("long").cast("string"))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0).cast("double"), lambda s, x: s + x * x))
    return F.size("embedding").alias("dim"), F.round(norm, 4).alias("norm"), F.array_join(whole, " ").alias("vector")


@register("chunk_documents", O.sql(
    "SELECT artifact_id, chunk_index, text, repo_name, artifact_type, artifact_url FROM doc_chunks",
    "doc_chunks"))
def q_chunk_documents(spark, sf):
    return _doc_chunks(spark, sf)


@register("embed_chunks", O.sql(
    f"SELECT artifact_id, chunk_index, {_VECTOR_SQL} FROM chunk_vectors", "chunk_vectors"))
def q_embed_chunks(spark, sf):
    """Built-in hashing embedder over every chunk (the pluggable hook)."""
    from ..operators.embedding import embed_chunks
    return embed_chunks(_doc_chunks(spark, sf)).select("artifact_id", "chunk_index", *_vector_columns())


@register("embed_missing", O.sql(
    f"SELECT artifact_id, chunk_index, {_VECTOR_SQL} FROM art_vectors", "art_vectors"))
def q_embed_missing(spark, sf):
    """Two embedding runs, on Jan 15 and at the end: the second appends the artifacts that the store lacks."""
    from ..operators.embedding import append_missing
    from ..session import scratch_path
    path = scratch_path(spark, "artifact-chunks")
    art = _artifacts(spark, sf)
    append_missing(spark, art.where(F.col("created_at") < F.lit("2024-01-15 00:00:00")), path)
    return append_missing(spark, art, path).select("artifact_id", "chunk_index", *_vector_columns())


@register("vector_search", O.sql(
    "SELECT query_id, rank, artifact_url, artifact_id, chunk_index, round(dist, 6) AS dist, excerpt "
    "FROM v_ranked", "v_ranked"))
def q_vector_search(spark, sf):
    from ..operators.retrieval import vector_search
    r = vector_search(B.load(spark, sf, "queries"), _chunk_vecs(spark, sf), 20)
    return rounded(r.select("query_id", "rank", "artifact_url", "artifact_id", "chunk_index", "dist",
                            "excerpt"))


@register("text_search", O.sql(
    "SELECT query_id, rank, artifact_url, artifact_id, chunk_index, round(score, 6) AS score, excerpt "
    "FROM t_ranked", "t_ranked"))
def q_text_search(spark, sf):
    from ..operators.retrieval import text_search
    r = text_search(B.load(spark, sf, "queries"), _chunk_vecs(spark, sf), 20, **_index(spark, sf))
    return rounded(r.select("query_id", "rank", "artifact_url", "artifact_id", "chunk_index", "score",
                            "excerpt"))


@register("text_search_any", O.sql(
    "SELECT query_id, rank, artifact_url, artifact_id, chunk_index, round(score, 6) AS score, excerpt "
    "FROM a_ranked", "a_ranked"))
def q_text_search_any(spark, sf):
    """The same searches with ``or`` between all terms: chunks with any of them."""
    from ..operators.retrieval import text_search
    q = B.load(spark, sf, "queries").withColumn("query_text", F.replace("query_text", F.lit(" "), F.lit(" or ")))
    r = text_search(q, _chunk_vecs(spark, sf), 20, **_index(spark, sf))
    return rounded(r.select("query_id", "rank", "artifact_url", "artifact_id", "chunk_index", "score",
                            "excerpt"))


@register("text_search_lists", O.sql(
    "SELECT query_id, count(*) AS n_lists, count(*) FILTER (WHERE feasible) AS n_read FROM ("
    "SELECT l.query_id, l.term, l.repo_name, l.block, bool_or(f.query_id IS NOT NULL) AS feasible FROM ("
    "SELECT DISTINCT q.query_id, q.term, p.repo_name, p.artifact_id // 1024 AS block FROM q_terms q "
    "JOIN c_post p ON p.term = q.term AND p.repo_name = q.repo_name) l LEFT JOIN ("
    "SELECT query_id, block FROM (SELECT DISTINCT q.query_id, q.term, p.artifact_id // 1024 AS block FROM q_terms q "
    "JOIN c_post p ON p.term = q.term AND p.repo_name = q.repo_name) JOIN q_n USING (query_id) "
    "GROUP BY query_id, block HAVING count(*) = any_value(n_terms)) f ON f.query_id = l.query_id AND f.block = l.block "
    "GROUP BY 1, 2, 3, 4) GROUP BY query_id", "q_terms", "c_post", "q_n"))
def q_text_search_lists(spark, sf):
    """What ``text_search`` reads of the index: postings lists of the queries' terms, and those it needs."""
    from ..operators.fulltext import lists_read
    return lists_read(B.load(spark, sf, "queries"), **_index(spark, sf))


@register("text_search_stems", None)
def q_text_search_stems(spark, sf):
    """The searches over English stems: chunks with an inflection of any term."""
    from ..operators.retrieval import text_search
    q = B.load(spark, sf, "queries").withColumn("query_text", F.replace("query_text", F.lit(" "), F.lit(" or ")))
    r = text_search(q, _chunk_vecs(spark, sf), 20, stem=True,
                    lists=B.load(spark, sf, "stemmed_postings"), directory=B.load(spark, sf, "directory"))
    return rounded(r.select("query_id", "rank", "artifact_url", "artifact_id", "chunk_index", "score", "excerpt"))


@register("hybrid_search", O.sql(_rank_sql(
    "SELECT coalesce(v.query_id, t.query_id) AS query_id, "
    "coalesce(v.artifact_url, t.artifact_url) AS artifact_url, coalesce(v.excerpt, t.excerpt) AS excerpt, "
    "coalesce(CAST(1.0 AS DOUBLE) / (60.0 + v.rank), 0.0) + coalesce(CAST(1.0 AS DOUBLE) / (60.0 + t.rank), 0.0) "
    "AS rrf_score, v.rank AS v_rank, t.rank AS t_rank "
    "FROM v_ranked v FULL OUTER JOIN t_ranked t ON v.query_id = t.query_id AND v.artifact_url = t.artifact_url",
    "query_id", "rrf_score DESC, artifact_url", 5,
    "query_id, rank, artifact_url, round(rrf_score, 6) AS rrf_score, v_rank, t_rank, excerpt"),
    "v_ranked", "t_ranked"))
def q_hybrid_search(spark, sf):
    from ..operators.retrieval import hybrid_search
    r = hybrid_search(B.load(spark, sf, "queries"), _chunk_vecs(spark, sf), 5, **_index(spark, sf))
    return rounded(r.select("query_id", "rank", "artifact_url", "rrf_score", "v_rank", "t_rank", "excerpt"))


@register("render_hits", O.sql(
    "SELECT query_id, string_agg(printf('[score=%.4f] %s', rrf_score, artifact_url) || chr(10) || coalesce(excerpt, ''), "
    "chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS text FROM ("
    + O.hybrid_sql("", 5, "query_id, rank, artifact_url, excerpt, rrf_score") + ") GROUP BY query_id",
    "v_ranked", "t_ranked"))
def q_render_hits(spark, sf):
    from ..operators.retrieval import hybrid_search, render_hits
    return render_hits(hybrid_search(B.load(spark, sf, "queries"), _chunk_vecs(spark, sf), 5, **_index(spark, sf)))


@register("ann_recall", None)
def q_ann_recall(spark, sf):
    """recall@10 of search by product-quantised codes against exact search, and the share ranked exactly, per query."""
    from ..operators.vectors import ann_recall
    return rounded(ann_recall(B.load(spark, sf, "queries"), _chunk_vecs(spark, sf), 10))


# ============================================================================ reports and feed

def _reports(spark, sf):
    return B.load(spark, sf, "reports")


def _citations(spark, sf):
    from ..operators.reports import flatten_citations
    return flatten_citations(_reports(spark, sf))


def _latest(spark, sf):
    from ..operators.reports import latest_reports
    return latest_reports(_reports(spark, sf), _anoms(spark, sf))


def _feed(spark, sf):
    from ..operators.reports import report_feed
    return report_feed(_latest(spark, sf), _citations(spark, sf))


_FEED_COLS = ("id, anomaly_id, repo, anomaly_type, window_start, window_end, metric_name, baseline, observed, "
              "z_score, confidence, summary, root_cause, citations_count, tool_calls, duration_s, created_at")


@register("report_contract", O.sql(
    "SELECT id, anomaly_id, summary IS NULL AS missing_fields, "
    "(confidence IS NULL OR confidence NOT IN ('high', 'medium', 'low')) AS bad_confidence, "
    "false AS bad_citation_type, (len(evidence) > 0 AND n_citations = 0) AS uncited_evidence, "
    "NOT (summary IS NULL OR confidence IS NULL OR confidence NOT IN ('high', 'medium', 'low') "
    "OR (len(evidence) > 0 AND n_citations = 0)) AS valid FROM bound_reports", "bound_reports"))
def q_report_contract(spark, sf):
    from ..operators.reports import report_contract
    return report_contract(_reports(spark, sf))


@register("artifact_labels", O.sql(
    "SELECT artifact_id, CASE WHEN doc.doc_id IS NULL THEN '[]' ELSE '[\"' || doc.lang || '\",\"' || doc.source || '\"]' END AS labels "
    "FROM bound_artifacts g LEFT JOIN documents doc ON doc.doc_id = g.artifact_id", "bound_artifacts"))
def q_artifact_labels(spark, sf):
    """Label objects of the artifacts as a JSON array of their names."""
    return _artifacts(spark, sf).select("artifact_id", "labels")


@register("golden_cases", O.sql(
    "SELECT id, repo_name AS repo, anomaly_type, metric_name, window_start, window_end, "
    "array_to_string(expected_evidence_urls, ' ') AS expected_urls, array_to_string(expected_confidences, ' ') AS confidences, "
    "z_score, baseline_value, observed_value FROM bound_cases", "bound_cases"))
def q_golden_cases(spark, sf):
    """The golden cases written as multi-line JSON arrays, one per file, and read back by the golden-case source."""
    from ..session import scratch_path
    from ..sources.event_files import read_golden_cases, write_golden_cases
    path = scratch_path(spark, "golden-cases")
    write_golden_cases(_cases(spark, sf).drop("anomaly_ref"), path)
    return read_golden_cases(spark, path).select(
        "id", "repo", "anomaly_type", "metric_name", "window_start", "window_end",
        F.array_join("expected_evidence_urls", " ").alias("expected_urls"),
        F.array_join("expected_confidences", " ").alias("confidences"), "z_score", "baseline_value", "observed_value")


@register("feed_order", O.sql(
    "SELECT row_number() OVER (ORDER BY window_end DESC, anomaly_id) AS place, id, anomaly_id, window_end FROM feed", "feed"))
def q_feed_order(spark, sf):
    """The feed as its sink stores it: part files in order, and a place per line counted along them."""
    from ..operators.reports import read_feed_order, write_feed
    from ..session import scratch_path
    path = scratch_path(spark, "feed")
    feed = _feed(spark, sf)
    write_feed(feed, path)
    return read_feed_order(spark, path, feed.schema).select("place", "id", "anomaly_id", "window_end")


@register("flatten_citations", O.sql(
    "SELECT report_id, anomaly_id, pos, citation_type, source_url, excerpt FROM bound_citations",
    "bound_citations"))
def q_flatten_citations(spark, sf):
    return _citations(spark, sf)


@register("stored_report_citations", O.sql(
    "SELECT r.id, r.anomaly_id, CASE WHEN r.id % 11 <> 7 THEN r.confidence END AS confidence, "
    "CASE WHEN r.id % 11 <> 7 THEN len(r.evidence) ELSE 0 END AS n_evidence, "
    "CASE WHEN r.id % 11 <> 7 THEN array_to_string(r.evidence, chr(10)) ELSE '' END AS evidence_text, "
    "c.pos, c.citation_type, c.source_url, c.excerpt "
    "FROM bound_reports r LEFT JOIN bound_citations c ON c.report_id = r.id AND c.citation_type IS NOT NULL "
    "AND r.id % 11 <> 7",
    "bound_reports", "bound_citations"))
def q_stored_report_citations(spark, sf):
    from ..operators.reports import flatten_citations, parse_reports
    parsed = parse_reports(B.load(spark, sf, "stored_reports"))
    head = parsed.select(F.col("id").alias("report_id"), "confidence", F.size("evidence").cast("long").alias("n_evidence"),
                         F.array_join("evidence", "\n").alias("evidence_text"))
    return flatten_citations(parsed).join(head, "report_id").withColumnRenamed("report_id", "id")


@register("latest_reports", O.sql(
    "SELECT id, anomaly_id, created_at, confidence, repo_name, anomaly_type, window_end, z_score FROM latest",
    "latest"))
def q_latest_reports(spark, sf):
    return _latest(spark, sf).select("id", "anomaly_id", "created_at", "confidence", "repo_name",
                                     "anomaly_type", "window_end", "z_score")


@register("report_feed", O.sql(f"SELECT {_FEED_COLS} FROM feed", "feed"))
def q_report_feed(spark, sf):
    return _feed(spark, sf)


@register("report_detail", O.sql(
    "SELECT l.id, l.repo_name AS repo, l.anomaly_type, l.window_start, l.window_end, l.metric_name, "
    "round(coalesce(l.baseline_value, 0.0), 1) AS baseline, round(coalesce(l.observed_value, 0.0), 1) AS observed, "
    "round(coalesce(l.z_score, 0.0), 2) AS z_score, l.summary, l.root_cause, l.confidence, "
    "array_to_string(l.evidence, chr(10)) AS evidence_text, coalesce(c.n, 0) AS n_citations, "
    "coalesce(c.urls, '') AS citation_urls, l.limitations, l.tool_calls_used AS tool_calls, "
    "round(coalesce(l.duration_seconds, 0.0), 1) AS duration_s, l.created_at "
    "FROM latest l LEFT JOIN (SELECT report_id, count(*) AS n, string_agg(source_url, ' ' ORDER BY pos) AS urls "
    "FROM bound_citations WHERE citation_type IS NOT NULL GROUP BY 1) c ON c.report_id = l.id",
    "latest", "bound_citations"))
def q_report_detail(spark, sf):
    from ..operators.reports import report_detail
    d = report_detail(_latest(spark, sf), _citations(spark, sf))
    return d.select(
        "id", "repo", "anomaly_type", "window_start", "window_end", "metric_name", "baseline", "observed",
        "z_score", "summary", "root_cause", "confidence",
        F.array_join("evidence", "\n").alias("evidence_text"), F.size("citations").cast("long").alias("n_citations"),
        F.array_join(F.transform("citations", lambda c: c["url"]), " ").alias("citation_urls"),
        "limitations", "tool_calls", "duration_s", "created_at")


_FMT = ("CASE WHEN {v} % 1 = 0 THEN CAST(CAST({v} AS BIGINT) AS VARCHAR) ELSE CAST(round({v}, 1) AS VARCHAR) END "
        "|| CASE metric_name WHEN 'pr_median_merge_hours' THEN 'h' WHEN 'issue_opened' THEN ' /day' "
        "WHEN 'star_count' THEN ' /day' ELSE '' END")
_OBS, _BASE = _FMT.format(v="observed"), _FMT.format(v="baseline")
_M = "(observed / baseline)"
_HM = "(CASE WHEN baseline > 0 THEN observed / baseline ELSE 0.0 END)"
_T = "CAST(CAST(round({x}) AS BIGINT) AS VARCHAR)"
_P = "CAST(CAST(round(({x}) * 100) AS BIGINT) AS VARCHAR)"
_MX = (f"(CASE WHEN {_HM} >= 2 THEN {_T.format(x=_HM)} || '×' "
       f"WHEN {_HM} > 1.05 THEN '+' || {_P.format(x=_HM + ' - 1')} || '%' ELSE '' END)")
_SHORT = "split_part(repo, '/', 2)"


@register("feed_cards", O.sql(
    "SELECT id, split_part(repo, '/', 1) AS owner, " + _SHORT + " AS name, "
    "CASE WHEN baseline IS NULL OR baseline = 0 THEN NULL "
    f"WHEN {_M} >= 2 THEN {_T.format(x=_M)} || '× normal' "
    f"WHEN {_M} > 1.1 THEN {_P.format(x=_M + ' - 1')} || '% above normal' "
    f"WHEN {_M} < 0.5 THEN {_T.format(x='1 / ' + _M)} || '× below normal' "
    f"WHEN {_M} < 0.9 THEN {_P.format(x='1 - ' + _M)} || '% below normal' "
    f"ELSE {_OBS} END AS change_label, "
    "CASE WHEN baseline IS NULL OR baseline = 0 THEN NULL "
    f"WHEN {_M} >= 2 OR {_M} > 1.1 OR {_M} < 0.9 THEN {_OBS} || ' vs ' || {_BASE} || ' typical' "
    f"ELSE 'vs ' || {_BASE} || ' typical' END AS change_detail, "
    "CASE WHEN baseline IS NULL OR baseline = 0 THEN '' "
    f"WHEN {_M} >= 2 THEN '↑' || {_T.format(x=_M)} || '×' WHEN {_M} > 1 THEN '↑' || {_P.format(x=_M + ' - 1')} || '%' "
    f"WHEN {_M} < 1 THEN '↓' || {_P.format(x='1 - ' + _M)} || '%' ELSE '' END AS delta, "
    "CASE anomaly_type "
    f"WHEN 'pr_slowdown' THEN CASE WHEN {_MX} <> '' THEN {_SHORT} || ': PR merge time was ' || {_MX} "
    f"|| ' slower than normal' ELSE {_SHORT} || ': PR merge time anomaly detected' END "
    f"WHEN 'issue_spike' THEN CASE WHEN {_MX} <> '' THEN {_SHORT} || ': issue rate spiked ' || {_MX} "
    f"|| ' above normal' ELSE {_SHORT} || ': unusual spike in new issues' END "
    f"WHEN 'star_spike' THEN CASE WHEN {_MX} <> '' THEN {_SHORT} || ': starred ' || {_MX} "
    f"|| ' more than usual this week' ELSE {_SHORT} || ': unusual star activity detected' END "
    f"ELSE {_SHORT} || ': ' || anomaly_type || ' detected' END AS headline, "
    "z_score > 5 AS high_severity FROM feed", "feed"))
def q_feed_cards(spark, sf):
    from ..operators.reports import feed_cards
    return feed_cards(_feed(spark, sf))


@register("feed_filtered", O.sql(
    f"SELECT {_FEED_COLS} FROM feed WHERE anomaly_type = 'pr_slowdown' AND confidence = 'high'", "feed"))
def q_feed_filtered(spark, sf):
    from ..operators.reports import feed_filtered
    return feed_filtered(_feed(spark, sf), anomaly_type="pr_slowdown", confidence="high")


@register("feed_stats", O.sql(
    "SELECT count(*) AS n_reports, count(DISTINCT repo) AS n_repos, min(window_start) AS first_window_start, "
    "max(window_end) AS last_window_end FROM feed", "feed"))
def q_feed_stats(spark, sf):
    from ..operators.reports import feed_stats
    return feed_stats(_feed(spark, sf))


@register("citation_view", O.sql(
    "SELECT report_id, pos, CASE citation_type WHEN 'sql_result' THEN 'Query' WHEN 'artifact_chunk' THEN "
    "'GitHub PR' WHEN 'release_note' THEN 'Release' ELSE citation_type END AS label, "
    "(source_url IS NOT NULL AND NOT starts_with(source_url, 'SQL')) AS is_link, "
    "CASE WHEN source_url IS NOT NULL AND NOT starts_with(source_url, 'SQL') THEN "
    "regexp_extract(source_url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^?#]*)', 1) "
    "ELSE coalesce(source_url, '') END AS short_url, left(excerpt, 100) AS excerpt "
    "FROM bound_citations WHERE citation_type IS NOT NULL", "bound_citations"))
def q_citation_view(spark, sf):
    from ..operators.reports import citation_view
    return citation_view(_citations(spark, sf))


# ============================================================================ evaluation

def _cases(spark, sf):
    return B.load(spark, sf, "cases")


@register("citation_coverage", O.sql(
    f"SELECT id AS case_id, anomaly_id, report_id, {O.COVERAGE_SQL} AS citation_coverage "
    "FROM resolved WHERE report_id IS NOT NULL", "resolved"))
def q_citation_coverage(spark, sf):
    from ..operators.evaluate import citation_coverage
    return citation_coverage(_cases(spark, sf), _anoms(spark, sf), _reports(spark, sf))


@register("eval_scores", O.sql("SELECT * FROM scores", "scores"))
def q_eval_scores(spark, sf):
    from ..operators.evaluate import eval_scores
    return eval_scores(_cases(spark, sf), _anoms(spark, sf), _reports(spark, sf))


@register("eval_results", O.sql("SELECT * FROM scores", "scores"))
def q_eval_results(spark, sf):
    """The scored cases as the eval-result sink stores them, read back."""
    from ..operators.evaluate import eval_scores, write_scores
    from ..session import scratch_path
    scores = eval_scores(_cases(spark, sf), _anoms(spark, sf), _reports(spark, sf))
    path = scratch_path(spark, "eval-results")
    write_scores(scores, path)
    return spark.read.schema(scores.schema).json(path)


@register("eval_summary", O.sql(
    "SELECT count(*) AS n_cases, round(avg(citation_coverage), 4) AS avg_citation_coverage, "
    "count(*) FILTER (WHERE budget_ok) AS budget_ok, count(*) FILTER (WHERE latency_ok) AS latency_ok, "
    "count(*) FILTER (WHERE confidence_match) AS confidence_match, round(avg(latency_s), 4) AS avg_latency_s "
    "FROM scores", "scores"))
def q_eval_summary(spark, sf):
    from ..operators.evaluate import eval_scores, eval_summary
    return eval_summary(eval_scores(_cases(spark, sf), _anoms(spark, sf), _reports(spark, sf)))


_NK = "a.repo_name = c.repo_name AND a.anomaly_type = c.anomaly_type AND a.window_start = c.window_start " \
      "AND a.window_end = c.window_end"


@register("ensure_anomalies", O.backfill_sql(
    LOW_Z,
    "SELECT repo_name, anomaly_type, window_start, window_end, metric_name, round(baseline_value, 6) AS "
    "baseline_value, round(observed_value, 6) AS observed_value, round(z_score, 6) AS z_score, "
    "false AS inserted FROM backfill WHERE status = 'anomaly' UNION ALL "
    "SELECT repo_name, anomaly_type, window_start, window_end, arg_min(metric_name, id), "
    "round(arg_min(baseline_value, id), 6), round(arg_min(observed_value, id), 6), "
    "round(arg_min(z_score, id), 6), true FROM bound_cases c WHERE NOT EXISTS (SELECT 1 FROM backfill a "
    f"WHERE a.status = 'anomaly' AND {_NK}) GROUP BY 1, 2, 3, 4", "bound_cases"))
def q_ensure_anomalies(spark, sf):
    """Anomalies detected in the data (every window end, z >= 1.5) plus a row
    for each golden case whose (repo, type, window) was not detected."""
    from ..operators.detect import detect_backfill
    from ..operators.evaluate import ensure_anomalies
    detected = detect_backfill(_daily(spark, sf), BACKFILL_FIRST, BACKFILL_LAST, LOW_Z) \
        .filter(F.col("status") == "anomaly")
    return rounded(ensure_anomalies(_cases(spark, sf), detected))


# ============================================================================ evidence

@register("evidence_bundle", O.sql(
    "SELECT a.id AS anomaly_id, 'metric' AS source, CAST(1 AS BIGINT) AS rank, 'sql_result' AS citation_type, "
    "'SQL: ' || a.metric_name || ' daily values ' || CAST(a.window_start AS VARCHAR) || '..' "
    "|| CAST(a.window_end AS VARCHAR) AS source_url, "
    "'baseline=' || CAST(round(a.baseline_value, 1) AS VARCHAR) || ' observed=' "
    "|| CAST(round(a.observed_value, 1) AS VARCHAR) || ' days=' || CAST(coalesce(s.n_days, 0) AS VARCHAR) "
    "|| ' window_mean=' || coalesce(CAST(round(s.mean, 2) AS VARCHAR), 'None') AS excerpt "
    "FROM bound_anomalies a LEFT JOIN (SELECT a.id, count(*) AS n_days, avg(m.value) AS mean "
    "FROM bound_anomalies a JOIN metric_long m ON m.repo_name = a.repo_name AND m.metric_name = a.metric_name "
    "AND m.date BETWEEN a.window_start AND a.window_end GROUP BY 1) s ON s.id = a.id "
    "UNION ALL SELECT anomaly_id, 'slow_pr', rank, 'artifact_chunk', url, 'PR #' || CAST(number AS VARCHAR) "
    "|| ' (' || coalesce(CAST(CAST(hours_open AS BIGINT) AS VARCHAR), 'None') || 'h open): ' "
    "|| coalesce(title, 'None') FROM slow WHERE anomaly_type = 'pr_slowdown' "
    "UNION ALL SELECT anomaly_id, 'release', rank, 'release_note', "
    "'https://github.com/' || repo_name || '/releases/tag/' || tag, left(notes, 100) FROM ("
    "SELECT a.id AS anomaly_id, e.repo_name, e.release_tag AS tag, "
    "left(repeat('Notes for ' || e.release_tag || '. ', 30), 300) AS notes, "
    "CAST(row_number() OVER (PARTITION BY a.id ORDER BY e.created_at DESC, e.release_tag) AS BIGINT) AS rank "
    "FROM bound_anomalies a JOIN bound_events e ON e.repo_name = a.repo_name AND e.type = 'ReleaseEvent' "
    "AND CAST(e.created_at AS DATE) BETWEEN a.window_start AND a.window_end) WHERE rank <= 10 "
    "UNION ALL SELECT query_id, 'search', rank, 'artifact_chunk', artifact_url, left(excerpt, 100) FROM ev_hits",
    "bound_anomalies", "metric_long", "slow", "bound_events", "ev_hits"))
def q_evidence_bundle(spark, sf):
    from ..operators.evidence import evidence_bundle
    return evidence_bundle(_anoms(spark, sf), _daily(spark, sf), B.load(spark, sf, "artifact_heads"), _events(spark, sf),
                           _chunk_vecs(spark, sf), **_index(spark, sf))


# ============================================================================ checks

_ADHOC = ("SELECT repo_name, date, star_count, pr_opened, round(pr_median_merge_hours, 1) AS pr_hours "
          "FROM repo_metrics_daily ORDER BY date DESC, repo_name LIMIT 100")


@register("adhoc_table_text", O.sql(
    "SELECT concat_ws(' | ', repo_name, CAST(date AS VARCHAR), CAST(star_count AS VARCHAR), "
    "CAST(pr_opened AS VARCHAR), coalesce(CAST(pr_hours AS VARCHAR), 'None')) AS line FROM ("
    "SELECT repo_name, date, star_count, pr_opened, round(pr_median_merge_hours, 1) AS pr_hours "
    "FROM daily_metrics ORDER BY date DESC, repo_name LIMIT 50)", "daily_metrics"))
def q_adhoc_table_text(spark, sf):
    """The ad-hoc SQL tool over ``repo_metrics_daily``: read-only gate, 50-row cap."""
    from ..operators.checks import adhoc_table_text
    return adhoc_table_text(spark, {"repo_metrics_daily": _daily(spark, sf)}, _ADHOC, 50)


@register("statement_audit", O.sql(
    "SELECT conv_id, turn, reason IS NULL AS is_safe, reason FROM (SELECT conv_id, turn, CASE "
    "WHEN NOT coalesce(regexp_matches(upper(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), "
    "'^[\\-– \\n]+', '')), '^(SELECT|WITH)([^\\p{L}\\p{N}_]|$)'), false) THEN 'not_select' "
    "WHEN coalesce(contains(text, ';'), false) THEN 'semicolon' END AS reason FROM conversations)"))
def q_statement_audit(spark, sf):
    """The read-only gate applied to every conversation turn as a candidate statement."""
    from ..operators.checks import statement_audit
    return statement_audit(_tables.table(spark, sf, "conversations"), "text", ["conv_id", "turn"])


_RULE_VIEWS = {
    "repos": "SELECT range + 1 AS id, 'org/repo' || CAST(range AS VARCHAR) AS name FROM range(0, 10)",
    "events": "bound_events", "repo_metrics_daily": "daily_metrics", "github_artifacts": "bound_artifacts",
    "artifact_chunks": "doc_chunks", "documents": "doc_artifacts", "anomalies": "bound_anomalies",
    "investigation_reports": "bound_reports", "report_citations": "bound_citations", "embeddings": "embeddings",
}


def _rule_sql(r) -> str:
    """The count of one rule in plain SQL, over the view of its table."""
    view = lambda t: f"({_RULE_VIEWS[t]})" if " " in _RULE_VIEWS[t] else _RULE_VIEWS[t]
    c = r.columns[0]
    if r.kind == "not_null":
        return f"SELECT count(*) AS n FROM {view(r.table)} WHERE {c} IS NULL"
    if r.kind == "check":
        return f"SELECT count(*) AS n FROM {view(r.table)} WHERE {c} NOT IN ({', '.join(repr(v) for v in r.values)})"
    if r.kind == "unique":
        known = " AND ".join(f"{x} IS NOT NULL" for x in r.columns)
        return (f"SELECT count(*) AS n FROM (SELECT 1 FROM {view(r.table)} WHERE {known} "
                f"GROUP BY {', '.join(r.columns)} HAVING count(*) > 1)")
    return (f"SELECT count(*) AS n FROM {view(r.table)} WHERE {c} IS NOT NULL AND {c} NOT IN "
            f"(SELECT {r.parent[1]} FROM {view(r.parent[0])} WHERE {r.parent[1]} IS NOT NULL)")


@register("constraint_violations", O.sql(" UNION ALL ".join(
    f"SELECT '{r.table}' AS table_name, '{r.name}' AS rule, CAST(n AS BIGINT) AS violations FROM ({_rule_sql(r)})"
    for r in RULES),
    "bound_events", "daily_metrics", "bound_artifacts", "doc_chunks", "doc_artifacts", "bound_anomalies",
    "bound_reports", "bound_citations"))
def q_constraint_violations(spark, sf):
    """All integrity rules over all tables, one scan per table; the chunks are those of the stored chunk table."""
    from ..operators.integrity import constraint_violations
    return constraint_violations({
        "repos": B.repos(spark), "events": _events(spark, sf), "repo_metrics_daily": _daily(spark, sf),
        "github_artifacts": _artifacts(spark, sf), "artifact_chunks": _chunk_vecs(spark, sf),
        "documents": B.load(spark, sf, "doc_artifacts"), "anomalies": _anoms(spark, sf),
        "investigation_reports": _reports(spark, sf), "report_citations": _citations(spark, sf),
        "embeddings": _tables.table(spark, sf, "embeddings")})


# ============================================================================ streaming

def _staged(spark, sf, name, first, second, job):
    from ..streaming.streams import staged_run
    raw = B.raw_events(_tables.table(spark, sf, "events"))
    return staged_run(spark, raw, name, first, second, job)


def _stream_events_out(spark, path):
    from ..operators.ingest import payload_fields
    from ..streaming.streams import EVENT_TABLE
    ev = spark.read.schema(EVENT_TABLE).parquet(path)
    return payload_fields(ev, keep=("actor_login",)).select(
        "id", "type", "repo_name", "actor_login", "created_at", "action", "number")


@register("stream_ingest", O.sql(f"SELECT {_EV_COLS} FROM bound_events", "bound_events"))
def q_stream_ingest(spark, sf):
    """File stream of daily archive files; a second delivery brings a late day
    (Jan 3) and a duplicate of Jan 10. Insert-if-absent per epoch."""
    from ..streaming.streams import day_is, ingest_stream
    p = _staged(spark, sf, "ingest", ~day_is("2024-01-03"), day_is("2024-01-03") | day_is("2024-01-10"),
                lambda p: ingest_stream(spark, p["glob"], p["out"], p["ckpt"]))
    return _stream_events_out(spark, p["out"])


@register("stream_dedup", O.sql("SELECT id, type, repo_name, created_at FROM bound_events", "bound_events"))
def q_stream_dedup(spark, sf):
    """De-duplication: the second delivery brings a new late day (Jan 3) and a
    day again (Jan 10); every event is kept once, the late ones too."""
    from ..streaming.streams import day_is, dedup_stream
    from ..schemas import EVENT
    p = _staged(spark, sf, "dedup", ~day_is("2024-01-03"), day_is("2024-01-03") | day_is("2024-01-10"),
                lambda p: dedup_stream(spark, p["glob"], p["out"], p["ckpt"]))
    return spark.read.schema(EVENT).parquet(p["out"]).select("id", "type", "repo_name", "created_at")


_COUNT_COLS = "repo_name, date, star_count, fork_count, issue_opened, issue_closed, pr_opened, pr_merged, commit_count"


@register("stream_window_counts", O.sql(f"SELECT {_COUNT_COLS} FROM daily_counts", "daily_counts"))
def q_stream_window_counts(spark, sf):
    """Day windows as state; the second delivery brings a new late day (Jan 3) and a day again (Jan 10)."""
    from ..streaming.streams import day_is, window_counts, window_counts_stream
    p = _staged(spark, sf, "wcounts", ~day_is("2024-01-03"), day_is("2024-01-03") | day_is("2024-01-10"),
                lambda p: window_counts_stream(spark, p["glob"], p["out"], p["ckpt"]))
    return window_counts(spark, p["out"]).select(*[c.strip() for c in _COUNT_COLS.split(",")])


@register("stream_daily_metrics", O.sql(
    "SELECT repo_name, date, star_count, fork_count, issue_opened, issue_closed, pr_opened, "
    "pr_merged, round(pr_median_merge_hours, 6) AS pr_median_merge_hours, commit_count "
    "FROM daily_metrics", "daily_metrics"))
def q_stream_daily_metrics(spark, sf):
    """Exact daily metrics from a stream where Jan 3 and Jan 5 arrive last
    (late) and Jan 10 comes again: each epoch refreshes only the dates that changed."""
    from ..streaming.streams import daily_metrics_stream, day_is
    late = day_is("2024-01-03") | day_is("2024-01-05")
    p = _staged(spark, sf, "dmetrics", ~late, late | day_is("2024-01-10"),
                lambda p: daily_metrics_stream(spark, p["glob"], p["out2"], p["out"], p["ckpt"]))
    from ..operators.metrics import METRIC_COLUMNS
    return rounded(spark.read.parquet(p["out"]).select("repo_name", "date", *METRIC_COLUMNS))


@register("stream_detect", O.backfill_sql(
    LOW_Z, "SELECT " + _AUDIT_COLS + " FROM backfill WHERE status = 'anomaly'"))
def q_stream_detect(spark, sf):
    """Detect on arrival: the late-data stream re-scores every window end its
    refreshed days reach; the anomaly rows equal a full backfill."""
    from ..streaming.streams import daily_metrics_stream, day_is
    late = day_is("2024-01-03") | day_is("2024-01-05")
    p = _staged(spark, sf, "detect", ~late, late,
                lambda p: daily_metrics_stream(spark, p["glob"], p["out2"], p["out"], p["ckpt"],
                                               audit_path=p["out3"], z_threshold=LOW_Z))
    a = spark.read.parquet(p["out3"]).filter(F.col("status") == "anomaly")
    return rounded(a.select("repo_name", "anomaly_type", "metric_name", "window_start", "window_end", "n_prior",
                            "n_recent", "baseline_value", "mad", "observed_value", "z_score", "status"))
