"""DuckDB twins of the bindings and jobs, as named CTE fragments.

``sql(final, needs)`` assembles ``WITH <fragments in dependency order> final``.
The fragments restate each binding/job in plain SQL over the provided views
(``events``, ``documents`` ...); they are the independent oracle the Spark
plans are checked against.
"""

from __future__ import annotations

import datetime as _dt

from ..functions.text import STOP_WORDS
from ..schemas import ANOMALY_CHECKS

_STOP_LIST = ", ".join(f"'{w}'" for w in STOP_WORDS)
TOKEN_RE = r"[\p{L}\p{N}]+"

CTE: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, body: str, *deps: str) -> None:
    CTE[name] = (body, deps)


def sql(final: str, *needs: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTE[n][1]:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    if not order:
        return final
    parts = ",\n".join(f"{n} AS (\n{CTE[n][0]}\n)" for n in order)
    return f"WITH {parts}\n{final}"


def d(x) -> str:
    return f"DATE '{_dt.date.fromisoformat(str(x)).isoformat()}'"


def shift(x, days: int) -> str:
    return d(_dt.date.fromisoformat(str(x)) + _dt.timedelta(days=days))


# --------------------------------------------------------------------------- bindings

cte("ev_k", """
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")

cte("bound_events", """
  SELECT CAST(event_id AS VARCHAR) AS id,
         CASE event_type WHEN 'view' THEN 'WatchEvent' WHEN 'error' THEN 'IssuesEvent'
              WHEN 'signup' THEN 'PullRequestEvent' WHEN 'purchase' THEN 'PullRequestEvent'
              WHEN 'click' THEN CASE WHEN k % 4 = 0 THEN 'ForkEvent' WHEN k = 1 THEN 'ReleaseEvent'
                                     ELSE 'PushEvent' END END AS type,
         'org/repo' || CAST(user_id % 10 AS VARCHAR) AS repo_name,
         'user' || CAST(user_id AS VARCHAR) AS actor_login,
         ts AS created_at,
         CASE event_type WHEN 'error' THEN CASE WHEN k < 60 THEN 'opened' ELSE 'closed' END
              WHEN 'signup' THEN 'opened' WHEN 'purchase' THEN 'closed' END AS action,
         CASE WHEN event_type IN ('error', 'signup', 'purchase') THEN CAST(event_id // 10000 * 100 + k AS INTEGER) END AS number,
         CASE WHEN event_type = 'purchase' THEN
              CASE WHEN k % 10 = 1 THEN NULL WHEN k % 10 = 0 THEN false ELSE true END END AS merged,
         CASE WHEN event_type = 'click' AND k % 4 <> 0 AND k = 1 THEN
              'v' || CAST(user_id % 10 AS VARCHAR) || '.' || CAST(event_id % 100 AS VARCHAR) END AS release_tag
  FROM ev_k""", "ev_k")

cte("daily_counts", """
  SELECT repo_name, CAST(created_at AS DATE) AS date,
         count(*) FILTER (WHERE type = 'WatchEvent') AS star_count,
         count(*) FILTER (WHERE type = 'ForkEvent') AS fork_count,
         count(*) FILTER (WHERE type = 'IssuesEvent' AND action = 'opened') AS issue_opened,
         count(*) FILTER (WHERE type = 'IssuesEvent' AND action = 'closed') AS issue_closed,
         count(*) FILTER (WHERE type = 'PullRequestEvent' AND action = 'opened') AS pr_opened,
         count(*) FILTER (WHERE type = 'PullRequestEvent' AND action = 'closed'
                                AND coalesce(merged, true)) AS pr_merged,
         count(*) FILTER (WHERE type = 'PushEvent') AS commit_count
  FROM bound_events GROUP BY 1, 2""", "bound_events")

cte("pr_events", """
  SELECT repo_name, created_at, action, number FROM bound_events WHERE type = 'PullRequestEvent'""",
    "bound_events")

cte("pr_pairs", """
  SELECT c.repo_name, c.number, CAST(c.created_at AS DATE) AS close_date,
         o.created_at AS opened_ts, c.created_at AS closed_ts,
         date_diff('microsecond', o.created_at, c.created_at) / 3.6e9 AS hours
  FROM pr_events c JOIN pr_events o
    ON o.repo_name = c.repo_name AND o.number = c.number
   AND o.action = 'opened' AND o.created_at < c.created_at
  WHERE c.action = 'closed'""", "pr_events")

cte("pr_cycles", """
  SELECT repo_name, close_date, median(hours) AS median_hours, count(*) AS n_pairs
  FROM pr_pairs GROUP BY 1, 2""", "pr_pairs")

cte("daily_metrics", """
  SELECT d.repo_name, d.date, d.star_count, d.fork_count, d.issue_opened, d.issue_closed,
         d.pr_opened, d.pr_merged, p.median_hours AS pr_median_merge_hours, d.commit_count
  FROM daily_counts d LEFT JOIN pr_cycles p ON p.repo_name = d.repo_name AND p.close_date = d.date""",
    "daily_counts", "pr_cycles")

cte("metric_long", "\n  UNION ALL\n".join(
    f"  SELECT repo_name, date, '{t}' AS anomaly_type, '{m}' AS metric_name, "
    f"CAST({mb} AS DOUBLE) AS min_baseline, CAST({m} AS DOUBLE) AS value "
    f"FROM daily_metrics WHERE {m} IS NOT NULL" for t, m, mb in ANOMALY_CHECKS), "daily_metrics")

cte("checks", "  SELECT * FROM (VALUES " + ", ".join(
    f"('{t}', '{m}', CAST({mb} AS DOUBLE))" for t, m, mb in ANOMALY_CHECKS)
    + ") AS c(anomaly_type, metric_name, min_baseline)")


def z_expr(n_prior="n_prior", n_recent="n_recent", med="baseline_value", mad="mad",
           obs="observed_value") -> str:
    return (f"CASE WHEN {n_prior} = 0 OR {n_recent} = 0 THEN 0.0 "
            f"WHEN {mad} = 0 THEN CASE WHEN {med} = 0 THEN 0.0 "
            f"ELSE ({obs} - {med}) / {med} * 10.0 END "
            f"ELSE 0.6745 * ({obs} - {med}) / {mad} END")


def status_expr(z_threshold: float) -> str:
    return ("CASE WHEN n_prior < 7 THEN 'insufficient_history' "
            "WHEN baseline_value < min_baseline THEN 'low_baseline' "
            f"WHEN z_score >= {float(z_threshold)} THEN 'anomaly' ELSE 'normal' END")


def detection_sql(window_end, z_threshold: float, final: str) -> str:
    """Audit rows for one window end, exposed as CTE ``audit``."""
    we = window_end
    body = f"""
  series AS (
    SELECT *, date <= {shift(we, -7)} AS is_prior FROM metric_long
    WHERE date BETWEEN {shift(we, -34)} AND {d(we)}),
  med AS (
    SELECT repo_name, anomaly_type, metric_name,
           median(value) FILTER (WHERE is_prior) AS baseline_value
    FROM series GROUP BY 1, 2, 3),
  scored0 AS (
    SELECT s.repo_name, s.anomaly_type, s.metric_name, any_value(s.min_baseline) AS min_baseline,
           count(s.value) FILTER (WHERE s.is_prior) AS n_prior,
           count(*) FILTER (WHERE NOT s.is_prior) AS n_recent,
           any_value(m.baseline_value) AS baseline_value,
           median(abs(s.value - m.baseline_value)) FILTER (WHERE s.is_prior) AS mad,
           coalesce(avg(s.value) FILTER (WHERE NOT s.is_prior), 0.0) AS observed_value
    FROM series s JOIN med m USING (repo_name, anomaly_type, metric_name)
    GROUP BY 1, 2, 3),
  scored1 AS (SELECT *, {z_expr()} AS z_score FROM scored0),
  grid AS (SELECT r.repo_name, c.* FROM (SELECT DISTINCT repo_name FROM daily_metrics) r, checks c),
  audit AS (
    SELECT g.repo_name, g.anomaly_type, g.metric_name, {shift(we, -6)} AS window_start,
           {d(we)} AS window_end, coalesce(s.n_prior, 0) AS n_prior, coalesce(s.n_recent, 0) AS n_recent,
           s.baseline_value, s.mad, coalesce(s.observed_value, 0.0) AS observed_value,
           coalesce(s.z_score, 0.0) AS z_score, s.min_baseline
    FROM grid g LEFT JOIN scored1 s USING (repo_name, anomaly_type, metric_name)),
  audit2 AS (
    SELECT repo_name, anomaly_type, metric_name, window_start, window_end, n_prior, n_recent,
           baseline_value, mad, observed_value, z_score,
           CASE WHEN min_baseline IS NULL THEN 'insufficient_history' ELSE {status_expr(z_threshold)} END AS status
    FROM audit)
"""
    base = sql("SELECT 1", "metric_long", "checks")
    assert base.startswith("WITH ")
    head = base[: base.rfind("\nSELECT 1")]
    return f"{head},{body}{final}"


BACKFILL_FIRST, BACKFILL_LAST = "2024-01-01", "2024-01-30"

cte("fan2", f"""
  SELECT * FROM (
    SELECT m.*, CAST(m.date + INTERVAL (o.off) DAY AS DATE) AS window_end, o.off >= 7 AS is_prior
    FROM metric_long m, (SELECT range AS off FROM range(0, 35)) o
    WHERE m.date BETWEEN {shift(BACKFILL_FIRST, -34)} AND {d(BACKFILL_LAST)})
  WHERE window_end BETWEEN {d(BACKFILL_FIRST)} AND {d(BACKFILL_LAST)}""", "metric_long")
cte("bmed", """
  SELECT repo_name, anomaly_type, metric_name, window_end, median(value) FILTER (WHERE is_prior) AS baseline_value
  FROM fan2 GROUP BY 1, 2, 3, 4""", "fan2")
cte("bz", f"""
  SELECT *, {z_expr()} AS z_score, CAST(window_end - INTERVAL 6 DAY AS DATE) AS window_start FROM (
    SELECT f.repo_name, f.anomaly_type, f.metric_name, f.window_end,
           any_value(f.min_baseline) AS min_baseline,
           count(f.value) FILTER (WHERE f.is_prior) AS n_prior,
           count(*) FILTER (WHERE NOT f.is_prior) AS n_recent,
           any_value(m.baseline_value) AS baseline_value,
           median(abs(f.value - m.baseline_value)) FILTER (WHERE f.is_prior) AS mad,
           coalesce(avg(f.value) FILTER (WHERE NOT f.is_prior), 0.0) AS observed_value
    FROM fan2 f JOIN bmed m USING (repo_name, anomaly_type, metric_name, window_end)
    GROUP BY 1, 2, 3, 4)""", "fan2", "bmed")


def backfill_sql(z_threshold: float, final: str, *extra: str) -> str:
    """The audit of every window end of the data, exposed as CTE ``backfill``."""
    body = f"""
  backfill AS (
    SELECT repo_name, anomaly_type, metric_name, window_start, window_end,
           n_prior, n_recent, baseline_value, mad, observed_value, z_score,
           {status_expr(z_threshold)} AS status
    FROM bz)
"""
    base = sql("SELECT 1", "bz", *extra)
    head = base[: base.rfind("\nSELECT 1")]
    return f"{head},{body}{final}"


def anomaly_id(repo: str, kind: str, window_end: str) -> str:
    return f"CAST('0x' || substr(md5({repo} || '|' || {kind} || '|' || CAST({window_end} AS VARCHAR)), 1, 12) AS BIGINT)"


def artifacts_cte(name: str, cutoff: str | None = None) -> None:
    """``bound_artifacts`` over events before ``cutoff`` (all when None)."""
    where = f" AND created_at < TIMESTAMP '{cutoff}'" if cutoff else ""
    cte(name + "_g", f"""
  SELECT repo_name, number,
         min(created_at) FILTER (WHERE action = 'opened') AS created_at,
         max(created_at) FILTER (WHERE action = 'closed') AS last_close,
         arg_min(actor_login, created_at) FILTER (WHERE action = 'opened') AS author_login
  FROM bound_events WHERE type = 'PullRequestEvent'{where}
  GROUP BY 1, 2 HAVING min(created_at) FILTER (WHERE action = 'opened') IS NOT NULL""", "bound_events")
    cte(name, f"""
  SELECT (g.number // 100) * 1000 + CAST(regexp_extract(g.repo_name, '(\\d+)$', 1) AS BIGINT) * 100 + g.number % 100 AS artifact_id,
         g.repo_name, 'pull_request' AS type, g.number, left(doc.text, 80) AS title, doc.text AS body,
         CASE WHEN g.last_close > g.created_at THEN 'closed' ELSE 'open' END AS state,
         g.author_login, g.created_at,
         CASE WHEN g.last_close > g.created_at THEN g.last_close END AS closed_at,
         'https://github.com/' || g.repo_name || '/pull/' || CAST(g.number AS VARCHAR) AS url
  FROM {name}_g g LEFT JOIN documents doc
    ON doc.doc_id = (g.number // 100) * 1000 + CAST(regexp_extract(g.repo_name, '(\\d+)$', 1) AS BIGINT) * 100 + g.number % 100""",
        name + "_g")


artifacts_cte("bound_artifacts")


# --------------------------------------------------------------------------- anomalies, reports, cases

cte("bound_anomalies", f"""
  SELECT {anomaly_id('repo_name', 'anomaly_type', 'window_end')} AS id, repo_name, anomaly_type,
         CAST(window_end + INTERVAL 1 DAY AS TIMESTAMP) AS detected_at, window_start, window_end, metric_name,
         round(baseline_value, 6) AS baseline_value, round(observed_value, 6) AS observed_value,
         round(z_score, 6) AS z_score, 'pending' AS status
  FROM bz WHERE {status_expr(1.5)} = 'anomaly'""", "bz")

# --------------------------------------------------------------------------- chunks and search

cte("doc_artifacts", """
  SELECT doc_id AS artifact_id, 'org/repo' || CAST((doc_id // 100) % 10 AS VARCHAR) AS repo_name,
         'pull_request' AS type, doc_id % 100 + (doc_id // 1000) * 100 AS number,
         left(text, 80) AS title, text AS body,
         'https://github.com/org/repo' || CAST((doc_id // 100) % 10 AS VARCHAR) || '/pull/'
           || CAST(doc_id % 100 + (doc_id // 1000) * 100 AS VARCHAR) AS url
  FROM documents""")


def chunks_cte(name: str, source: str, *deps: str) -> None:
    cte(name + "_n", f"""
  SELECT *, greatest(1, CAST(ceil((length(b) - 200) / 1800.0) AS INTEGER)) AS nc
  FROM (SELECT *, regexp_replace(coalesce(body, ''), '^\\s+|\\s+$', '', 'g') AS b FROM {source})
  WHERE length(b) > 0""", *deps)
    cte(name, f"""
  SELECT artifact_id, chunk_index,
         '[' || upper(type) || ' #' || CAST(number AS VARCHAR) || '] ' || coalesce(title, 'None')
           || chr(10) || chr(10) || substring(b, chunk_index * 1800 + 1, 2000) AS text,
         repo_name, type AS artifact_type, url AS artifact_url
  FROM (SELECT *, unnest(range(0, nc)) AS chunk_index FROM {name}_n)""", name + "_n")


chunks_cte("doc_chunks", "doc_artifacts", "doc_artifacts")

EMBED_DIM = 64


def vectors_cte(name: str, key: str, tokens_of: str, *deps: str) -> None:
    """``name``: (key columns, embedding): signed counts per slot of the tokens (key columns, tok) of ``tokens_of``."""
    cte(name + "_slots", f"""
  SELECT {key}, v % {EMBED_DIM} AS slot, sum(CASE WHEN (v // {EMBED_DIM}) % 2 = 0 THEN 1 ELSE -1 END) AS c
  FROM (SELECT {key}, CAST('0x' || substr(md5(tok), 1, 4) AS INTEGER) AS v FROM ({tokens_of})) GROUP BY ALL""", *deps)
    cte(name, f"""
  SELECT {key}, list(CAST(coalesce(s.c, 0) AS DOUBLE) ORDER BY slot) AS embedding
  FROM (SELECT {key}, unnest(range({EMBED_DIM})) AS slot FROM (SELECT DISTINCT {key} FROM {name}_slots)) k
  LEFT JOIN {name}_slots s USING ({key}, slot) GROUP BY ALL""", name + "_slots")


vectors_cte("chunk_vectors", "artifact_id, chunk_index",
            f"SELECT artifact_id, chunk_index, unnest(regexp_extract_all(lower(text), '{TOKEN_RE}')) AS tok FROM doc_chunks",
            "doc_chunks")
cte("chunk_vecs", """
  SELECT c.*, e.embedding FROM doc_chunks c LEFT JOIN chunk_vectors e USING (artifact_id, chunk_index)""",
    "doc_chunks", "chunk_vectors")

chunks_cte("art_chunks", "bound_artifacts", "bound_artifacts")
vectors_cte("art_vectors", "artifact_id, chunk_index",
            f"SELECT artifact_id, chunk_index, unnest(regexp_extract_all(lower(text), '{TOKEN_RE}')) AS tok FROM art_chunks",
            "art_chunks")

STOP_SQL = f"[{_STOP_LIST}]"


def toks(expr: str) -> str:
    return (f"list_filter(regexp_extract_all(lower({expr}), '{TOKEN_RE}'), "
            f"lambda t: NOT list_contains({STOP_SQL}, t))")


cte("q_tok", f"""
  SELECT item_id, unnest(tk) AS term
  FROM (SELECT item_id, {toks('text')} AS tk FROM benchmark)""")

cte("q_terms", """
  SELECT DISTINCT item_id AS query_id, 'org/repo' || CAST(item_id % 10 AS VARCHAR) AS repo_name, term
  FROM q_tok""", "q_tok")



def query_vectors(name: str, terms: str) -> None:
    """Vectors of queries given by their distinct terms (query_id, repo_name, term)."""
    vectors_cte(name + "_v", "query_id, repo_name", f"SELECT query_id, repo_name, term AS tok FROM {terms}", terms)
    cte(name, f"  SELECT query_id, repo_name, embedding AS query_vec FROM {name}_v", name + "_v")


query_vectors("q_vecs", "q_terms")

cte("c_tok", f"""
  SELECT artifact_id, chunk_index, repo_name, artifact_url, text, {toks('text')} AS tk FROM doc_chunks""",
    "doc_chunks")
cte("c_stats", "  SELECT count(*) AS n, avg(len(tk)) AS avgdl FROM c_tok", "c_tok")
cte("c_post", """
  SELECT artifact_id, chunk_index, repo_name, artifact_url, len(tk) AS dl, unnest(tk) AS term FROM c_tok""",
    "c_tok")


def ranked_cte(name: str, pairs: str, score: str, asc: bool, limit: int) -> None:
    """Best chunk per (query, artifact_url), then the first ``limit`` per query."""
    o = "ASC" if asc else "DESC"
    cte(name, f"""
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {score} {o}, artifact_url) AS BIGINT) AS rank,
         artifact_url, artifact_id, chunk_index, {score}, left(text, 400) AS excerpt
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, artifact_url
                                     ORDER BY {score} {o}, chunk_index, artifact_id) AS rb
        FROM {pairs})
  WHERE rb = 1
  QUALIFY rank <= {limit}""", pairs)


def search_ctes(p: str, q_terms: str, q_vecs: str, limit: int = 20, any_of: str | None = None) -> None:
    """Vector and BM25 legs for a query set: ``{p}v_ranked``, ``{p}t_ranked``
    (chunks with all terms, for queries of ``any_of`` with any) and ``{p}a_ranked`` (chunks with any term)."""
    cte(p + "v_pairs", f"""
  SELECT q.query_id, c.artifact_url, c.artifact_id, c.chunk_index, c.text,
         CAST(1 AS DOUBLE) - list_dot_product(c.embedding, q.query_vec) / sqrt(
           list_dot_product(c.embedding, c.embedding) * list_dot_product(q.query_vec, q.query_vec)) AS dist
  FROM chunk_vecs c JOIN {q_vecs} q USING (repo_name)
  WHERE list_dot_product(c.embedding, c.embedding) > 0 AND list_dot_product(q.query_vec, q.query_vec) > 0""", "chunk_vecs", q_vecs)
    ranked_cte(p + "v_ranked", p + "v_pairs", "dist", True, limit)
    cte(p + "q_n", f"  SELECT query_id, count(*) AS n_terms FROM {q_terms} GROUP BY 1", q_terms)
    cte(p + "t_df", f"""
  SELECT term, count(DISTINCT (artifact_id, chunk_index)) AS df FROM c_post
  WHERE term IN (SELECT term FROM {q_terms}) GROUP BY 1""", "c_post", q_terms)
    cte(p + "t_hits", f"""
  SELECT q.query_id, p.artifact_id, p.chunk_index, p.artifact_url, p.term, p.dl, count(*) AS tf
  FROM c_post p JOIN {q_terms} q ON q.term = p.term AND q.repo_name = p.repo_name
  GROUP BY 1, 2, 3, 4, 5, 6""", "c_post", q_terms)
    cte(p + "a_pairs", f"""
  SELECT h.query_id, h.artifact_id, h.chunk_index, h.artifact_url, any_value(c.text) AS text,
         round(sum(ln(1.0 + (CAST(s.n AS DOUBLE) - d.df + 0.5) / (d.df + 0.5)) * h.tf * 2.2
                   / (h.tf + 1.2 * (0.25 + 0.75 * h.dl / s.avgdl))), 9) AS score,
         count(*) AS matched, any_value(n.n_terms) AS n_terms
  FROM {p}t_hits h JOIN {p}t_df d USING (term) JOIN {p}q_n n USING (query_id)
       JOIN doc_chunks c ON c.artifact_id = h.artifact_id AND c.chunk_index = h.chunk_index,
       c_stats s
  GROUP BY 1, 2, 3, 4""", p + "t_hits", p + "t_df", p + "q_n", "c_stats", "doc_chunks")
    some = f" OR query_id IN (SELECT query_id FROM {any_of})" if any_of else ""
    cte(p + "t_pairs", f"  SELECT * FROM {p}a_pairs WHERE matched = n_terms{some}", p + "a_pairs", *([any_of] if any_of else []))
    ranked_cte(p + "a_ranked", p + "a_pairs", "score", False, limit)
    ranked_cte(p + "t_ranked", p + "t_pairs", "score", False, limit)


def hybrid_sql(p: str, k: int, cols: str) -> str:
    return (f"SELECT {cols} FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, "
            f"artifact_url) AS BIGINT) AS rank FROM ("
            "SELECT coalesce(v.query_id, t.query_id) AS query_id, "
            "coalesce(v.artifact_url, t.artifact_url) AS artifact_url, coalesce(v.excerpt, t.excerpt) AS excerpt, "
            "coalesce(CAST(1.0 AS DOUBLE) / (60.0 + v.rank), 0.0) + coalesce(CAST(1.0 AS DOUBLE) / (60.0 + t.rank), 0.0) "
            f"AS rrf_score, v.rank AS v_rank, t.rank AS t_rank FROM {p}v_ranked v FULL OUTER JOIN {p}t_ranked t "
            f"ON v.query_id = t.query_id AND v.artifact_url = t.artifact_url)) WHERE rank <= {k}")


search_ctes("", "q_terms", "q_vecs")



cte("win", "  SELECT DISTINCT repo_name, window_start, window_end FROM bound_anomalies", "bound_anomalies")
cte("cand", """
  SELECT w.repo_name, w.window_start, w.window_end, e.number
  FROM win w JOIN bound_events e ON e.repo_name = w.repo_name AND e.type = 'PullRequestEvent'
   AND CAST(e.created_at AS DATE) BETWEEN w.window_start AND w.window_end
  WHERE e.number IS NOT NULL
  UNION
  SELECT w.repo_name, w.window_start, w.window_end, g.number
  FROM win w JOIN bound_artifacts g ON g.repo_name = w.repo_name
   AND CAST(g.closed_at AS DATE) BETWEEN w.window_start AND w.window_end""",
    "win", "bound_events", "bound_artifacts")

cte("comments_agg", """
  SELECT artifact_id, count(*) AS n_c,
         string_agg(chr(10) || '@' || coalesce(author_login, 'unknown') || ': ' || sb, chr(10) ORDER BY position)
           FILTER (WHERE sb <> '') AS lines
  FROM (SELECT conv_id AS artifact_id, turn AS position, role AS author_login,
               regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS sb FROM conversations)
  GROUP BY 1""")

# --------------------------------------------------------------------------- reports and cases

_DOC_REPO = "'org/repo' || CAST((doc_id // 100) % 10 AS VARCHAR)"
_DOC_ANOMALY = anomaly_id(_DOC_REPO, "['pr_slowdown', 'issue_spike', 'star_spike'][(doc_id // 10) % 3 + 1]",
                          "CAST(DATE '2024-01-30' - INTERVAL (doc_id % 10) DAY AS DATE)")

cte("bound_reports", f"""
  SELECT doc_id AS id, {_DOC_ANOMALY} AS anomaly_id, {_DOC_REPO} AS doc_repo,
         TIMESTAMP '2024-02-01 00:00:00' + INTERVAL (doc_id) MINUTE AS created_at,
         string_split(text, chr(10))[1] AS summary,
         coalesce(string_split(text, chr(10))[2], '') AS root_cause,
         ['high', 'medium', 'low', NULL][(doc_id // 40 + doc_id) % 4 + 1] AS confidence,
         string_split(text, chr(10)) AS evidence,
         CASE WHEN doc_id % 5 = 0 THEN 0 ELSE len(string_split(text, chr(10))) + 1 END AS n_citations,
         'Inline review comments were not fetched.' AS limitations,
         CAST(1 + doc_id % 10 AS INTEGER) AS tool_calls_used,
         (n_chars % 1200) / CAST(10.0 AS DOUBLE) AS duration_seconds, text
  FROM documents""")

cte("bound_citations", """
  SELECT id AS report_id, anomaly_id, CAST(i AS BIGINT) AS pos,
         CASE WHEN i < len(evidence) THEN 'artifact_chunk' ELSE 'sql_result' END AS citation_type,
         CASE WHEN i < len(evidence) THEN 'https://github.com/' || doc_repo || '/pull/'
                              || CAST((anomaly_id * 7 + (i + id % 3) * 13) % 100 AS VARCHAR)
              ELSE 'SQL: daily metrics' END AS source_url,
         CASE WHEN i < len(evidence) THEN evidence[i + 1] ELSE summary END AS excerpt
  FROM (SELECT *, unnest(range(0, len(evidence) + 1)) AS i FROM bound_reports WHERE n_citations > 0)
  UNION ALL
  SELECT id, anomaly_id, NULL, NULL, NULL, NULL FROM bound_reports WHERE n_citations = 0""", "bound_reports")

cte("latest", """
  SELECT r.*, a.repo_name, a.anomaly_type, a.window_start, a.window_end, a.metric_name,
         a.baseline_value, a.observed_value, a.z_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anomaly_id ORDER BY created_at DESC, id DESC) AS rn
        FROM bound_reports WHERE confidence != 'error') r
  JOIN bound_anomalies a ON a.id = r.anomaly_id WHERE r.rn = 1""", "bound_reports", "bound_anomalies")

cte("feed", """
  SELECT l.id, l.anomaly_id, l.repo_name AS repo, l.anomaly_type, l.window_start, l.window_end, l.metric_name,
         round(coalesce(l.baseline_value, 0.0), 1) AS baseline, round(coalesce(l.observed_value, 0.0), 1) AS observed,
         round(coalesce(l.z_score, 0.0), 2) AS z_score, l.confidence, l.summary, l.root_cause,
         coalesce(c.n, 0) AS citations_count, l.tool_calls_used AS tool_calls,
         round(coalesce(l.duration_seconds, 0.0), 1) AS duration_s, l.created_at
  FROM latest l LEFT JOIN (SELECT report_id, count(*) AS n FROM bound_citations
                           WHERE citation_type IS NOT NULL GROUP BY 1) c ON c.report_id = l.id""",
    "latest", "bound_citations")

cte("bound_cases", f"""
  SELECT 'case_' || CAST(id AS VARCHAR) AS id, id AS anomaly_ref, repo_name, anomaly_type, metric_name, window_start, window_end,
         CASE WHEN id % 6 = 4 THEN CAST([] AS VARCHAR[]) ELSE
           list_transform([0, 13, 26], lambda j: 'https://github.com/' || repo_name || '/pull/' || CAST((id * 7 + j) % 100 AS VARCHAR))
         END AS expected_evidence_urls,
         CASE WHEN id % 2 = 0 THEN ['high', 'medium'] ELSE ['low', 'medium'] END AS expected_confidences,
         round(baseline_value, 6) AS baseline_value, round(observed_value, 6) AS observed_value, round(z_score, 6) AS z_score
  FROM (SELECT *, {anomaly_id('repo_name', 'anomaly_type', 'window_end')} AS id FROM bz WHERE {status_expr(1.0)} = 'anomaly')""",
    "bz")

cte("resolved", """
  SELECT c.*, a.id AS anomaly_id, r.id AS report_id, r.confidence, r.tool_calls_used, r.duration_seconds,
         r.summary, coalesce(u.cited, CAST([] AS VARCHAR[])) AS cited, coalesce(r.n_citations, 0) AS n_cited
  FROM bound_cases c
  LEFT JOIN bound_anomalies a ON a.repo_name = c.repo_name AND a.anomaly_type = c.anomaly_type
       AND a.window_start = c.window_start AND a.window_end = c.window_end
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY anomaly_id ORDER BY created_at DESC, id DESC) AS rn
             FROM bound_reports) r ON r.anomaly_id = a.id AND r.rn = 1
  LEFT JOIN (SELECT report_id, list(DISTINCT source_url) AS cited FROM bound_citations
             WHERE source_url IS NOT NULL GROUP BY 1) u ON u.report_id = r.id""",
    "bound_cases", "bound_anomalies", "bound_reports", "bound_citations")

COVERAGE_SQL = ("CASE WHEN len(expected_evidence_urls) = 0 THEN NULL ELSE round(len(list_filter("
                "expected_evidence_urls, lambda x: list_contains(cited, x))) / len(expected_evidence_urls), 2) END")

cte("scores", f"""
  SELECT id AS case_id, repo_name AS repo, anomaly_type,
         CASE WHEN report_id IS NOT NULL THEN {COVERAGE_SQL} END AS citation_coverage,
         report_id IS NOT NULL AND n_cited > 0 AS has_citations,
         report_id IS NOT NULL AND tool_calls_used <= 8 AS budget_ok,
         report_id IS NOT NULL AND duration_seconds <= 90.0 AS latency_ok,
         report_id IS NOT NULL AND coalesce(list_contains(expected_confidences, confidence), false) AS confidence_match,
         CASE WHEN report_id IS NOT NULL THEN confidence ELSE 'error' END AS confidence,
         CASE WHEN report_id IS NOT NULL THEN tool_calls_used ELSE 0 END AS tool_calls,
         CASE WHEN report_id IS NOT NULL THEN round(duration_seconds, 1) END AS latency_s,
         CASE WHEN report_id IS NOT NULL THEN left(summary, 120) ELSE 'ERROR: no report' END AS summary
  FROM resolved WHERE anomaly_id IS NOT NULL""", "resolved")


cte("slow", """
  SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY anomaly_id ORDER BY hours_open DESC NULLS LAST, number)
                   AS BIGINT) AS rank
    FROM (SELECT a.id AS anomaly_id, a.anomaly_type, a.repo_name, g.artifact_id, g.number, left(g.title, 80) AS title,
                 round(date_diff('microsecond', g.created_at, g.closed_at) / 3.6e9) AS hours_open,
                 CAST(g.created_at AS DATE) AS opened, CAST(g.closed_at AS DATE) AS closed, g.url
          FROM bound_anomalies a JOIN bound_artifacts g ON g.repo_name = a.repo_name
           AND CAST(g.closed_at AS DATE) BETWEEN a.window_start AND a.window_end))
  WHERE rank <= 10""", "bound_anomalies", "bound_artifacts")

cte("ev_titles", f"""
  SELECT DISTINCT anomaly_id, repo_name, unnest({toks('title')}) AS term FROM slow WHERE rank = 1""", "slow")
cte("ev_lack", """
  SELECT a.* FROM bound_anomalies a WHERE a.id NOT IN (SELECT anomaly_id FROM ev_titles)""", "bound_anomalies", "ev_titles")
cte("ev_own", f"""
  SELECT DISTINCT id, repo_name, term FROM (
    SELECT l.id, l.repo_name, unnest({toks('e.release_tag')}) AS term
    FROM ev_lack l JOIN bound_events e ON e.repo_name = l.repo_name AND e.type = 'ReleaseEvent'
     AND CAST(e.created_at AS DATE) BETWEEN l.window_start AND l.window_end
    UNION ALL
    SELECT l.id, l.repo_name, unnest({toks('g.title')}) AS term
    FROM ev_lack l JOIN bound_artifacts g ON g.repo_name = l.repo_name
     AND CAST(g.created_at AS DATE) BETWEEN l.window_start AND l.window_end)""", "ev_lack", "bound_events", "bound_artifacts")
cte("ev_rare", """
  SELECT id, repo_name, term FROM (
    SELECT o.*, row_number() OVER (PARTITION BY o.id ORDER BY f.df, o.term) AS place
    FROM ev_own o JOIN (SELECT term, count(DISTINCT (artifact_id, chunk_index)) AS df FROM c_post GROUP BY 1) f USING (term))
  WHERE place <= 5""", "ev_own", "c_post")
cte("ev_any", """
  SELECT id AS query_id, repo_name, term FROM ev_rare
  UNION
  SELECT id, repo_name, unnest(string_split(anomaly_type, '_')) FROM ev_lack WHERE id NOT IN (SELECT id FROM ev_rare)""",
    "ev_lack", "ev_rare")
cte("ev_q_terms", """
  SELECT anomaly_id AS query_id, repo_name, term FROM ev_titles UNION ALL SELECT * FROM ev_any""", "ev_titles", "ev_any")
query_vectors("ev_q_vecs", "ev_q_terms")
search_ctes("ev_", "ev_q_terms", "ev_q_vecs", any_of="ev_any")
cte("ev_hits", hybrid_sql("ev_", 5, "query_id, rank, artifact_url, excerpt"), "ev_v_ranked", "ev_t_ranked")
