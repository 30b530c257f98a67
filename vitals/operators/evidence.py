"""Evidence bundle (J2): what the four investigation tools gather, for every
anomaly at once, emitted as typed citation rows.

* ``sql_result``     the anomaly's metric over its window (days with a value,
                     window mean) next to baseline / observed.
* ``artifact_chunk`` the slowest PRs closed in the window (pr_slowdown only),
                     then, for every type, the hybrid-search hits for all terms
                     of the slowest PR's title (and their vector). Where no PR closed
                     in the window, any of the five rarest terms of its releases' tags and
                     of the titles of PRs opened in it, else the words of
                     the anomaly's type.
* ``release_note``   releases published inside the window, newest first.

Window membership is an equi-join on (repo_name, day) over the window's
exploded days; the search reuses ``retrieval.hybrid_search`` with one query
per anomaly, so all anomalies are searched in the same job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import query_terms_expr
from .artifacts import releases, slow_prs, top_k, window_days
from .detect import metric_long
from .embedding import embed_text
from .fulltext import build_directory, build_lists, lookup
from .retrieval import hybrid_search

GITHUB = "https://github.com/"


def _num(c) -> F.Column:
    return F.round(c, 1).cast("string")


def evidence_bundle(anomalies: DataFrame, daily: DataFrame, artifacts: DataFrame, events: DataFrame,
                    chunks: DataFrame, k_prs: int = 10, k_releases: int = 10,
                    k_hits: int = 5, lists: DataFrame | None = None,
                    directory: DataFrame | None = None) -> DataFrame:
    """(anomaly_id, source, rank, citation_type, source_url, excerpt)."""
    a = anomalies.select(F.col("id").alias("anomaly_id"), "repo_name", "anomaly_type", "metric_name",
                         "window_start", "window_end", "baseline_value", "observed_value")
    days = window_days(anomalies)

    # sql_result: the metric inside the window
    vals = metric_long(daily).select("repo_name", F.col("date").alias("day"), "metric_name", "value")
    series = (days.join(a.select("anomaly_id", "metric_name"), "anomaly_id")
              .join(vals, ["repo_name", "day", "metric_name"])
              .groupBy("anomaly_id").agg(F.count("*").alias("n_days"), F.avg("value").alias("mean")))
    sql_rows = a.join(series, "anomaly_id", "left").select(
        "anomaly_id", F.lit("metric").alias("source"), F.lit(1).cast("long").alias("rank"),
        F.lit("sql_result").alias("citation_type"),
        F.concat(F.lit("SQL: "), F.col("metric_name"), F.lit(" daily values "),
                 F.col("window_start").cast("string"), F.lit(".."), F.col("window_end").cast("string"))
        .alias("source_url"),
        F.concat(F.lit("baseline="), _num(F.col("baseline_value")), F.lit(" observed="),
                 _num(F.col("observed_value")), F.lit(" days="),
                 F.coalesce(F.col("n_days"), F.lit(0)).cast("string"), F.lit(" window_mean="),
                 F.coalesce(F.round("mean", 2).cast("string"), F.lit("None"))).alias("excerpt"))

    # artifact_chunk: slowest PRs; listed for pr_slowdown windows, searched with for all
    # Small (anomalies x k rows) and used twice: cut its lineage once.
    prs = slow_prs(anomalies, artifacts, k_prs, keep=("artifact_id", "repo_name")).checkpoint()
    slowdowns = a.filter(F.col("anomaly_type") == "pr_slowdown").select("anomaly_id")
    pr_rows = prs.join(slowdowns, "anomaly_id", "left_semi").select(
        "anomaly_id", F.lit("slow_pr").alias("source"), "rank", F.lit("artifact_chunk").alias("citation_type"),
        F.col("url").alias("source_url"),
        F.concat(F.lit("PR #"), F.col("number").cast("string"), F.lit(" ("),
                 F.coalesce(F.col("hours_open").cast("long").cast("string"), F.lit("None")),
                 F.lit("h open): "), F.coalesce(F.col("title"), F.lit("None"))).alias("excerpt"))

    # release_note: releases published inside the window
    rel = releases(events)
    rj = days.join(rel.withColumnRenamed("release_date", "day"), ["repo_name", "day"])
    rel_top = top_k(rj, ["anomaly_id"], [F.col("created_at").desc(), F.col("tag").asc()], k_releases)
    rel_rows = rel_top.select(
        "anomaly_id", F.lit("release").alias("source"), "rank", F.lit("release_note").alias("citation_type"),
        F.concat(F.lit(GITHUB), F.col("repo_name"), F.lit("/releases/tag/"), F.col("tag")).alias("source_url"),
        F.left(F.col("notes"), F.lit(100)).alias("excerpt"))

    # artifact_chunk: hybrid hits for a query built from the slowest PR, or from the window itself
    lists = lists if lists is not None else build_lists(chunks)
    directory = directory if directory is not None else build_directory(chunks)
    slowest = prs.where((F.col("rank") == 1) & (F.size(query_terms_expr(F.col("title"))) > 0)).select(
        F.col("anomaly_id").alias("query_id"), "repo_name",
        F.array_join(query_terms_expr(F.col("title")), " ").alias("words"), F.lit(False).alias("any"))
    q = slowest.unionByName(_window_queries(
        a.join(slowest.select(F.col("query_id").alias("anomaly_id")), "anomaly_id", "left_anti"), days, rj, artifacts, lists))
    q = embed_text(q, "words", "query_vec").withColumn(
        "query_text", F.when(F.col("any"), F.replace("words", F.lit(" "), F.lit(" or "))).otherwise(F.col("words"))).checkpoint()
    hits = hybrid_search(q, chunks, k_hits, lists=lists, directory=directory)
    hit_rows = hits.select(
        F.col("query_id").alias("anomaly_id"), F.lit("search").alias("source"), "rank",
        F.lit("artifact_chunk").alias("citation_type"), F.col("artifact_url").alias("source_url"),
        F.left(F.col("excerpt"), F.lit(100)).alias("excerpt"))

    return sql_rows.unionByName(pr_rows).unionByName(rel_rows).unionByName(hit_rows)


def _window_queries(anomalies: DataFrame, days: DataFrame, released: DataFrame, artifacts: DataFrame,
                    lists: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, repo_name, words, any): the ``k`` terms with the fewest chunks, else the words of the type."""
    own = days.join(anomalies.select("anomaly_id"), "anomaly_id", "left_semi")
    tags = released.join(anomalies.select("anomaly_id"), "anomaly_id", "left_semi").select(
        "anomaly_id", F.explode(query_terms_expr(F.col("tag"))).alias("term"))
    opened = artifacts.select("repo_name", F.to_date("created_at").alias("day"), "title")
    titles = own.join(opened, ["repo_name", "day"]).select("anomaly_id", F.explode(query_terms_expr(F.col("title"))).alias("term"))
    terms = tags.unionByName(titles).distinct().checkpoint()
    df = lookup(lists, terms).select("term", "n").join(terms.select("term").distinct(), "term", "left_semi") \
        .groupBy("term").agg(F.sum("n").alias("df"))
    rare = top_k(terms.join(df, "term"), ["anomaly_id"], [F.col("df").asc(), F.col("term").asc()], k, "place")
    words = rare.groupBy("anomaly_id").agg(F.array_join(F.sort_array(F.collect_list("term")), " ").alias("rare"))
    return anomalies.join(words, "anomaly_id", "left").select(
        F.col("anomaly_id").alias("query_id"), "repo_name",
        F.coalesce("rare", F.replace("anomaly_type", F.lit("_"), F.lit(" "))).alias("words"), F.lit(True).alias("any"))
