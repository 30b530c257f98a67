"""Chunking (H1), and search over chunks for a whole batch of queries.

The parts have modules of their own: vectors of chunks (``embedding``), exact and coded
vector search (``vectors``), postings lists and BM25 (``fulltext``). Here they become searches
with excerpts and are fused by reciprocal rank.

* Chunks are produced with ``explode(sequence(..))`` over chunk indices and a
  ``substring`` per row: no per-document arrays of chunk strings.
* Excerpts are joined once, onto the few ranked rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunk_header, strip
from ..schemas import CHUNK_OVERLAP, CHUNK_SIZE, RRF_K
from .artifacts import top_k
from .fulltext import build_directory, build_lists, matches, split_websearch  # noqa: F401
from .vectors import ann_recall, ann_search, nearest  # noqa: F401

BROADCAST_MAX_ROWS = 200_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast ``df`` (narrow rows: ids, ranks and a URL) only when its row count is proven small."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


# --------------------------------------------------------------------------- chunking (H1)

def n_chunks(n: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Number of windows of ``size`` chars stepping ``size - overlap`` until the
    end is reached: 0 for empty text, else max(1, ceil((n - overlap) / step))."""
    step = size - overlap
    return F.when(n <= 0, F.lit(0)).otherwise(
        F.greatest(F.lit(1), F.ceil((n - F.lit(overlap)) / F.lit(step)).cast("int")))


def chunk_artifacts(artifacts: DataFrame, size: int = CHUNK_SIZE,
                    overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """artifacts(artifact_id, repo_name, type, number, title, body, url) ->
    chunks(artifact_id, chunk_index, text, repo_name, artifact_type, artifact_url).

    Body is stripped; empty bodies give no chunk. Each chunk is
    ``header + blank line + body[i*step : i*step + size]``.
    """
    step = size - overlap
    a = artifacts.select("artifact_id", "repo_name", "type", "number", "title", "url",
                         strip(F.coalesce(F.col("body"), F.lit(""))).alias("_b"))
    a = a.withColumn("_n", n_chunks(F.length("_b"), size, overlap)).filter(F.col("_n") > 0)
    e = a.select("*", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("_n") - 1).cast("long")))
                 .alias("chunk_index"))
    text = F.concat(chunk_header(F.col("type"), F.col("number"), F.col("title")), F.lit("\n\n"),
                    F.substring(F.col("_b"), F.col("chunk_index") * step + 1, F.lit(size)))
    return e.select("artifact_id", "chunk_index", text.alias("text"), "repo_name",
                    F.col("type").alias("artifact_type"), F.col("url").alias("artifact_url"))


# --------------------------------------------------------------------------- the two legs (H4, H6, H7)

def vector_search(queries: DataFrame, chunks: DataFrame, search_k: int = 20) -> DataFrame:
    """Exact cosine search: per query, artifacts of its repository ranked by
    the distance of their best chunk (1 - cosine), first ``search_k``, with excerpt."""
    return _with_excerpt(nearest(queries, chunks, search_k), chunks)


def text_search(queries: DataFrame, chunks: DataFrame, search_k: int = 20, lists: DataFrame | None = None,
                directory: DataFrame | None = None, stem: bool = False) -> DataFrame:
    """BM25 search over the query's repository: a chunk matches when it meets a
    clause: all its positive items occur (terms, or phrases at adjacent
    positions) and none of its negated ones. A clause of negated items alone is
    met by every chunk of the repository without them. Score = BM25 over the
    distinct positive terms present, else 0. Best chunk per artifact, first
    ``search_k``, with excerpt.

    ``lists`` / ``directory`` are the stored ``build_lists`` (of the same ``stem``) / ``build_directory``
    tables; without them both are derived from ``chunks`` in the same job.
    """
    lists = lists if lists is not None else build_lists(chunks, stem)
    directory = directory if directory is not None else build_directory(chunks)
    return _with_excerpt(matches(queries, lists, directory, search_k, stem), chunks)


def _with_excerpt(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Attach the 400-character excerpt. ``ranked`` (queries x k rows) is
    checkpointed and, where its size allows, the broadcast right side of an
    inner join (its chunks all exist), so the chunk store is streamed past it."""
    r = ranked.checkpoint()
    ex = chunks.select("artifact_id", "chunk_index", F.left("text", F.lit(400)).alias("excerpt"))
    return ex.join(broadcast_if_small(r), ["artifact_id", "chunk_index"]).select(*r.columns, "excerpt")


# --------------------------------------------------------------------------- fusion

def rrf_fuse(vec: DataFrame, txt: DataFrame, k: int = 5, rrf_k: int = RRF_K,
             carry: tuple[str, ...] = ("excerpt",)) -> DataFrame:
    """Reciprocal-rank fusion of two ranked legs (FULL OUTER JOIN on url);
    a missing leg contributes 0. The vector leg's ``carry`` columns are preferred."""
    v = vec.select("query_id", "artifact_url", F.col("rank").alias("v_rank"), *[F.col(c).alias(f"v_{c}") for c in carry])
    t = txt.select("query_id", "artifact_url", F.col("rank").alias("t_rank"), *[F.col(c).alias(f"t_{c}") for c in carry])
    j = v.join(t, ["query_id", "artifact_url"], "full")
    score = (F.coalesce(F.lit(1.0) / (F.lit(float(rrf_k)) + F.col("v_rank")), F.lit(0.0))
             + F.coalesce(F.lit(1.0) / (F.lit(float(rrf_k)) + F.col("t_rank")), F.lit(0.0)))
    one = F.col("v_rank").isNotNull()
    f = j.select("query_id", "artifact_url", *[F.when(one, F.col(f"v_{c}")).otherwise(F.col(f"t_{c}")).alias(c) for c in carry],
                 score.alias("rrf_score"), "v_rank", "t_rank")
    return top_k(f, ["query_id"], [F.col("rrf_score").desc(), F.col("artifact_url").asc()], k)


def render_hits(hits: DataFrame) -> DataFrame:
    """Search hits as the text handed to a reader: ``[score=0.0325] url``
    followed by the 400-character excerpt, best first per query."""
    line = F.format_string("[score=%.4f] %s\n%s", F.col("rrf_score"), F.col("artifact_url"),
                           F.coalesce(F.col("excerpt"), F.lit("")))
    return hits.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))),
                                 lambda x: x["l"]), "\n\n---\n\n").alias("text"))


def hybrid_search(queries: DataFrame, chunks: DataFrame, k: int = 5, lists: DataFrame | None = None,
                  directory: DataFrame | None = None) -> DataFrame:
    """Vector + BM25 legs over-fetched to 4k each, fused by RRF, first k; excerpts are joined after the fusion."""
    lists = lists if lists is not None else build_lists(chunks)
    directory = directory if directory is not None else build_directory(chunks)
    fused = rrf_fuse(nearest(queries, chunks, 4 * k), matches(queries, lists, directory, 4 * k), k,
                     carry=("artifact_id", "chunk_index"))
    return _with_excerpt(fused, chunks)
