"""Vector search: exact (H4, E1, E2) and by product-quantised codes (H5).

Exact search has one path at every size: the queries go over the chunks in blocks
of ``QUERY_BLOCK``, each block broadcast on its own. A task keeps the best ``k``
artifacts per query over all its batches and emits them once; distances come from a
matrix product first, and those that could still enter are computed again row by
row, so equal vectors tie wherever they lie.

Approximate search keeps one byte per ``dim / SUBSPACES`` components: the number of the nearest of 256
centres, trained on a bounded hash sample. A query adds up its products with the
centres from a table, keeps the best codes as candidates, and only those meet their
vectors for an exact ranking.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .artifacts import top_k

QUERY_BLOCK = 16_384
SUBSPACES = 16
CENTRES = 256
TRAIN_ROWS = 8192
TRAIN_ROUNDS = 12
RERANK_SHARE = 0.09
RERANK_MOST = 2000

_CANDIDATE = "query_id long, artifact_url string, artifact_id long, chunk_index long, dist double"
_KEYS = ["query_id", "artifact_url", "artifact_id", "chunk_index"]


def matrix(col: pa.Array) -> np.ndarray:
    """A list column of equally long float lists as rows of doubles."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def cosine_distance(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """1 - cosine of every row with q, added up row by row."""
    return 1.0 - np.einsum("ij,j->i", x, q) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("j,j->", q, q))


class QueryBlock:
    """Query vectors by repository; zero vectors have no direction and match nothing."""

    def __init__(self, rows: list):
        by_repo: dict[str, list] = {}
        for r in rows:
            v = np.asarray(r["query_vec"], np.float64)
            if v.any():
                by_repo.setdefault(r["repo_name"], []).append((r["query_id"], v))
        self.ids = {repo: [i for i, _ in vs] for repo, vs in by_repo.items()}
        self.vectors = {repo: np.vstack([v for _, v in vs]) for repo, vs in by_repo.items()}


def query_blocks(queries: DataFrame, size: int) -> Iterator[QueryBlock]:
    """The queries in blocks of at most ``size`` rows, one block on the driver at a time."""
    rows = []
    for r in queries.where(F.col("query_vec").isNotNull()).select("query_id", "repo_name", "query_vec").toLocalIterator():
        rows.append(r)
        if len(rows) == size:
            yield QueryBlock(rows)
            rows = []
    if rows:
        yield QueryBlock(rows)


def _scored(b: pa.RecordBatch, queries: QueryBlock, k: int, best: dict) -> None:
    """Merge a batch of chunks into the best ``k`` artifacts per query: {query_id: [(dist, url, chunk_index, artifact_id)]}."""
    repos = b.column("repo_name").dictionary_encode()
    codes = repos.indices.to_numpy()
    for code, repo in enumerate(repos.dictionary.to_pylist()):
        if repo not in queries.ids:
            continue
        at = np.flatnonzero(codes == code)
        x = matrix(b.column("embedding").take(pa.array(at)))
        some = x.any(axis=1)
        x, at = x[some], at[some]
        if not len(at):
            continue
        taken = pa.array(at)
        urls, where = np.unique(np.array(b.column("artifact_url").take(taken).to_pylist(), object), return_inverse=True)
        order = np.argsort(where, kind="stable")
        x, at, where = x[order], at[order], where[order]
        heads = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        chunk = b.column("chunk_index").take(pa.array(at)).to_pylist()
        artifact = b.column("artifact_id").take(pa.array(at)).to_pylist()
        unit = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        vectors = queries.vectors[repo]
        for a in range(0, len(vectors), 256):
            q = vectors[a:a + 256]
            near = (q / np.sqrt(np.einsum("ij,ij->i", q, q))[:, None]) @ unit.T
            top = np.maximum.reduceat(near, heads, axis=1)  # the best chunk per artifact
            for i, qid in enumerate(queries.ids[repo][a:a + 256]):
                held = best.get(qid, [])
                least = np.partition(top[i], len(urls) - k)[len(urls) - k] if len(urls) > k else -2.0
                if len(held) == k:
                    least = max(least, 1.0 - held[-1][0])
                use = np.flatnonzero(near[i] >= least - 1e-9)
                if not len(use):
                    continue
                dist = cosine_distance(x[use], q[i])
                merged = {h[1]: h for h in held}
                for d, r in zip(dist.tolist(), use.tolist()):
                    found = (d, urls[where[r]], chunk[r], artifact[r])
                    old = merged.get(found[1])
                    if old is None or found < old:
                        merged[found[1]] = found
                best[qid] = heapq.nsmallest(k, merged.values())


def nearest(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, artifact_url, artifact_id, chunk_index, dist): exact, per query of its repository."""
    c = chunks.where(F.col("embedding").isNotNull()).select("artifact_id", F.col("chunk_index").cast("long").alias("chunk_index"),
                                                            "repo_name", "artifact_url", "embedding")
    found = None
    for block in query_blocks(queries, QUERY_BLOCK):
        shared = chunks.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            best: dict = {}
            for b in batches:
                _scored(b, shared.value, k, best)
            rows = [(q, u, a, i, d) for q, held in best.items() for d, u, i, a in held]
            for a in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(col, t) for col, t in zip(zip(*rows[a:a + 10_000]), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()))],
                    [*_KEYS, "dist"])

        own = c.mapInArrow(run, _CANDIDATE)
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = chunks.sparkSession.createDataFrame([], _CANDIDATE)
    return best_per_artifact(found, k)


def best_per_artifact(found: DataFrame, k: int) -> DataFrame:
    """The best chunk per (query, artifact_url), ties to the lower chunk index, then the first ``k`` by (dist, url)."""
    key = F.struct("dist", "chunk_index", "artifact_id")
    g = found.groupBy("query_id", "artifact_url").agg(F.min(key).alias("b"))
    g = g.select("query_id", "artifact_url", "b.dist", "b.chunk_index", "b.artifact_id")
    return top_k(g, ["query_id"], [F.col("dist").asc(), F.col("artifact_url").asc()], k)


# --------------------------------------------------------------------------- product quantisation (H5)

def _units(x: np.ndarray) -> np.ndarray:
    n = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


class Codebook:
    """Centres per subspace of unit vectors, by Lloyd's rounds on a sample."""

    def __init__(self, sample: np.ndarray, subspaces: int = SUBSPACES, rounds: int = TRAIN_ROUNDS, seed: int = 7):
        rng = np.random.default_rng(seed)
        x = _units(sample)
        self.cuts = np.linspace(0, x.shape[1], min(subspaces, x.shape[1]) + 1).astype(int)
        self.centres = []
        for a, b in zip(self.cuts, self.cuts[1:]):
            part = x[:, a:b]
            distinct = np.unique(part, axis=0)
            c = distinct[rng.permutation(len(distinct))[:CENTRES]]
            for _ in range(rounds):
                own = self._assign(part, c)
                n = np.bincount(own, minlength=len(c))
                sums = np.stack([np.bincount(own, part[:, j], len(c)) for j in range(b - a)], axis=1)
                c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
            self.centres.append(c)

    @staticmethod
    def _assign(part: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.argmin(np.einsum("ij,ij->i", centres, centres) - 2 * (part @ centres.T), axis=1)

    def encode(self, x: np.ndarray) -> np.ndarray:
        x = _units(x)
        return np.stack([self._assign(x[:, a:b], c) for a, b, c in zip(self.cuts, self.cuts[1:], self.centres)],
                        axis=1).astype(np.uint8)

    def table(self, q: np.ndarray) -> np.ndarray:
        """Products of the unit query with every centre: (subspaces, CENTRES)."""
        q = _units(q[None])[0]
        out = np.zeros((len(self.centres), CENTRES))
        for s, (a, b, c) in enumerate(zip(self.cuts, self.cuts[1:], self.centres)):
            out[s, :len(c)] = c @ q[a:b]
        return out


def train_codes(chunks: DataFrame, subspaces: int = SUBSPACES) -> Codebook | None:
    """A codebook from a hash sample of about ``TRAIN_ROWS`` vectors; None without vectors."""
    v = chunks.where(F.col("embedding").isNotNull()).select("artifact_id", "chunk_index", "embedding")
    every = max(1, v.count() // TRAIN_ROWS)
    rows = v.where(F.pmod(F.xxhash64("artifact_id", "chunk_index"), F.lit(every)) == 0).select("embedding").limit(2 * TRAIN_ROWS).collect()
    return Codebook(np.array([r[0] for r in rows], np.float64), subspaces) if rows else None


def encoded(chunks: DataFrame, book: Codebook) -> DataFrame:
    """The code table: (artifact_id, chunk_index, repo_name, artifact_url, code), one row per non-zero vector."""
    shared = chunks.sparkSession.sparkContext.broadcast(book)
    names = ["artifact_id", "chunk_index", "repo_name", "artifact_url"]

    def run(batches):
        for b in batches:
            x = matrix(b.column("embedding"))
            use = np.flatnonzero(x.any(axis=1))
            if len(use):
                codes = [c.tobytes() for c in shared.value.encode(x[use])]
                yield pa.RecordBatch.from_arrays([*(b.column(n).take(pa.array(use)) for n in names), pa.array(codes, pa.binary())],
                                                 [*names, "code"])

    src = chunks.where(F.col("embedding").isNotNull()).select(
        "artifact_id", F.col("chunk_index").cast("long").alias("chunk_index"), "repo_name", "artifact_url", "embedding")
    return src.mapInArrow(run, "artifact_id long, chunk_index long, repo_name string, artifact_url string, code binary")


def candidates(queries: DataFrame, codes: DataFrame, book: Codebook, k: int) -> DataFrame:
    """(query_id, artifact_url, artifact_id, chunk_index, dist): the codes nearest to each query by table lookups.

    Per query: the share ``RERANK_SHARE`` of its repository's vectors, ``RERANK_MOST`` at most and ``k`` at
    least; of an artifact no more than leaves room for some 4 ``k`` artifacts (one at least).
    """
    sizes = codes.groupBy("repo_name").agg(F.count("*").alias("n"))
    most = {r[0]: int(min(max(k, r[1] * RERANK_SHARE), RERANK_MOST)) for r in sizes.collect()}  # one row per repository
    found = None
    for block in query_blocks(queries, QUERY_BLOCK):
        tables = {repo: [book.table(q) for q in vs] for repo, vs in block.vectors.items()}
        shared = codes.sparkSession.sparkContext.broadcast((block.ids, tables, most))

        def run(batches, shared=shared):
            ids, tables, most = shared.value
            held: dict[int, list] = {}
            for b in batches:
                repos = b.column("repo_name").dictionary_encode()
                which = repos.indices.to_numpy()
                for code, repo in enumerate(repos.dictionary.to_pylist()):
                    if repo not in ids:
                        continue
                    at = np.flatnonzero(which == code)
                    part = b.take(pa.array(at))
                    c = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(at), -1)
                    urls = np.array(part.column("artifact_url").to_pylist(), object)
                    chunk, artifact = part.column("chunk_index").to_numpy(), part.column("artifact_id").to_numpy()
                    lanes, r = np.arange(c.shape[1]), most[repo]
                    for qid, t in zip(ids[repo], tables[repo]):
                        dist = 1.0 - t[lanes, c].sum(axis=1)
                        old = held.get(qid)
                        parts = (dist, urls, artifact, chunk)
                        if old is not None:
                            parts = tuple(np.concatenate(p) for p in zip(old, parts))
                        use = np.lexsort((parts[3], parts[0], parts[1]))  # by artifact
                        own = parts[1][use]
                        head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                        nth = np.arange(len(own)) - np.repeat(head, np.diff([*head, len(own)]))
                        use = use[nth < max(1, r // (4 * k))]
                        use = use[np.lexsort((parts[3][use], parts[1][use], parts[0][use]))[:r]]
                        held[qid] = tuple(p[use] for p in parts)
            for qid, (dist, urls, artifact, chunk) in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(dist), qid)), pa.array(urls, pa.string()), pa.array(artifact), pa.array(chunk), pa.array(dist)],
                    [*_KEYS, "dist"])

        own = codes.mapInArrow(run, _CANDIDATE)
        found = own if found is None else found.unionByName(own)
    if found is None:
        return codes.sparkSession.createDataFrame([], _CANDIDATE)
    repo_of = queries.select("query_id", "repo_name")
    per_repo = codes.sparkSession.createDataFrame([*most.items()] or [("", 0)], "repo_name string, most long")
    limits = repo_of.join(per_repo, "repo_name").select("query_id", "most")
    asked = found.join(limits, "query_id")
    nth = Window.partitionBy("query_id", "artifact_url").orderBy("dist", "chunk_index")
    some = asked.withColumn("nth", F.row_number().over(nth)).where(
        F.col("nth") <= F.greatest(F.lit(1), F.floor(F.col("most") / (4 * k))))
    ranked = top_k(some, ["query_id"], [F.col("dist").asc(), F.col("artifact_url").asc(), F.col("chunk_index").asc()], RERANK_MOST, "place")
    return ranked.where(F.col("place") <= F.col("most")).select(*_KEYS, "dist")


def ann_search(queries: DataFrame, chunks: DataFrame, k: int = 10, codes: DataFrame | None = None,
               book: Codebook | None = None) -> DataFrame:
    """(query_id, rank, artifact_url, artifact_id, chunk_index, dist, n_candidates): candidates by codes, ranked exactly."""
    book = book or train_codes(chunks)
    if book is None:
        return nearest(queries, chunks, k).withColumn("n_candidates", F.lit(0).cast("long"))
    codes = codes if codes is not None else encoded(chunks, book).checkpoint()
    near = candidates(queries, codes, book, k).checkpoint()
    asked = queries.where(F.col("query_vec").isNotNull()).select("query_id", "query_vec")
    vectors = chunks.select("artifact_id", F.col("chunk_index").cast("long").alias("chunk_index"), "embedding")
    pairs = near.drop("dist").join(vectors, ["artifact_id", "chunk_index"]).join(asked, "query_id")

    def run(batches):
        for b in batches:
            x, q = matrix(b.column("embedding")), matrix(b.column("query_vec"))
            dist = 1.0 - np.einsum("ij,ij->i", x, q) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", q, q))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in _KEYS), pa.array(dist)], [*_KEYS, "dist"])

    exact = pairs.select(*_KEYS, "embedding", "query_vec").mapInArrow(run, _CANDIDATE)
    counts = near.groupBy("query_id").agg(F.count("*").alias("n_candidates"))
    return best_per_artifact(exact, k).join(counts, "query_id")


def ann_recall(queries: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    """Per query: recall@k of the coded search against exact search, and the share of its repository's vectors ranked exactly."""
    exact = nearest(queries, chunks, k).select("query_id", "artifact_url")
    approx = ann_search(queries, chunks, k).select("query_id", "artifact_url", "n_candidates")
    j = exact.join(approx, ["query_id", "artifact_url"], "left")
    per = j.groupBy("query_id").agg(F.count("*").alias("n_exact"), F.count("n_candidates").alias("n_found"),
                                    F.max("n_candidates").alias("n_candidates"))
    sizes = chunks.where(F.col("embedding").isNotNull()).groupBy("repo_name").agg(F.count("*").alias("n_vectors"))
    return per.join(queries.select("query_id", "repo_name"), "query_id").join(sizes, "repo_name").select(
        "query_id", "n_exact", "n_found", (F.col("n_found") / F.col("n_exact")).alias("recall"),
        F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), "n_vectors",
        (F.coalesce("n_candidates", F.lit(0)) / F.col("n_vectors")).alias("share_ranked"))
