"""Vectors of chunks (H3) and the chunk store that grows by what is missing.

The built-in embedder is signed feature hashing: every token adds 1 or -1 to
one of ``EMBED_DIM`` slots, both taken from the first 16 bits of its MD5. The counts
are kept as whole numbers, so cosines of them are the same in any order
of addition; the cosine ignores their length. Each chunk has a vector of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens

EMBED_DIM = 64
EMBED_BATCH = 64
_VECTOR = T.ArrayType(T.FloatType())


def token_slot(token: bytes, dim: int = EMBED_DIM) -> tuple[int, int]:
    """(slot, sign) of a token."""
    v = int.from_bytes(md5(token).digest()[:2], "big")
    return v % dim, 1 if v // dim % 2 == 0 else -1


def hashed_vectors(lists: pa.Array, dim: int = EMBED_DIM) -> np.ndarray:
    """Signed counts of every row's tokens; each distinct token of the batch is hashed once."""
    flat = lists.flatten().dictionary_encode()
    slots = np.array([token_slot(t, dim) for t in flat.dictionary.cast(pa.binary()).to_pylist()] or [(0, 0)], np.int64)
    codes = flat.indices.to_numpy()
    lens = np.diff(lists.offsets.to_numpy())
    at = np.repeat(np.arange(len(lists)), lens) * dim + slots[codes, 0]
    return np.bincount(at, slots[codes, 1], len(lists) * dim).reshape(len(lists), dim)


def _as_lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel().astype(np.float32)))


def embed_text(df: DataFrame, text: str, out: str, dim: int = EMBED_DIM) -> DataFrame:
    """``df`` with the hashed vector of a text column (null text: null). Tokenising stays in the JVM."""
    names = df.columns
    src = df.withColumn("__tokens", tokens(F.col(text)))
    schema = T.StructType([*df.schema.fields, T.StructField(out, _VECTOR)])

    def run(batches):
        for b in batches:
            lists = b.column("__tokens")
            known = lists.is_valid()
            full = lists if not lists.null_count else lists.fill_null(pa.scalar([], lists.type))
            vectors = _as_lists(hashed_vectors(full, dim))
            if lists.null_count:
                vectors = pa.array([v if k else None for v, k in zip(vectors.to_pylist(), known.to_pylist())], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), vectors], [*names, out])

    return src.mapInArrow(run, schema)


def embed_chunks(chunks: DataFrame, embed_fn: Callable | None = None,
                 batch_size: int = EMBED_BATCH, dim: int = EMBED_DIM) -> DataFrame:
    """Add ``embedding array<float>`` to each chunk.

    Without ``embed_fn`` the hashing embedder is used. With ``embed_fn(list[str]) -> list[list[float]]``
    (e.g. a model client) the texts are handed over in batches of ``batch_size``.
    """
    if embed_fn is None:
        return embed_text(chunks, "text", "embedding", dim)
    out_schema = T.StructType([*chunks.schema.fields, T.StructField("embedding", _VECTOR)])

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            vectors = [v for i in range(0, len(texts), batch_size) for v in embed_fn(texts[i:i + batch_size])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([[float(x) for x in v] for v in vectors], pa.list_(pa.float32()))],
                                             [*b.schema.names, "embedding"])

    return chunks.mapInArrow(run, out_schema)


def missing_artifacts(artifacts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Artifacts without a chunk in the store (C5); of the store only the id column is read."""
    return artifacts.join(chunks.select("artifact_id").distinct(), "artifact_id", "left_anti")


def append_missing(spark: SparkSession, artifacts: DataFrame, path: str,
                   embed_fn: Callable | None = None) -> DataFrame:
    """Chunk and embed the artifacts that the store at ``path`` lacks, append them, and return the store.

    The rows to append are checkpointed first: they are computed from the store as it was, and
    a job that is run again after its append finds nothing missing. Artifacts with an
    empty body have no chunk and are looked at again every time.
    """
    from pyspark.errors import AnalysisException
    from .retrieval import chunk_artifacts
    try:
        store = spark.read.parquet(path)
        artifacts = missing_artifacts(artifacts, store)
    except AnalysisException:  # no store yet: everything is missing
        pass
    new = embed_chunks(chunk_artifacts(artifacts), embed_fn).checkpoint()
    new.write.mode("append").parquet(path)
    return spark.read.parquet(path)
