"""Arrow and numpy helpers that run inside ``mapInArrow`` tasks.

Text columns are handled as one flat UTF-8 buffer per block, so the work per
byte is vectorised and memory is bounded by the block (or by one text, where a
single text is longer than a block).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitals.session import scratch_path

BLOCK_BYTES = 1 << 20

_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64-bit word."""
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX1
    h = h ^ (h >> np.uint64(27))
    h = h * _MIX2
    return h ^ (h >> np.uint64(31))


#: One random 64-bit value per byte, from a rule, for polynomial word hashes.
BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * _BASE)


def utf8_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    col = pc.fill_null(col, "")
    if col.type != pa.string():
        col = col.cast(pa.string())
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def utf8_list(col: pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8; a null is an empty text."""
    return pc.fill_null(col, "").cast(pa.binary()).to_pylist()


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that carry texts to and from Python workers.

    The usual bound counts rows alone, and ten thousand long texts would fill a
    worker. A smaller bound that the session already has stays.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000),
                      ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def text_blocks(batches: Iterator[pa.RecordBatch], column: str,
                max_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``max_bytes`` of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = utf8_buffer(batch.column(column))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(off, off[a] + max_bytes, "right")) - 1)
            yield batch.slice(a, b - a)
            a = b


def map_blocks(df: DataFrame, text_column: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch],
               schema: str, max_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Apply ``fn`` to every bounded block of ``df``."""
    def run(batches):
        for block in text_blocks(batches, text_column, max_bytes):
            yield fn(block)
    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


class Words:
    """Words of a block of texts: runs of the bytes that ``is_word`` marks.

    ``start``/``end`` are byte positions in ``data``, ``doc`` the row of each word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
        self.data, self.offsets = data, offsets
        mask = is_word[data]
        first = mask.copy()
        first[1:] &= ~mask[:-1]
        last = mask.copy()
        last[:-1] &= ~mask[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        first[inner] = mask[inner]
        last[inner - 1] = mask[inner - 1]
        self.mask = mask
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.counts = np.bincount(self.doc, minlength=len(offsets) - 1)

    def __len__(self) -> int:
        return len(self.start)

    def text(self, i: int) -> str:
        return self.data[self.start[i]:self.end[i]].tobytes().decode("utf-8", "replace")

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self):
            return np.empty(0, np.uint64)
        lens = self.end - self.start
        heads = np.cumsum(lens) - lens
        pos = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(heads, lens)
        powers = np.full(int(lens.max()), _BASE, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers)
        return mix64(np.add.reduceat(BYTE_VALUES[self.data[self.mask]] * powers[pos], heads)
                     + lens.astype(np.uint64))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A copy with the bytes A-Z turned into a-z."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: a lost executor costs only the running stage, not the
    work before it, and consumers of the table do not repeat that work.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    w = df.write.mode("overwrite")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def crc32_fold(doc_id: Column, folds: int) -> Column:
    """``crc32`` of the id as text, modulo ``folds`` (null ids: null)."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % F.lit(folds)
