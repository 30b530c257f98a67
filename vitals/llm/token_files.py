"""Token-id files: flat unsigned integers with 64-bit document offsets.

A set of files has one shard per partition of the doc_id order:

* ``<shard>.bin``: the ids of its documents one after another, little-endian
  ``uint16`` where every id of the vocabulary fits and ``uint32`` elsewhere;
* ``<shard>.idx``: little-endian ``int64``: the number of documents n, then n + 1 offsets
  (in ids, from the shard's first), n doc_ids and n flags (0: the doc_id is null).

The base of a shard is the prefix sum of the id counts before it; the manifest
(one row per shard) is all that passes through the driver. Reading maps the
files into memory and works shard by shard.

Order: doc_id ascending, null ids first, then a hash of the text and the text,
so rows with equal ids have a defined place. Null is the empty text and holds
the end id alone. Without rows there are no files and no documents.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vitals.llm.blocks import bounded_batches, text_blocks, utf8_list
from vitals.llm.pieces import CutBlock, WordTable, cuts_into_words, plain
from vitals.llm.shared_files import folder, fresh_name, mapped
from vitals.session import scratch_path

CACHE_WORDS = 500_000
MANY_WORDS = 2000
BLOCK_BYTES = 2 << 20


class LibraryEncoder:
    """Ids of the ``tokenizers`` library for whole texts.

    Where the file's rules allow it (``pieces``), a text's ids are those of its
    words, which repeat a lot: each is looked up once per block and encoded once per cache filling. Words of
    ASCII letters, which the normaliser and pre-tokeniser leave alone, go to the library's model directly.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = WordTable(self.encode_many, self.encode_whole, added, CACHE_WORDS) if cuts_into_words(path) else None
        self.model = self.tokenizer.model

    def encode_whole(self, text: bytes) -> bytes:
        ids = self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
        return array(self.code, ids).tobytes()

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Packed ids of every text of a column."""
        if self.words is None:
            return [self.encode_whole(t) for t in utf8_list(texts)]
        block = CutBlock(texts, self.words, self.dtype.itemsize)
        return block.joined(pa.array(block.packed, pa.binary()), b"").to_pylist()

    def encode_many(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of words without white space and added tokens."""
        out: list = [None] * len(words)
        other = []
        for i, w in enumerate(words):
            if plain(w):
                out[i] = array(self.code, [x.id for x in self.model.tokenize(w.decode())]).tobytes()
            else:
                other.append(i)
        for a in range(0, len(other), MANY_WORDS):
            own = other[a:a + MANY_WORDS]
            for i, e in zip(own, self.tokenizer.encode_batch_fast([words[i].decode("utf-8", "replace") for i in own],
                                                                  add_special_tokens=False)):
                out[i] = array(self.code, e.ids).tobytes()
        return out


_LOADED: dict[str, LibraryEncoder] = {}


def _load(path: str) -> LibraryEncoder:
    if path not in _LOADED:
        _LOADED[path] = LibraryEncoder(path)
    return _LOADED[path]


def _write_shard(fs, path: str, stem: str, batches, encoder: LibraryEncoder, end_id: int):
    end = np.array([end_id], encoder.dtype).tobytes()
    name = fresh_name(stem, "")
    size = encoder.dtype.itemsize
    lengths, ids, valid = [], [], []
    with fs.open_output_stream(f"{path}/{name}.bin") as out:
        for b in batches:
            packed = [ids + end for ids in encoder.encode(b.column("__text"))]
            out.write(b"".join(packed))
            lengths.append(np.fromiter(map(len, packed), np.int64, len(packed)) // size)
            known = b.column("doc_id")
            ids.append(known.fill_null(0).to_numpy().astype("<i8"))
            valid.append(known.is_valid().to_numpy(zero_copy_only=False).astype("<i8"))
    lens = np.concatenate([np.empty(0, np.int64), *lengths])
    offsets = np.concatenate([[0], np.cumsum(lens)]).astype("<i8")
    with fs.open_output_stream(f"{path}/{name}.idx") as out:
        for part in (np.array([len(lens)], "<i8"), offsets, *ids, *valid):
            out.write(part.tobytes())
    return name, len(lens), int(offsets[-1])


def write_token_files(docs: DataFrame, tokenizer_path: str, out_dir: str, end_id: int,
                      shards: int, text: str = "text") -> list[tuple[int, str, int, int]]:
    """Write the files below ``out_dir``; manifest rows (shard, name, base, n_docs)."""
    def run(batches):
        encoder = _load(tokenizer_path)
        fs, path = folder(out_dir)
        shard = TaskContext.get().partitionId()
        got = _write_shard(fs, path, f"shard-{shard:06d}", text_blocks(batches, "__text", BLOCK_BYTES), encoder, end_id)
        yield pa.RecordBatch.from_pylist(
            [{"shard": shard, "name": got[0], "docs": got[1], "ids": got[2]}],
            pa.schema([("shard", pa.int32()), ("name", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    bounded_batches(docs.sparkSession)
    tie = F.xxhash64("__text")
    order = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("__text"))
    order = order.repartitionByRange(shards, F.asc_nulls_first("doc_id"), tie)
    order = order.sortWithinPartitions(F.asc_nulls_first("doc_id"), tie, "__text")
    done = sorted(order.mapInArrow(run, "shard int, name string, docs long, ids long").collect())
    manifest, base = [], 0
    for shard, name, n, ids in done:  # one row per shard
        if n:
            manifest.append((shard, name, base, n))
        base += ids
    return manifest


def read_token_files(spark: SparkSession, out_dir: str, manifest: list[tuple[int, str, int, int]],
                     dtype: str, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, and on request the ids."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    if not manifest:
        return spark.createDataFrame([], schema)
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    kind = np.dtype(dtype)

    def run(batches):
        for b in batches:
            for i in b.column(0).to_pylist():
                _, name, base, n = manifest[i]
                with mapped(out_dir, f"{name}.idx") as f:
                    idx = np.frombuffer(f.read_buffer(), "<i8")
                offsets, ids, valid = idx[1:n + 2], idx[n + 2:2 * n + 2], idx[2 * n + 2:]
                with mapped(out_dir, f"{name}.bin") as f:
                    for a in range(0, n, 10_000):
                        z = min(n, a + 10_000)
                        f.seek(int(offsets[a]) * kind.itemsize)
                        flat = np.frombuffer(f.read_buffer(int(offsets[z] - offsets[a]) * kind.itemsize), kind)
                        cut = (offsets[a:z + 1] - offsets[a]).tolist()
                        crc = [zlib.crc32(flat[s:e].astype("<u4")) for s, e in zip(cut, cut[1:])]
                        cols = [pa.array(ids[a:z], mask=valid[a:z] == 0), pa.array(offsets[a:z] + base),
                                pa.array(np.diff(offsets[a:z + 1])), pa.array(crc, pa.int64())]
                        if with_ids:
                            cols.append(pa.array([flat[s:e].astype(np.int64) for s, e in zip(cut, cut[1:])],
                                                 pa.list_(pa.int64())))
                        yield pa.RecordBatch.from_arrays(cols, names)

    return spark.range(0, len(manifest), 1, len(manifest)).mapInArrow(run, schema)


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int, text: str = "text",
                out_dir: str | None = None, with_ids: bool = False) -> DataFrame:
    """Write ``docs`` as token files (to the shared folder by default) and read them back."""
    spark = docs.sparkSession
    out_dir = out_dir or scratch_path(spark, "tokens")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    manifest = write_token_files(docs, tokenizer_path, out_dir, end_id, shards, text)
    vocab = Tokenizer.from_file(tokenizer_path).get_vocab_size()
    return read_token_files(spark, out_dir, manifest, "<u2" if vocab <= 1 << 16 else "<u4", with_ids)
