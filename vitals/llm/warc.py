"""WARC archives: writer with revisits and a splittable reader.

Writing: one gzip member per record, one archive per partition. Records whose
payloads are equal (SHA-256, ``min_bytes`` long at least) are stored once: the
smallest page_id is the ``response``, the others are ``revisit`` records that
carry the digest and length in their headers and refer to it. Only digests that
occur more than once are joined back.

Reading: archives are cut into byte ranges, of which a task takes several. It seeks to a range, looks for
the gzip magic, accepts a candidate only if the member inflates to a WARC
header, and owns the records that start inside its range; the last one may end
beyond it.

Null html is an empty payload, null urls are left out. Rows that repeat the
smallest page_id are all responses; where all ids of a payload are null, all
rows are responses. A null page_id has no X-Page-ID header, and a record id of its archive and
place. Without rows there are no archives and no records.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitals.llm.blocks import bounded_batches, text_blocks, utf8_list, written
from vitals.llm.shared_files import folder, fresh_name, mapped
from vitals.session import scratch_path

MIN_BYTES = 100
SPLIT_BYTES = 4 << 20
TASK_BYTES = 128 << 20
READ_BYTES = 1 << 16
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str,
           refers_to: int | None, date: str, place: str) -> bytes:
    """One WARC record, uncompressed; ``place`` names it where it has no page_id."""
    body = payload if kind == "response" else b""
    urn = f"<urn:page:{page_id}>" if page_id is not None else f"<{uuid.uuid5(uuid.NAMESPACE_URL, place).urn}>"
    head = [("WARC-Type", kind), ("WARC-Record-ID", urn), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha256:{digest}"),
            ("X-Payload-Length", str(len(payload))), ("Content-Type", "text/html; charset=utf-8"),
            ("Content-Length", str(len(body)))]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\r\n]+", " ", url)))
    if kind == "revisit":
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    text = "".join(f"{k}: {v}\r\n" for k, v in head)
    return VERSION + text.encode() + b"\r\n" + body + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, out_dir: str) -> list[tuple[str, int]]:
    """Write ``pages`` (page_id, url, html); (file name, bytes) per archive."""
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                       F.coalesce("html", F.lit("")).alias("html"))
    src = src.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    same = written(src.where(F.octet_length("html") >= MIN_BYTES).groupBy("digest")
                   .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"),
                   "warc-same")
    rows = src.join(same, "digest", "left").select(
        "page_id", "url", "html", "digest",
        F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches):
        fs, path = folder(out_dir)
        name = fresh_name(f"part-{TaskContext.get().partitionId():06d}", ".warc.gz")
        size = 0
        out = None
        for b in text_blocks(batches, "html"):
            out = out or fs.open_output_stream(f"{path}/{name}", compression=None)
            cols = [b.column(c).to_pylist() for c in ("page_id", "url", "digest", "refers_to")]
            for page_id, url, digest, refers, payload in zip(*cols, utf8_list(b.column("html"))):
                kind = "response" if refers is None else "revisit"
                member = gzip_member(record(kind, page_id, url, payload, digest, refers, date, f"{name}:{size}"))
                out.write(member)
                size += len(member)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"name": name, "bytes": size}],
                                             pa.schema([("name", pa.string()), ("bytes", pa.int64())]))

    bounded_batches(pages.sparkSession)
    return sorted(tuple(r) for r in rows.mapInArrow(run, "name string, bytes long").collect())


class _Window:
    """A file read forward from a position, with the bytes in view kept."""

    def __init__(self, f, at: int):
        self.f, self.at, self.data = f, at, b""
        f.seek(at)

    def more(self) -> bool:
        got = self.f.read(READ_BYTES)
        self.data += got
        return bool(got)

    def drop(self, n: int) -> None:
        self.data = self.data[n:]
        self.at += n

    def starts_record(self) -> bool:
        """Whether a member that inflates to a WARC header starts here; stays in place."""
        z = zlib.decompressobj(31)
        head, fed = b"", 0
        while len(head) < len(VERSION) and not z.eof:
            if fed == len(self.data) and not self.more():
                return False
            try:
                head += z.decompress(self.data[fed:])
            except zlib.error:
                return False
            fed = len(self.data)
        return head.startswith(VERSION)

    def member(self) -> bytes:
        """The content of the member that starts here; moves behind it."""
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if not self.data and not self.more():
                raise ValueError("the archive ends within a record")
            out.append(z.decompress(self.data))
            self.at += len(self.data) - len(z.unused_data)
            self.data = z.unused_data
        return b"".join(out)


def read_range(f, start: int, end: int):
    """Decoded records whose members start in [start, end)."""
    w = _Window(f, start)
    synced = start == 0
    while not synced and w.at < end:
        i = w.data.find(MAGIC)
        if i < 0:
            w.drop(max(0, len(w.data) - len(MAGIC) + 1))
            if not w.more():
                return
        elif i:
            w.drop(i)
        elif w.starts_record():
            synced = True
        else:
            w.drop(1)
    while w.at < end and (w.data or w.more()):
        data = w.member()
        if not data.startswith(VERSION):
            raise ValueError(f"no WARC record before byte {w.at}")
        yield data


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, body) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return fields, rest[:int(fields["Content-Length"])]


def _page_of(uri: str | None) -> int | None:
    return int(uri[len("<urn:page:"):-1]) if uri else None


RECORD_SCHEMA = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
                 "refers_to long, html string")


def read_archives(spark: SparkSession, out_dir: str, files: list[tuple[str, int]],
                  split_bytes: int = SPLIT_BYTES, payload: bool = False) -> DataFrame:
    """One row per record; html (null for revisits) only with ``payload``."""
    schema = RECORD_SCHEMA if payload else RECORD_SCHEMA.rpartition(",")[0]
    if not files:
        return spark.createDataFrame([], schema)
    names = [c.split()[0] for c in schema.split(", ")]
    types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64()}
    arrow = pa.schema([(n, types.get(n, pa.string())) for n in names])
    # several ranges a task on large sets, all slots in use on small ones
    ranges = sum(-(-size // split_bytes) for _, size in files)
    tasks = max(-(-sum(size for _, size in files) // TASK_BYTES), min(ranges, 2 * spark.sparkContext.defaultParallelism))
    cut = (spark.createDataFrame(files, "name string, bytes long")
              .select("name", "bytes", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(split_bytes))).alias("at"))
              .repartition(tasks))

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                rows, held = [], 0
                with mapped(out_dir, r["name"]) as f:
                    for data in read_range(f, r["at"], min(r["bytes"], r["at"] + split_bytes)):
                        h, body = parse(data)
                        full = h["WARC-Type"] == "response"
                        rows.append({
                            "page_id": int(h["X-Page-ID"]) if "X-Page-ID" in h else None, "url": h.get("WARC-Target-URI"),
                            "payload_bytes": len(body) if full else int(h["X-Payload-Length"]),
                            "payload_digest": hashlib.sha256(body).hexdigest() if full
                            else h["WARC-Payload-Digest"].removeprefix("sha256:"),
                            "record_type": h["WARC-Type"], "refers_to": _page_of(h.get("WARC-Refers-To")),
                            **({"html": body.decode() if full else None} if payload else {})})
                        held += len(body) if payload else 0
                        if len(rows) >= 1000 or held >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, arrow)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    return cut.mapInArrow(run, schema)


def round_trip(pages: DataFrame, out_dir: str | None = None, split_bytes: int = SPLIT_BYTES,
               payload: bool = False) -> DataFrame:
    """Write ``pages`` as archives (to the shared folder by default) and read them back."""
    spark = pages.sparkSession
    out_dir = out_dir or scratch_path(spark, "warc")
    return read_archives(spark, out_dir, write_archives(pages, out_dir), split_bytes, payload)
