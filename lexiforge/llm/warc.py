"""WARC archives without repeated payloads.

The digests of all payloads are aggregated (partial sums before the shuffle), so each
payload that occurs more than once has one original: the record with the largest
page_id. A join by digest tells each page its original; every task then
writes its pages to an archive of its own, responses with the payload, revisits with a
reference to the original alone, each record a gzip member with fresh headers.

Edge cases: a null page counts as the empty payload; payloads under min_bytes are never revisits;
where every copy has a null page_id all are responses, else a null page_id is the smallest;
rows that repeat both page_id and payload of the original are responses as well; a null url is written empty;
an empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, make_folder, materialize, new_path, task_file

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, n_records long, n_bytes long"
ARCHIVE_BYTES = 1 << 30
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def with_originals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with record_type, refers_to and the original's url.

    The join by digest reads two stored tables, so that a digest of very many pages is split by the adaptive skew join.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    pages = pages.withColumn("digest", F.unhex(F.sha1("payload")))
    found = pages.where(F.length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("origin"), F.max(F.struct("page_id", "url"))["url"].alias("origin_url"), F.count("*").alias("copies"))
    originals = materialize(found.where((F.col("copies") > 1) & F.col("origin").isNotNull()).drop("copies"), "originals")
    revisit = F.col("origin").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("origin"))
    return pages.join(originals, "digest", "left").select(
        "page_id", "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("origin")).alias("refers_to"), F.when(revisit, F.col("origin_url")).alias("origin_url")
    )


def record_id(page_id: int | None, url: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {url}')}>"


def one_line(text: str) -> str:
    """A header's value: no line breaks."""
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id, url: str, payload: bytes, kind: str, origin, origin_url, date: str) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        ("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, url, digest)), ("WARC-Date", date), ("WARC-Target-URI", one_line(url)), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"), ("Page-Id", "" if page_id is None else str(page_id)), ("Payload-Length", str(len(payload))),
    ]
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(origin, origin_url, digest)), ("WARC-Refers-To-Target-URI", one_line(origin_url)), ("WARC-Refers-To-Date", date), ("Refers-To-Page-Id", str(origin))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2025-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) below folder; returns the manifest of the archives that finished tasks wrote."""
    make_folder(folder)

    def run(batches):
        part, sink, path, n, size = TaskContext.get().partitionId(), None, "", 0, 0
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if sink is None:
                    path = task_file(folder, part, ".warc.gz")
                    files, where = filesystem(path)
                    sink, n, size = files.open_output_stream(where, compression=None), 0, 0
                page_id, url, payload, kind, origin, origin_url = row
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = pack.compress(record(page_id, url, payload, kind, origin, origin_url, date)) + pack.flush()
                sink.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    sink.close()
                    sink = None
                    yield pa.RecordBatch.from_pylist([{"path": path, "n_records": n, "n_bytes": size}])
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "n_records": n, "n_bytes": size}])

    return materialize(with_originals(pages, min_bytes).mapInArrow(run, MANIFEST), "warc-manifest")


def records(stream, chunk: int = 1 << 20):
    """The records of a gzipped archive, one after the other: (headers, block)."""
    data, rest = b"", stream.read(chunk)
    unpack = zlib.decompressobj(31)
    parts: list[bytes] = []
    while rest or unpack.unconsumed_tail:
        parts.append(unpack.decompress(rest))
        if unpack.eof:
            data, rest = b"".join(parts), unpack.unused_data or stream.read(chunk)
            parts, unpack = [], zlib.decompressobj(31)
            head, _, body = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            size = int(fields["Content-Length"])
            if body[size:] != b"\r\n\r\n":
                raise ValueError("a record's length is wrong")
            yield fields, body[:size]
        else:
            rest = stream.read(chunk)
    if parts:
        raise ValueError("the archive breaks off")


def read_archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """RECORD for every record of the archives; payload is null for a revisit. Digests of payloads are verified."""
    names = [x.split()[0] for x in RECORD.split(", ")]

    def rows(path: str):
        files, where = filesystem(path)
        with files.open_input_stream(where, compression=None) as stream:
            for f, block in records(stream):
                kind, digest = f["WARC-Type"], f["WARC-Payload-Digest"].removeprefix("sha1:")
                payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                if payload is not None and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"{path}: a payload differs from its digest")
                yield int(f["Page-Id"]) if f["Page-Id"] else None, f["WARC-Target-URI"], int(f["Payload-Length"]), digest, kind, int(f["Refers-To-Page-Id"]) if kind == "revisit" else None, payload

    def run(batches):
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for b in batches:
            for path in b.column(0).to_pylist():
                out, held = [], 0
                for r in rows(path):
                    out.append(r)
                    held += 200 + len(r[-1] or b"")
                    if held > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    paths = manifest.select("path")
    return paths.repartition(max(1, manifest.count())).mapInArrow(run, RECORD)


def deduplicated_archives(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write the archives and read them back."""
    spark = pages.sparkSession
    return read_archives(spark, write_archives(pages, folder or new_path(spark, "warc"), min_bytes))
