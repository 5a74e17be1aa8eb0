"""Token ids as sorted string tables.

A shard is one file, its documents ordered by identifier:

    data blocks  entries: varint shared key bytes, varint other key bytes, varint value bytes, the rest of the
                 key, the value; every 16th entry holds its whole key. A block is compressed and has a CRC-32.
    index        for each block: last key, place, size
    Bloom filter over the identifiers
    footer       places and sizes of the index and the filter, counts, magic

Key: 1 byte (0 for a null identifier), the identifier with its sign bit
inverted in big-endian order, and a 4-byte counter for rows with equal
identifiers. Value: ids of the whole text with the end id, packed.

The tasks of the scan encode the texts. Documents are then dealt by ranges of the identifier, sorted in each range and written by one task
each; a task writes to a name of its own, and only names that finished tasks report are read, so a
repeated or speculative attempt does no harm. The start of a document is the sum of the shards before
its own and of the documents before it in the shard.
"""

from __future__ import annotations

import bisect
import struct
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, filesystem, make_folder, materialize, new_path, task_file, tidy
from .packing import tokenise
from .tokens import encoder
from .vectors import batches_of

MAGIC = b"LXSST001"
FOOTER = struct.Struct("<QIQIQQII8s")
RESTART, BLOCK_BYTES, BLOOM_BITS, BLOOM_HASHES = 16, 256 << 10, 10, 7
SHARD_BYTES = 32 << 20
MANIFEST = "shard long, path string, n_docs long, n_tokens long"


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def doc_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:9])[0] - (1 << 63) if key[0] else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


class Writer:
    """Holds one block, the sparse index and 8 bytes for each identifier."""

    def __init__(self, sink, width: int):
        self.sink, self.width, self.place = sink, width, 0
        self.block, self.in_block, self.key, self.repeat = bytearray(), 0, b"", 0
        self.index, self.hashes, self.n_docs, self.n_tokens = [], [], 0, 0
        self.pack = zstandard.ZstdCompressor(level=1)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        stem = key_of(doc_id)
        self.repeat = self.repeat + 1 if self.n_docs and self.key[:9] == stem else 0
        key = stem + struct.pack(">I", self.repeat)
        if self.n_docs and key < self.key:
            raise ValueError("keys must come in order")
        shared = 0
        if self.in_block % RESTART:
            while shared < len(key) and key[shared] == self.key[shared]:
                shared += 1
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(ids)) + key[shared:] + ids
        self.key, self.in_block = key, self.in_block + 1
        if not self.repeat:
            self.hashes.append(xxhash.xxh64_intdigest(stem))
        self.n_docs, self.n_tokens = self.n_docs + 1, self.n_tokens + len(ids) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.in_block:
            data = self.pack.compress(bytes(self.block))
            data += struct.pack("<I", zlib.crc32(data))
            self.index.append((self.key, self.place, len(data)))
            self.put(data)
            self.block, self.in_block = bytearray(), 0

    def put(self, data: bytes) -> tuple[int, int]:
        at = self.place
        self.sink.write(data)
        self.place += len(data)
        return at, len(data)

    def close(self) -> None:
        self.flush()
        bits = max(64, BLOOM_BITS * len(self.hashes))
        bloom = np.zeros((bits + 7) // 8 * 8, np.uint8)
        h = np.array(self.hashes, np.uint64)
        for k in range(BLOOM_HASHES):
            bloom[bloom_place(h, k, bits).astype(np.int64)] = 1
        index = b"".join(varint(len(k)) + k + varint(at) + varint(n) for k, at, n in self.index)
        where = self.put(index) + self.put(np.packbits(bloom, bitorder="little").tobytes())
        self.put(FOOTER.pack(*where, self.n_docs, self.n_tokens, bits, self.width, MAGIC))


def bloom_place(h, k: int, bits: int):
    """Double hashing: both halves of one 64-bit hash."""
    return ((h & np.uint64(0xFFFFFFFF)) + np.uint64(k) * ((h >> np.uint64(32)) | np.uint64(1))) % np.uint64(bits)


class Table:
    """A shard, read block by block. get() looks one identifier up by the filter, a binary search of the index and a search of one block."""

    def __init__(self, uri: str):
        files, path = filesystem(uri)
        self.file = files.open_input_file(path)
        foot = self.at(self.file.size() - FOOTER.size, FOOTER.size)
        i_at, i_n, b_at, b_n, self.n_docs, self.n_tokens, self.bits, self.width, magic = FOOTER.unpack(foot)
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a token table")
        self.dtype = np.dtype(f"<u{self.width}")
        self.last, self.blocks, raw, at = [], [], self.at(i_at, i_n), 0
        while at < len(raw):
            n, at = read_varint(raw, at)
            self.last.append(raw[at : at + n])
            place, at = read_varint(raw, at + n)
            size, at = read_varint(raw, at)
            self.blocks.append((place, size))
        self.bloom = np.frombuffer(self.at(b_at, b_n), np.uint8)

    def at(self, place: int, n: int) -> bytes:
        return bytes(self.file.read_at(n, place))

    def block(self, k: int):
        data = self.at(*self.blocks[k])
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("damaged block")
        data, at, key = zstandard.ZstdDecompressor().decompress(data[:-4]), 0, b""
        while at < len(data):
            shared, at = read_varint(data, at)
            own, at = read_varint(data, at)
            size, at = read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            at += own
            yield key, data[at : at + size]
            at += size

    def scan(self):
        for k in range(len(self.blocks)):
            for key, ids in self.block(k):
                yield doc_of(key), ids

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with this identifier."""
        stem = key_of(doc_id)
        h = np.array([xxhash.xxh64_intdigest(stem)], np.uint64)
        for k in range(BLOOM_HASHES):
            place = int(bloom_place(h, k, self.bits)[0])
            if not self.bloom[place >> 3] >> (place & 7) & 1:
                return []
        out = []
        for k in range(bisect.bisect_left(self.last, stem), len(self.blocks)):
            for key, ids in self.block(k):
                if key[:9] == stem:
                    out.append(np.frombuffer(ids, self.dtype))
                elif key[:9] > stem:
                    return out
        return out

    def close(self) -> None:
        self.file.close()


def write_tables(docs: DataFrame, folder: str, tokenizer: str, end_id: int, words: bool, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write every text of docs (doc_id, text) as shards of about shard_bytes of ids below folder; returns the manifest, one row per shard, in order of the identifiers.

    Null texts count as empty, null identifiers come first, rows with equal identifiers stay all, ordered by
    a digest of their ids, and may fill several shards. An empty table gives no shard.
    """
    make_folder(folder)
    spark = docs.sparkSession
    # the scan's tasks encode, so that packed ids move, not texts
    with batches_of(spark, 1000):
        tokens = materialize(tokenise(docs, tokenizer, end_id, words).withColumn("tie", F.xxhash64("ids")), "tokens", "zstd")
    size = tokens.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    width = encoder(tokenizer, words).dtype.itemsize

    def run(batches):
        out = None
        for b in batches:
            if b.num_rows and out is None:
                part = TaskContext.get().partitionId()
                path = task_file(folder, part, ".sst")
                files, where = filesystem(path)
                sink = files.open_output_stream(where)
                out = Writer(sink, width)
            for doc, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out.add(doc, ids)
        if out is not None:
            out.close()
            sink.close()
            yield pa.RecordBatch.from_pylist([{"shard": part, "path": path, "n_docs": out.n_docs, "n_tokens": out.n_tokens}])

    # rows that repeat an identifier, or all have none, are dealt out by their digests and places
    keys = [F.col("doc_id").asc_nulls_first(), "tie", "part", "place"]
    ordered = tokens.repartitionByRange(size // shard_bytes + 1, *keys).sortWithinPartitions(*keys)
    with batches_of(spark, 1000):
        manifest = materialize(ordered.select("doc_id", "ids").mapInArrow(tidy(run), MANIFEST), "token-manifest")
    discard(tokens)
    return manifest


def read_tables(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids (32 bits each), one row per document of the shards.

    Driver memory: one row for each shard. A shard's counter of equal identifiers starts anew.
    """
    rows, start, plan = sorted(manifest.collect(), key=lambda r: r["shard"]), 0, []
    for r in rows:
        plan.append((r["path"], start))
        start += r["n_tokens"]
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]

    def run(batches):
        for b in batches:
            for path, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                table, out, held = Table(path), [], 0
                for doc, packed in table.scan():
                    ids = np.frombuffer(packed, table.dtype).astype("<u4").tobytes()
                    out.append((doc, at, len(ids) // 4, zlib.crc32(ids), ids))
                    at, held = at + len(ids) // 4, held + len(ids)
                    if held > 16 << 20:
                        yield batch(out)
                        out, held = [], 0
                table.close()
                if out:
                    yield batch(out)

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "ids" else pa.int64()) for k, c in zip(names, zip(*out, strict=True), strict=True)], names)

    shards = spark.createDataFrame(plan, "path string, start long").repartition(max(1, len(plan)))
    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def encode_to_tables(docs: DataFrame, tokenizer: str, end_id: int = 2, words: bool = True, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the shards and read them back."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    return read_tables(spark, write_tables(docs, folder, tokenizer, end_id, words, shard_bytes))
