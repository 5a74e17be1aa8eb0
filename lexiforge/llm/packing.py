"""Packing token ids into fixed sequences: concatenate and cut.

Pass 1 tokenises every document and keeps, for each partition, running token
counts. The totals of the partitions (one row for each scan task) give each
partition its global offset by a prefix sum; pass 2 cuts the ids at the
multiples of the sequence length, each task on its own rows. No row is
shuffled: only the totals move.

Edge cases: a null or empty text holds the end id alone; a document longer than a
sequence spans many; rows with equal doc_id are packed each for itself; an empty table gives
no piece; a null doc_id stays null. Only the last sequence can be short: it counts as
padded unless its length is a power of two.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tidy
from .tokens import encoder
from .vectors import batches_of

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenise(docs: DataFrame, tokenizer: str, end_id: int, words: bool = False, release: bool = False) -> DataFrame:
    """doc_id, part, place (ids of the partition before the document), n_tokens, ids (packed, end_id last), in scan order, without a shuffle.

    release: drop the tokenizer and its unit cache at the end of each task, for jobs whose other stages need the workers' memory.
    """

    def run(batches):
        enc, part, place = encoder(tokenizer, words), TaskContext.get().partitionId(), 0
        end, width = np.array([end_id], enc.dtype).tobytes(), enc.dtype.itemsize
        for b in batches:
            ids = [enc.encode(x) + end for x in b.column(1).to_pylist()]
            n = np.array([len(x) // width for x in ids], np.int64)
            at = place + np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
            place += int(n.sum())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([part] * len(n), pa.int64()), pa.array(at), pa.array(n), pa.array(ids, pa.binary())], ["doc_id", "part", "place", "n_tokens", "ids"])
        if release:
            encoder.cache_clear()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, part long, place long, n_tokens long, ids binary")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, words: bool = False, with_ids: bool = True, release: bool = False) -> DataFrame:
    """One row per piece: PIECES, then padded_length (of its sequence) and, with_ids, the piece's ids.

    Driver memory: two numbers for each scan task of the input.
    """
    spark = docs.sparkSession
    with batches_of(spark, 1000):
        tokens = materialize(tokenise(docs, tokenizer, end_id, words, release), "pack")
    totals = {r["part"]: r["n"] for r in tokens.groupBy("part").agg(F.max(F.col("place") + F.col("n_tokens")).alias("n")).collect()}
    base, total = {}, 0
    for part in sorted(totals):
        base[part], total = total, total + totals[part]
    last, rest = divmod(total, length)
    padded = rest if rest & (rest - 1) == 0 else length
    base = spark.sparkContext.broadcast(base)

    def run(batches):
        names = [x.split()[0] for x in PIECES.split(", ")] + ["padded_length"] + ["ids"] * with_ids
        for b in batches:
            if not b.num_rows:
                continue
            place, n = (b.column(k).to_numpy() for k in (2, 3))
            at = place + np.array([base.value[p] for p in b.column(1).to_pylist()], np.int64)
            # the sequences that each document has a piece in, one after the other
            first, pieces = at // length, (at + n - 1) // length - at // length + 1
            doc = np.repeat(np.arange(len(n)), pieces)
            seq = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces) + first[doc]
            start = np.maximum(seq * length - at[doc], 0)
            size = np.minimum((seq + 1) * length - at[doc], n[doc]) - start
            packed = b.column(4).cast(pa.large_binary())
            offsets = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset : packed.offset + len(n) + 1]
            # a token's width follows from the bytes: the tokenizer itself is not needed here
            width = int(offsets[-1] - offsets[0]) // int(n.sum())
            ids = np.frombuffer(packed.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(f"<u{width}").astype("<u4", copy=False)
            data, lo = memoryview(ids).cast("B"), 4 * ((offsets[:-1] - offsets[0])[doc] // width + start)
            cuts = list(zip(lo.tolist(), (lo + 4 * size).tolist(), strict=True))
            crc = pa.array([zlib.crc32(data[i:j]) for i, j in cuts], pa.int64())
            columns = [b.column(0).take(pa.array(doc)), pa.array(start), pa.array(size), crc, pa.array(n[doc]), pa.array(seq), pa.array(at[doc] + start - seq * length), pa.array(np.where(seq == last, padded, length))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array([bytes(data[i:j]) for i, j in cuts], pa.binary())] * with_ids, names)

    return tokens.select("doc_id", "part", "place", "n_tokens", "ids").mapInArrow(run, PIECES + ", padded_length long" + ", ids binary" * with_ids)
