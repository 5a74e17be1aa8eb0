"""Exact substring dedup by a distributed merge sort of suffixes that knows common prefixes.

A byte is removed if a string of LENGTH bytes that covers it also starts anywhere else. Every window of LENGTH bytes is
assigned, by its content alone, to a reference position at most REACH bytes after its start (minimizers, each shared by the
windows around it). Equal windows thus have references with equal surroundings, so it is enough to sort
the suffixes at references, each with up to LENGTH bytes to the right and the bytes to the left that its windows need.

1. Fingerprints of the first LENGTH - REACH bytes of these suffixes are counted (partial sums before the shuffle). A suffix with a
   fingerprint of its own cannot share a window with another one, so its exchange would be wasted.
2. Each task sorts the remaining suffixes of its texts into runs. Equal entries of a run become one. Runs are
   front-coded (length of the common prefix with the entry before, then the rest) and compressed in blocks.
3. Splitters from a sample of block keys, 16 for each range and SAMPLE at least, cut the runs into at most MOST_RANGES ranges; whole blocks move, only those across a splitter
   are coded again. A range is merged by a loser tree that keeps for each run's head the length of its common
   prefix with the last entry put out: heads are compared by these lengths, and characters only from there on.
4. In the merged order, suffixes with windows in common are neighbours; common prefixes to the right and
   common suffixes to the left give the windows that two of them share.

A reference group with more than HOT entries (a passage in very many texts) is entered window by window instead: each
window is a suffix of its own there, compared to its full length, equal ones of a run become one, and so no task gathers the group.

Edge cases: null texts count as empty; texts under LENGTH bytes lose nothing; rows that agree in doc_id and text are
copies of each other; matches never cross rows; an empty table gives none; texts of any length are read whole. Fingerprints
only filter: a collision costs time and no result.
"""

from __future__ import annotations

import bisect
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .shingles import _BASE, _INVERSE, mix, powers
from .vectors import batches_of

LENGTH, REACH, SEED = 200, 70, 16
WINDOW = 2 * REACH  # starts that one minimizer can serve; WINDOW + SEED - 1 must not exceed LENGTH
STEM = LENGTH - REACH + 1
HOT = 20_000
RUN_BYTES, BLOCK_RECORDS, RANGE_BYTES, SAMPLE, MOST_RANGES, SLICE = 48 << 20, 512, 12 << 20, 20_000, 100_000, 1 << 20
RUNS = "kind int, run long, seq int, first binary, last binary, data binary"
HEAD = struct.Struct("<BBBBBII")


def fingerprints(sums: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n bytes at each place, from prefix sums of the text."""
    return mix((sums[at + n] - sums[at]) * powers(_INVERSE, len(sums))[at])


def prefix_sums(b: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(b)))])


def references(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(reference q, lo, hi, fingerprint): the windows that start at q - hi to q - lo belong to q; hi < REACH. Long texts are read in slices of SLICE window starts."""
    n = len(data) - LENGTH + 1
    parts = [slice_references(data[lo : min(n, lo + SLICE) + LENGTH - 1], lo) for lo in range(0, n, SLICE)]
    if not parts:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    q, first, last, prints = (np.concatenate([p[k] for p in parts]) for k in range(4))
    # a reference whose windows lie in two slices
    new = np.concatenate([[True], q[1:] != q[:-1]])
    at = np.flatnonzero(new)
    last = last[np.concatenate([at[1:], [len(q)]]) - 1]
    return q[at], q[at] - last, q[at] - first[at], prints[at]


def slice_references(data: bytes, start_at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(reference, first and last start of its windows, fingerprint) of a slice of a text that begins at start_at."""
    b = np.frombuffer(data, np.uint8)
    n = len(b) - LENGTH + 1
    sums = prefix_sums(b)
    m = n + WINDOW - 1
    value = (fingerprints(sums, np.arange(m), SEED) & np.uint64(0xFFFFFFFF00000000)) | np.arange(m).astype(np.uint64)
    wide = 1  # least value of the last `wide` places on, by doubling; ties go to the left
    while wide * 2 <= WINDOW:
        value = np.minimum(value[:-wide], value[wide:])
        wide *= 2
    if wide < WINDOW:
        value = np.minimum(value[: n + 0], value[WINDOW - wide : WINDOW - wide + n])
    least = (value[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.arange(n)
    q = np.where(least - start < REACH, least, least - REACH)
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
    last = np.concatenate([first[1:], [n]]) - 1
    q = q[first]
    return q + start_at, first + start_at, last + start_at, fingerprints(sums, q, STEM)


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    n = min(len(a), len(b))
    lo = known
    step = 16
    while lo < n:
        hi = min(n, lo + step)
        if a[lo:hi] != b[lo:hi]:
            if step == 1:
                return lo
            step = max(1, step // 4) if hi - lo > 1 else 1
        else:
            lo = hi
    return n


def common_suffix(a: bytes, b: bytes) -> int:
    n, k = min(len(a), len(b)), 0
    while k < n and a[-1 - k] == b[-1 - k]:
        k += 1
    return k


# An entry is (right, left, lo, multi, owner, place): bytes from the reference on, bytes before it, and the text that it comes from.


def encode_block(entries: list[tuple], prefix: int = 0) -> bytes:
    """prefix: what the first entry shares with the one before it in its run; it is stored, and the entry is whole all the same."""
    owners: dict = {}
    out, before = [], b""
    for right, left, lo, multi, owner, place in entries:
        k = common_prefix(before, right)
        out.append(HEAD.pack(k if out else prefix, len(right), len(left), lo, multi, owners.setdefault(owner, len(owners)), place) + right[k:] + left)
        before = right
    names = np.array(list(owners), "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<II", len(entries), len(owners)) + names + b"".join(out))


def decode_block(data: bytes):
    """Entries with the length of the common prefix with the entry before, which for the first is that of another block: (prefix, right, left, lo, multi, owner, place)."""
    data = zstandard.ZstdDecompressor().decompress(data)
    n, m = struct.unpack_from("<II", data)
    owners = np.frombuffer(data, "<i8", 2 * m, 8).reshape(m, 2).tolist()
    at, before = 8 + 16 * m, b""
    for i in range(n):
        k, wide, left, lo, multi, owner, place = HEAD.unpack_from(data, at)
        at += HEAD.size
        have = k if i else 0
        before = before[:have] + data[at : at + wide - have]
        at += wide - have
        yield k, before, data[at : at + left], lo, multi, tuple(owners[owner]), place
        at += left


def merge(runs: list):
    """Merge sorted runs (iterators as of decode_block()) by right bytes: yields (prefix with the entry before, right, left, ...).

    Loser tree: inner nodes hold the run that lost there; a loser's stored prefix is the one with the run that beat it.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads: list = [None] * k  # [prefix, entry] of each run
    for i, r in enumerate(runs):
        e = next(r, None)
        heads[i] = None if e is None else [0, e]

    def beats(i: int, j: int) -> bool:
        """Whether head i comes first; the loser's prefix becomes the one with the winner."""
        a, b = heads[i], heads[j]
        if b is None:
            return True
        if a is None:
            return False
        if a[0] != b[0]:
            return a[0] > b[0]  # both share prefixes with the same entry: the longer one is nearer to it; the loser's stays right
        x, y = a[1][1], b[1][1]
        n = common_prefix(x, y, a[0])
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            b[0] = n
            return True
        a[0] = n
        return False

    losers = [0] * k

    def play(node: int) -> int:
        if node >= k:
            return node - k
        i, j = play(2 * node), play(2 * node + 1)
        if beats(i, j):
            losers[node] = j
            return i
        losers[node] = i
        return j

    best = play(1) if k > 1 else 0
    while heads[best] is not None:
        prefix, e = heads[best]
        yield (prefix, *e[1:])
        new = next(runs[best], None) if best < len(runs) else None
        heads[best] = None if new is None else [new[0], new]
        node = (best + k) // 2
        while node:
            if not beats(best, losers[node]):
                best, losers[node] = losers[node], best
            node //= 2


def shared_windows(group: list[tuple]) -> list[tuple]:
    """Spans (owner, start, end) of windows that two entries of a group share. Entries: (right, left, lo, multi, owner, place)."""
    same: dict = {}
    for e in group:
        same.setdefault((e[0], e[1], e[2]), []).append(e)
    out = []
    kinds = list(same.items())
    alone = []
    for (_, left, lo), es in kinds:
        if len(es) > 1 or es[0][3]:
            out += [(e[4], e[5] - len(left), e[5] - lo + LENGTH) for e in es if not e[3]]
        else:
            alone.append(es[0])
    if len(kinds) < 2 or not alone:
        return out
    if len(kinds) <= 12:
        for e in alone:
            spans = []
            for (right, left, _), es in kinds:
                if es[0] is not e:
                    lo, hi = max(e[2], LENGTH - common_prefix(e[0], right)), common_suffix(e[1], left)
                    if lo <= hi:
                        spans.append((e[4], e[5] - hi, e[5] - lo + LENGTH))
            out += spans
        return out
    for at in range(max(len(left) for (_, left, _), _ in kinds) + 1):
        seen: dict = {}
        for (right, left, lo), es in kinds:
            if lo <= at <= len(left):
                w = left[len(left) - at :] + right[: LENGTH - at]
                seen.setdefault(w, []).append(es[0])
        for es in seen.values():
            if len(es) > 1:
                out += [(e[4], e[5] - at, e[5] - at + LENGTH) for e in es if not e[3]]
    return out


def repeated_spans(docs: DataFrame, hot: int = HOT, run_bytes: int = RUN_BYTES, block_records: int = BLOCK_RECORDS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """oid, tkey, start, end: bytes that repeated windows cover, for docs (oid, tkey, text). Spans can overlap.

    run_bytes: of a sorted run in a task; block_records: of a block; range_bytes: of the runs that are merged in one range.
    """
    spark = docs.sparkSession

    def prints(batches):
        for b in batches:
            found, counts = [], []
            for text in b.column(2).to_pylist():
                f = references(text.encode())[3] if text else np.zeros(0, np.uint64)
                f, n = np.unique(f, return_counts=True)
                found.append((f, np.minimum(n, 2)))
                counts.append(len(f))
            at = pa.array(np.repeat(np.arange(len(counts)), counts))
            flat = np.concatenate([f for f, _ in found]) if found else np.zeros(0, np.uint64)
            many = np.concatenate([n for _, n in found]) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(flat.view(np.int64)), pa.array(many.astype(np.int32))], ["oid", "tkey", "print", "times"])

    stems = materialize(docs.mapInArrow(prints, "oid long, tkey long, print long, times int"), "stems")
    known = materialize(stems.groupBy("print").agg(F.sum("times").alias("times")).where(F.col("times") > 1).select("print", (F.col("times") > hot).alias("hot")), "repeated-stems")
    wanted = stems.join(known, "print").groupBy("oid", "tkey").agg(F.collect_set(F.when(~F.col("hot"), F.col("print"))).alias("prints"), F.collect_set(F.when(F.col("hot"), F.col("print"))).alias("hot_prints"))
    wanted = materialize(wanted, "wanted")
    discard(stems)
    texts = docs.join(wanted, ["oid", "tkey"]).select("oid", "tkey", "text", "prints", "hot_prints")

    def build(batches):
        part = TaskContext.get().partitionId()
        state = {"runs": 0, "size": 0, "held": ([], [])}

        def flush():
            spans = []
            for kind in (0, 1):
                entries, block, seq, end = state["held"][kind], [], 0, b""
                entries.sort()
                run = (part << 24) + 2 * state["runs"] + kind
                i = 0
                while i < len(entries):
                    right, left, lo, owner, place = entries[i]
                    j = i + 1
                    while j < len(entries) and entries[j][0] == right and entries[j][1] == left and entries[j][2] == lo:
                        j += 1
                    if j > i + 1:
                        spans += [(e[3], e[4] - len(left), e[4] - lo + LENGTH) for e in entries[i:j]]
                    block.append((right, left, lo, int(j > i + 1), owner, place))
                    i = j
                    if len(block) == block_records or i == len(entries):
                        yield batch(kind, run, seq, block, common_prefix(end, block[0][0]))
                        block, seq, end = [], seq + 1, block[-1][0]
                state["held"][kind].clear()
            state["runs"] += 1
            state["size"] = 0
            if spans:
                yield span_row(spans)

        def batch(kind, run, seq, block, prefix):
            return pa.RecordBatch.from_pylist([{"kind": kind, "run": run, "seq": seq, "first": block[0][0], "last": block[-1][0], "data": encode_block(block, prefix)}], schema)

        def span_row(spans):
            flat = np.array([(*o, a, e) for o, a, e in spans], "<i8").tobytes()
            return pa.RecordBatch.from_pylist([{"kind": 2, "run": 0, "seq": 0, "first": b"", "last": b"", "data": zstandard.ZstdCompressor(level=1).compress(flat)}], schema)

        schema = pa.schema([("kind", pa.int32()), ("run", pa.int64()), ("seq", pa.int32()), ("first", pa.binary()), ("last", pa.binary()), ("data", pa.binary())])
        for b in batches:
            for oid, tkey, text, prints_, hot_ in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                data, owner = text.encode(), (oid, tkey)
                q, lo, hi, f = references(data)
                f = f.view(np.int64)
                cold, warm = state["held"]
                for at in np.flatnonzero(np.isin(f, np.array(prints_, np.int64))).tolist() if prints_ else ():
                    p, h = int(q[at]), int(hi[at])
                    cold.append((data[p : p + LENGTH - int(lo[at])], data[p - h : p], int(lo[at]), owner, p))
                    state["size"] += 400 + h
                    if state["size"] > run_bytes:
                        yield from flush()
                for at in np.flatnonzero(np.isin(f, np.array(hot_, np.int64))).tolist() if hot_ else ():
                    for s in range(int(q[at] - hi[at]), int(q[at] - lo[at]) + 1):
                        warm.append((data[s : s + LENGTH], b"", 0, owner, s))
                        state["size"] += 400
                        if state["size"] > run_bytes:
                            yield from flush()
                if state["size"] > run_bytes:
                    yield from flush()
        yield from flush()

    with batches_of(spark, 500):
        runs = materialize(texts.mapInArrow(build, RUNS), "suffix-runs", "uncompressed")

    # ranges: splitters from a bounded sample of block keys
    size = runs.where(F.col("kind") < 2).groupBy("kind").agg(F.sum(F.length("data")).alias("n"), F.count("*").alias("blocks")).collect()
    splitters = {}
    for r in size:
        n = -(-r["n"] // range_bytes)
        n = min(MOST_RANGES, max(n, min(spark.sparkContext.defaultParallelism, -(-r["n"] // min(range_bytes, 1 << 20)))))
        stem = STEM if r["kind"] == 0 else LENGTH
        keys = sampled_keys(runs.where(F.col("kind") == r["kind"]), r["blocks"], n, stem)
        splitters[r["kind"]] = sorted({keys[len(keys) * k // n] for k in range(1, n)} if keys else set())
    shared = spark.sparkContext.broadcast(splitters)

    def deal(batches):
        names = ["kind", "range", "run", "seq", "data"]
        for b in batches:
            for kind, run, seq, first, last, data in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                cuts, stem = shared.value[kind], STEM if kind == 0 else LENGTH
                lo, hi = bisect.bisect_right(cuts, first[:stem]), bisect.bisect_right(cuts, last[:stem])
                rows = [(lo, data)]
                if lo != hi:
                    parts: dict = {}
                    for e in decode_block(data):
                        parts.setdefault(bisect.bisect_right(cuts, e[1][:stem]), []).append(e)
                    rows = [(k, encode_block([e[1:] for e in es], es[0][0])) for k, es in parts.items()]
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.int32()), pa.array([k for k, _ in rows], pa.int32()), pa.array([run] * len(rows), pa.int64()), pa.array([seq] * len(rows), pa.int32()), pa.array([d for _, d in rows], pa.binary())], names)

    def combine(table):
        stem = STEM if table["kind"][0].as_py() == 0 else LENGTH
        by_run: dict = {}
        for run, seq, data in zip(table["run"].to_pylist(), table["seq"].to_pylist(), table["data"].to_pylist(), strict=True):
            by_run.setdefault(run, []).append((seq, data))
        group, out, before = [], [], None
        for e in merge([stream(sorted(blocks)) for blocks in by_run.values()]):
            if e[0] < stem and group:
                if len(group) > 1:
                    out += shared_windows(group)
                group = []
            group.append(e[1:])
        if len(group) > 1:
            out += shared_windows(group)
        rows = np.array([(*o, a, z) for o, a, z in out], np.int64).reshape(-1, 4)
        return pa.Table.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(4)], ["oid", "tkey", "start", "end"])

    def stream(blocks):
        """The entries of a run's blocks in a range. The first one follows none, and so shares nothing."""
        for i, (_, data) in enumerate(blocks):
            for j, e in enumerate(decode_block(data)):
                yield e if i or j else (0, *e[1:])

    def unpack(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                rows = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i8").reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(4)], ["oid", "tkey", "start", "end"])

    spans_schema = "oid long, tkey long, start long, end long"
    with batches_of(spark, 64):
        dealt = runs.where(F.col("kind") < 2).mapInArrow(deal, "kind int, range int, run long, seq int, data binary")
        merged = dealt.groupBy("kind", "range").applyInArrow(combine, spans_schema)
        local = runs.where(F.col("kind") == 2).select("data").mapInArrow(unpack, spans_schema)
        spans = materialize(merged.unionByName(local), "repeated-spans")
    discard(runs, wanted)
    return spans


def sampled_keys(runs: DataFrame, blocks: int, n: int, stem: int) -> list[bytes]:
    """Sorted first keys of about 16 n of the blocks (SAMPLE at least), chosen by a hash; beyond SAMPLE they are sorted by Spark, and the driver gets every 16th."""
    wanted = max(SAMPLE, 16 * n)
    some = runs
    if wanted < blocks:
        some = runs.where(F.xxhash64("first", "run", "seq") < F.lit(int((2 * wanted / blocks - 1) * (1 << 63))))
    some = some.select(F.substring("first", 1, stem).alias("first"))
    if wanted <= SAMPLE:
        return sorted(bytes(k[0]) for k in some.collect())

    def every(batches):
        k = 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.flatnonzero((np.arange(b.num_rows) + k) % 16 == 8)))], ["first"])
            k += b.num_rows

    ordered = some.repartitionByRange(-(-wanted // SAMPLE), "first").sortWithinPartitions("first")
    return sorted(bytes(k[0]) for k in ordered.mapInArrow(every, "first binary").collect())


def dedup_suffixes(docs: DataFrame, hot: int = HOT, **sizes: int) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), spans (arrays of start and end)."""
    oid = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), oid.alias("oid"), F.xxhash64("text").alias("tkey"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spans = repeated_spans(plain.select("oid", "tkey", "text"), hot, **sizes)
    per = materialize(spans.distinct().groupBy("oid", "tkey").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans-by-text")
    discard(spans)

    def cut(batches):
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"]
        pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            out = []
            for doc, text, found in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                data, whole = text.encode(), []
                for s in sorted((x["start"], x["end"]) for x in found or ()):
                    if whole and s[0] <= whole[-1][1]:
                        whole[-1][1] = max(whole[-1][1], s[1])
                    else:
                        whole.append(list(s))
                at, kept = 0, []
                for a, z in whole:
                    kept.append(data[at:a])
                    at = z
                kept.append(data[at:])
                kept = b"".join(kept)
                out.append((doc, len(data), len(data) - len(kept), len(whole), kept, [{"start": a, "end": z} for a, z in whole]))
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.binary(), pairs], strict=True)], names)

    joined = plain.join(per, ["oid", "tkey"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start: long, end: long>>")


def digests(docs: DataFrame) -> DataFrame:
    """dedup_suffixes() with the SHA-256 of the remaining bytes in place of them."""
    return dedup_suffixes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
