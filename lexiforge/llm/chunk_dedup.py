"""Substring dedup with content-defined chunks.

A gear rolling hash over the last 16 bytes sets cuts: a place is a cut if the hash of the bytes before it is low, and no place just before it is one. So cuts
depend on 20 bytes of content and on nothing else, and an insertion moves only those around it. A chunk begins at every cut (and at the text's
start) and ends SPAN cuts later (or at the text's end). Chunks overlap: of a repeated passage only the stretches before its first cut and after its last
one are in no chunk of its own, while every chunk is long enough that a common phrase does not make one. Chunks are counted by digest
(partial sums before the shuffle); the first occurrence, by doc_id, stays, and all others are marked by a join of two stored tables, which
the adaptive skew join splits at chunks of very common passages. In each document overlapping and adjacent marked chunks
form runs. A run asks each first occurrence for a digest (128 bits of BLAKE2) of the bytes that it shares with it, and stretches whose digests differ are no
marks: nothing goes because short digests or row keys happen to agree. What repeats ends before the next cut, so a run also asks for the bytes up to there and grows by those that are equal.
Runs of at least min_run bytes are removed, from word to word. A shorter run (a common line) is left alone.

Edge cases: null or empty texts have no chunks and stay as they are; texts shorter than min_run never lose anything;
a stretch without cuts (one repeated character, say) is part of a longer chunk and repeats with it only;
rows that agree in doc_id and text count as one document and get the same result (rows of one doc_id are told apart by a hash of the text, of 64 bits where doc_id is null;
if it agrees for different texts, a copy between them may stay, and no text is lost); a null doc_id comes first; extra columns of any name stay as they are; an empty table gives none; very long texts are chunked whole, in slices.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, quoted, tidy
from .shingles import mix, powers
from .vectors import batches_of

#: The share of places that are low, the bytes before a cut without a low place, cuts in a chunk, and the least bytes of a run.
LOW, APART, SPAN, MIN_RUN = 1 / 18, 4, 2, 150
#: Bytes before a cut that decide on it: within as many bytes of its start, a passage's cuts are those of its surroundings.
LOOK = 16 + APART
_SPACE = re.compile(rb"\s")
GEAR = np.random.default_rng(20240607).integers(0, 1 << 16, 256).astype(np.uint16)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_SLICE = 1 << 20


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i-k]] << k for k < 16, in 16 bits: the rolling hash at every byte."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        more = h.copy()
        more[step:] += h[:-step] << np.uint16(step)
        h = more
    return h


def cuts(data: np.ndarray) -> np.ndarray:
    """Places between bytes, 0 and the end included, where chunks begin and end."""
    found = []
    for lo in range(0, len(data), _SLICE):
        begin = max(0, lo - 32)  # what the hash and APART look back on
        low = np.flatnonzero(gear(data[begin : lo + _SLICE]) < LOW * 65536) + 1
        low = low[low >= 16] if begin else low[low > 15]
        apart = low[np.diff(low, prepend=-APART) > APART]
        found.append(apart[apart + begin > lo] + begin)
    inner = np.concatenate(found) if found else np.zeros(0, np.int64)
    return np.concatenate([[0], inner[inner < len(data)], [len(data)]]).astype(np.int64)


def chunks_of(data: bytes) -> tuple[np.ndarray, ...]:
    """(starts, ends, digests, bytes from the cut before, bytes to the cut after) of the chunks of data."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return (np.zeros(0, np.int64),) * 5
    at = cuts(b)
    # hashes of the pieces between cuts, then of SPAN pieces: sums of bytes times powers of a base
    pieces = np.zeros(len(at) - 1, np.uint64)
    for lo in range(0, len(pieces), 1 << 15):
        a = at[lo : lo + (1 << 15) + 1]
        part = (b[a[0] : a[-1]].astype(np.uint64) + np.uint64(1)) * powers(_BASE, int(a[-1] - a[0]))
        pieces[lo : lo + len(a) - 1] = np.add.reduceat(part, a[:-1] - a[0]) * powers(_INVERSE, int(a[-1] - a[0]) + 1)[a[:-1] - a[0]]
    n = np.diff(at)
    pieces = mix(pieces ^ (n.astype(np.uint64) * np.uint64(_BASE)))
    k = min(SPAN, len(pieces))
    digest = np.zeros(len(pieces) - k + 1, np.uint64)
    for j in range(k):
        digest = mix(digest * np.uint64(_BASE) + pieces[j : len(pieces) - k + 1 + j])
    n = np.concatenate([[0], n, [0]])
    return at[: len(digest)], at[k:], digest.view(np.int64), n[: len(digest)], n[k + 1 :]


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, tkey, start, size, digest, before, after (see chunks_of()) for every chunk of docs (doc_id, tkey, text)."""
    names, limit = ["doc_id", "tkey", "start", "size", "digest", "before", "after"], 200_000

    def run(batches):
        for b in batches:
            held, rows, first = [], 0, 0
            for k, text in enumerate(b.column(2).to_pylist()):
                found = chunks_of(text.encode() if text else b"")
                held.append(found)
                rows += len(found[0])
                if rows > limit or k == b.num_rows - 1:
                    at = pa.array(np.repeat(np.arange(first, k + 1), [len(f[0]) for f in held]))
                    start, end, digest, before, after = (np.concatenate([f[j] for f in held]) for j in range(5))
                    ints = [pa.array(x.astype(np.int32)) for x in (start, end - start, before, after)]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *ints[:2], pa.array(digest), *ints[2:]], names)
                    held, rows, first = [], 0, k + 1

    return docs.select("doc_id", "tkey", "text").mapInArrow(tidy(run), "doc_id long, tkey long, start int, size int, digest long, before int, after int")


#: What an ask wants: the bytes before or after a place, or the digest of those that start there.
BEFORE, CHECK, AFTER = -1, 0, 1
_ASK = "at: int, kind: tinyint, n: int, s_id: bigint, s_key: bigint, s_at: int"


def first_of(*keys: np.ndarray) -> np.ndarray:
    """Where one of the keys differs from the row before."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


def stretches(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Where a stretch of overlapping or adjacent places begins, of places sorted by (group, start); groups are numbers that grow."""
    far = group.astype(np.int64) << 40
    reach = np.maximum.accumulate(end + far)
    new = np.ones(len(start), bool)
    new[1:] = (start + far)[1:] > reach[:-1]
    return new


def asks_of(doc: np.ndarray, m: dict[str, np.ndarray], min_run: int) -> dict[str, np.ndarray]:
    """The asks of the marked chunks m (arrays start, size, s_none, s_id, s_key, s_at, before, after) of the documents doc (numbers), sorted by doc.

    Overlapping and adjacent chunks of a document are a run. A run that can reach min_run asks every first occurrence that its chunks have (a document and a distance)
    for the digests of the stretches that these cover, and for the bytes beyond its ends.
    """
    order = np.lexsort((m["size"], m["start"], doc))
    doc, m = doc[order], {k: v[order].astype(np.int64) if k != "s_none" else v[order] for k, v in m.items()}
    start, end = m["start"], m["start"] + m["size"]
    new = stretches(doc, start, end)
    run, at = np.cumsum(new) - 1, np.flatnonzero(new)
    a, e = start[at], np.maximum.reduceat(end, at)
    last = np.flatnonzero(end == e[run])
    last = last[first_of(run[last])]
    back, after = np.minimum(a, m["before"][at] + LOOK), m["after"][last]
    some = (e - a + back + after >= min_run)[run]
    run, doc, start, end, m = run[some], doc[some], start[some], end[some], {k: v[some] for k, v in m.items()}
    shift = m["s_at"] - start
    order = np.lexsort((end, start, shift, m["s_key"], m["s_id"], m["s_none"], run))
    run, doc, start, end, shift, m = run[order], doc[order], start[order], end[order], shift[order], {k: v[order] for k, v in m.items()}
    begin = first_of(run, m["s_none"], m["s_id"], m["s_key"], shift) if len(run) else np.zeros(0, bool)
    one = np.flatnonzero(begin)  # a row of each first occurrence of a run
    lo = np.flatnonzero(stretches(np.cumsum(begin), start, end)) if len(run) else one
    hi = np.maximum.reduceat(end, lo) if len(lo) else end
    left, right = one[(back[run[one]] > 0) & (a[run[one]] + shift[one] > 0)], one[after[run[one]] > 0]
    rows = np.concatenate([lo, left, right])
    place = np.concatenate([start[lo], a[run[left]], e[run[right]]])
    kind = np.repeat([CHECK, BEFORE, AFTER], [len(lo), len(left), len(right)])
    out = {"doc": doc[rows], "at": place, "kind": kind, "n": np.concatenate([hi - start[lo], back[run[left]], after[run[right]]]), "s_none": m["s_none"][rows], "s_id": m["s_id"][rows], "s_key": m["s_key"][rows], "s_at": place + shift[rows]}
    by = np.argsort(out["doc"], kind="stable")
    return {k: v[by] for k, v in out.items()}


def asks(per_doc: DataFrame, min_run: int) -> DataFrame:
    """m_id, m_key, asks (at, kind, n, s_id, s_key, s_at) of per_doc (m_id, m_key, found): see asks_of()."""
    fields = {"at": pa.int32(), "kind": pa.int8(), "n": pa.int32(), "s_id": pa.int64(), "s_key": pa.int64(), "s_at": pa.int32()}

    def run(batches):
        for b in batches:
            lists = b.column(2)
            sizes, chunk = np.diff(lists.offsets.to_numpy()), lists.flatten()
            if not len(chunk):
                continue
            m = {k: chunk.field(k).fill_null(0).to_numpy(zero_copy_only=False) for k in ("start", "size", "s_id", "s_key", "s_at", "before", "after")}
            m["s_none"] = chunk.field("s_id").is_null().to_numpy(zero_copy_only=False)
            found = asks_of(np.repeat(np.arange(b.num_rows), sizes), m, min_run)
            kept, counts = np.unique(found["doc"], return_counts=True)
            items = pa.StructArray.from_arrays([pa.array(found[k], t, mask=found["s_none"]) if k == "s_id" else pa.array(found[k].astype(t.to_pandas_dtype()), t) for k, t in fields.items()], list(fields))
            at = pa.array(kept)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), items)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), lists], ["m_id", "m_key", "asks"])

    return per_doc.select("m_id", "m_key", "found").mapInArrow(tidy(run), f"m_id long, m_key long, asks array<struct<{_ASK}>>")


def digest_of(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def answers(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """s_id, s_key, s_at, kind, checked, answer: for each distinct place of wanted the bytes of the text (docs: doc_id, tkey, text) before or after it, as many as the longest ask, or the digest of the next `checked` bytes."""
    names = ["s_id", "s_key", "s_at", "kind", "checked", "answer"]
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int8(), pa.int32(), pa.binary())

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for doc, key, text, places in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                data = text.encode()
                for p in places:
                    s, n, kind = p["s_at"], p["n"], p["kind"]
                    found = data[max(0, s - n) : s] if kind == BEFORE else data[s : s + n]
                    out.append((doc, key, s, kind, p["checked"], digest_of(found) if kind == CHECK else found))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)

    # a passage of very many texts asks for one place: the asks are summed up before they meet
    places = wanted.groupBy("s_id", "s_key", "s_at", "kind", checked()).agg(F.max("n").alias("n"))
    by_doc = places.groupBy("s_id", "s_key").agg(F.collect_list(F.struct("s_at", "kind", "checked", "n")).alias("places"))
    joined = docs.join(by_doc, F.col("tkey").eqNullSafe(F.col("s_key")) & F.col("doc_id").eqNullSafe(F.col("s_id"))).select("doc_id", "tkey", "text", "places")
    # rows that agree in doc_id and text give their answers twice
    return joined.mapInArrow(tidy(run), "s_id long, s_key long, s_at int, kind tinyint, checked int, answer binary").dropDuplicates(names[:-1])


def checked():
    """The length that belongs to an ask's place: that of a stretch, 0 for ends."""
    return F.when(F.col("kind") == CHECK, F.col("n")).otherwise(0).alias("checked")


def equal_bytes(a: bytes, b: bytes, back: bool) -> int:
    """Length of the common prefix of a and b, or of their common suffix."""
    n = min(len(a), len(b))
    if not n:
        return 0
    x, y = (np.frombuffer(t[len(t) - n :][::-1] if back else t[:n], np.uint8) for t in (a, b))
    other = np.flatnonzero(x != y)
    return int(other[0]) if len(other) else n


def confirmed(data: bytes, answered: list[dict]) -> list[tuple[int, int]]:
    """(start, size) of what repeats in data: stretches with the digest of their first occurrence, and the equal bytes beyond their ends. answered: at, kind, n, answer."""
    out = [(x["at"], x["n"]) for x in answered if x["kind"] == CHECK and digest_of(data[x["at"] : x["at"] + x["n"]]) == x["answer"]]
    ends = {at for at, _ in out} | {at + n for at, n in out}
    for x in answered:
        at, n = x["at"], x["n"]
        if x["kind"] != CHECK and at in ends:
            back = x["kind"] == BEFORE
            k = equal_bytes(data[max(0, at - n) : at] if back else data[at : at + n], x["answer"][-n:] if back else x["answer"][:n], back)
            out.append((at - k if back else at, k))
    return [x for x in out if x[1]]


def remove(data: bytes, marked: list[tuple[int, int]], min_run: int) -> tuple[bytes, list[tuple[int, int]]]:
    """data without its runs of adjacent or overlapping marked places of at least min_run bytes, cut back to whole words and characters; and the spans removed."""
    runs: list[list[int]] = []
    for a, n in sorted(set(marked)):
        if runs and runs[-1][1] >= a:
            runs[-1][1] = max(runs[-1][1], a + n)
        else:
            runs.append([a, a + n])
    kept, spans, at = [], [], 0
    for a, b in runs:
        if b - a >= min_run:
            # the words beside a passage stay whole, with a space between them; a text without spaces is cut anywhere
            if a and not data[a - 1 : a].isspace() and (space := _SPACE.search(data, a, min(b, a + 64))):
                a = space.end()
            if b < len(data) and not data[b : b + 1].isspace() and (spaces := list(_SPACE.finditer(data, max(a, b - 64), b))):
                b = spaces[-1].start()
            while a < b and data[a] & 0xC0 == 0x80:
                a += 1
            while b < len(data) and b > a and data[b] & 0xC0 == 0x80:
                b -= 1
            kept.append(data[at:a])
            spans.append((a, b))
            at = b
    kept.append(data[at:])
    return b"".join(kept), spans


def row_key():
    """Tells rows of one doc_id apart, those without one above all, of which there may be very many."""
    return F.when(F.col("lexi_id").isNull(), F.xxhash64("lexi_text")).otherwise(F.hash("lexi_text").cast("long"))


def dedup_chunks(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """All columns of docs (doc_id, text, ...) with text deduplicated, and lexi_bytes (before), lexi_spans (array of start and end, in bytes)."""
    columns = docs.columns
    keyed = docs.withColumn("lexi_id", F.col("doc_id").cast("long")).withColumn("lexi_text", F.col("text").cast("string")).withColumn("lexi_key", row_key())
    plain = keyed.select(F.col("lexi_id").alias("doc_id"), F.col("lexi_key").alias("tkey"), F.col("lexi_text").alias("text"))
    spark = docs.sparkSession
    with batches_of(spark, 1000):
        found = materialize(chunks(plain), "chunks", "zstd")
    place = F.struct("doc_id", "tkey", "start")
    twice = found.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    twice = materialize(twice.where("n > 1").select("digest", "first"), "repeated-chunks")
    # rows with equal doc_id and text are one document: their chunks are the same places
    marked = found.join(twice, "digest").where(~place.eqNullSafe(F.col("first")))
    mark = F.struct("start", "size", F.col("first.doc_id").alias("s_id"), F.col("first.tkey").alias("s_key"), F.col("first.start").alias("s_at"), "before", "after")
    per_doc = marked.groupBy(F.col("doc_id").alias("m_id"), F.col("tkey").alias("m_key")).agg(F.collect_set(mark).alias("found"))
    per_doc = materialize(per_doc, "marked-chunks")
    discard(found, twice)
    with batches_of(spark, 500):
        asked = materialize(asks(per_doc, min_run), "asks")
    discard(per_doc)
    wanted = asked.select("m_id", "m_key", F.explode("asks").alias("a")).select("m_id", "m_key", "a.*")
    with batches_of(spark, 500):
        found = materialize(answers(plain.where(F.col("text").isNotNull()), wanted), "answers")
    named = found.select(*(F.col(c).alias(f"w_{c}") for c in ("s_id", "s_key", "s_at", "kind", "checked")), "answer")
    same = [F.col(c) == F.col(f"w_{c}") for c in ("s_key", "s_at", "kind", "checked")] + [F.col("s_id").eqNullSafe(F.col("w_s_id"))]
    marks = wanted.withColumn("checked", checked()).join(named, same).groupBy("m_id", "m_key").agg(F.collect_set(F.struct("at", "kind", "n", "answer")).alias("lexi_marks"))
    marks = materialize(marks, "marks")
    discard(asked, found)
    joined = keyed.join(marks, F.col("lexi_key").eqNullSafe(F.col("m_key")) & F.col("lexi_id").eqNullSafe(F.col("m_id")), "left")
    joined = joined.select(*(F.col("lexi_text") if c == "text" else quoted(c) for c in columns), "lexi_marks")
    at = columns.index("text")

    def run(batches):
        for b in batches:
            new, sizes, spans = [], [], []
            for text, marks_ in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                data = text.encode() if text else b""
                cut: list = []
                if marks_:
                    kept, cut = remove(data, confirmed(data, marks_), min_run)
                    text = kept.decode()
                new.append(text)
                sizes.append(len(data))
                spans.append([{"start": a, "end": e} for a, e in cut])
            out = [pa.array(new, pa.string()) if c == "text" else b.column(k) for k, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([*out, pa.array(sizes, pa.int64()), pa.array(spans, span_type)], numbers)

    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    fields = [T.StructField("text", T.StringType()) if f.name == "text" else f for f in docs.schema.fields]
    types = [*(f.dataType for f in fields), T.LongType(), T.ArrayType(span)]
    # by number in the table: mapInArrow reads names as paths, and files may not take each of them
    numbers = [f"c{k}" for k in range(len(types))]
    schema = T.StructType([T.StructField(c, t) for c, t in zip(numbers, types, strict=True)])
    done = joined.toDF(*numbers[:-1]).mapInArrow(tidy(run), schema)
    # written here, where batches are small: whoever gets the rows would take texts and marks in batches of any size
    with batches_of(spark, 500):
        out = materialize(done, "deduplicated")
    discard(marks)
    return out.toDF(*columns, "lexi_bytes", "lexi_spans")
