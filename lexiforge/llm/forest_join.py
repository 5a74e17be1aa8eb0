"""Similarity join of documents with a MinHash LSH forest.

1. Each whole text becomes a set of word shingles. Documents with equal sets form a class; from here on a class is one node with a weight.
2. A class has TREES strings of DEPTH MinHash values. Each tree's strings are sorted; a class whose neighbours in no tree share the shortest prefix
   that is ever asked for has no candidate and is done. The others are the tries: a trie node is a stretch of the sorted strings with a common prefix.
3. Matching starts with whole strings and shortens the prefix level by level. On each level the trie nodes that are new (two branches meet in them)
   are verified: the classes of a node meet in one task, those of a large node in blocks, each one row, pairs of which are dealt out. A pair is compared once, in the node of the
   longest prefix that it shares, of equal ones in the least tree. Nodes of several trees with the same classes are one unit of work. First only the strings
   of the classes meet, which tell the pairs to compare; shingles are sent for classes of such pairs alone. The Jaccard similarity is exact, from
   products of incidence matrices. Tasks return link counts and a spanning forest of the links, never the pairs.
4. A class stops asking as soon as the estimated recall of its partners reaches the target. A pair of similarity s meets at depth d with probability
   p = 1 - (1 - s^d)^TREES; the class's found partners stand for the sum of their 1 / p, and one more partner at the threshold is supposed to exist, so that a class
   with few partners goes on to the depth where pairs at the threshold itself are met with the target recall. There all stop.
5. Components of the verified links are the groups of near-duplicates.

Edge cases: texts that are null, empty or hold no word link with nothing; shorter texts than five words compare as one shingle; a null doc_id
counts as the largest; rows that agree in doc_id and text are copies of each other; an empty table gives none;
texts of any length are read whole. Shingles and texts of equal ids are told apart by 64-bit hashes, sets by 128 bits, classes by numbers.
"""

from __future__ import annotations

from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, quoted, tidy
from .epsilon_join import Union
from .graph import components
from .shingles import WORDS, shingle_set
from .vectors import batches_of

TREES, DEPTH, TARGET_RECALL, BLOCK = 24, 8, 0.9995, 512
_RNG = np.random.default_rng(77)
_A = _RNG.integers(1, 1 << 63, TREES * DEPTH, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, TREES * DEPTH, np.uint64)
NO_ID = (1 << 63) - 1
LABEL = np.dtype([("there", "u1"), ("hi", "<i8"), ("lo", "<i8")])
LINKS = "a long, b long, links long, found long, stand_for double"


def labels(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The DEPTH MinHash values of each tree, 16 bits each, as two numbers: the first four and the last four."""
    least = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(s), 4096):
        part = s[lo : lo + 4096, None] * _A + _B
        least = np.minimum(least, (part >> np.uint64(32)).astype(np.uint32).min(axis=0))
    pairs = np.ascontiguousarray((least & 0xFFFF).astype(">u2")).view(">i8").reshape(TREES, 2)
    return pairs[:, 0].astype(np.int64), pairs[:, 1].astype(np.int64)


def masks(depth: int) -> tuple[int, int]:
    """What to keep of a string's two numbers for its prefix of depth values."""
    bits = lambda k: -1 << 16 * (4 - k) if k else 0
    return bits(min(depth, 4)), bits(max(depth - 4, 0))


def met(similarity, depth: int):
    """The probability that sets of this similarity share a prefix of depth values in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def prefix_depth(threshold: float, target: float = TARGET_RECALL) -> int:
    """The longest prefix at which sets at the threshold share a trie node with the target recall."""
    depth = DEPTH
    while depth > 1 and met(threshold, depth) < target:
        depth -= 1
    return depth


def profiles(docs: DataFrame, words: int) -> DataFrame:
    """oid, tkey, digest, n (shingles), hi, lo (see labels()) for docs (oid, tkey, text)."""

    def run(batches):
        longs = pa.list_(pa.int64())
        for b in batches:
            digests, sizes, his, los = [], [], [], []
            for text in b.column(2).to_pylist():
                s = shingle_set(text, words)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                hi, lo = labels(s) if len(s) else (None, None)
                his.append(hi)
                los.append(lo)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(his, longs), pa.array(los, longs)], ["oid", "tkey", "digest", "n", "hi", "lo"])

    return docs.mapInArrow(tidy(run), "oid long, tkey long, digest binary, n long, hi array<long>, lo array<long>")


def tries(classes: DataFrame, depth: int) -> DataFrame:
    """tree, hi, lo, node: the sorted strings of every tree that share a prefix of depth values with a neighbour, and the first and last one of each partition."""
    mask = [np.int64(m) for m in masks(depth)]

    def run(batches):
        held, near = None, True  # the last string seen, and whether it is to be kept; a partition's first and last ones are
        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            tree, hi, lo = (b.column(k).to_numpy() for k in range(3))
            same = (tree[1:] == tree[:-1]) & (hi[1:] & mask[0] == hi[:-1] & mask[0]) & (lo[1:] & mask[1] == lo[:-1] & mask[1])
            keep = np.concatenate([[near], same]) | np.concatenate([same, [False]])
            held, near = b.slice(b.num_rows - 1), bool(keep[-1])
            yield b.slice(0, b.num_rows - 1).filter(pa.array(keep[:-1]))
        if held is not None:
            yield held

    rows = classes.select("node", F.posexplode(F.arrays_zip("hi", "lo")).alias("tree", "s")).select("tree", "s.hi", "s.lo", "node")
    order = ["tree", "hi", "lo", "node"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "tree int, hi long, lo long, node long")


def similar(sets: list[np.ndarray], left: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) of sets with a Jaccard similarity of at least threshold, and it: i < left <= j; or i < j if left is 0."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    rows = np.repeat(np.arange(n), sizes)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, rows = flat[order], rows[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1  # a shingle of one set alone is in no intersection
    number = np.cumsum(shared) - 1
    keep = shared[column]
    rows, column = rows[keep], number[column[keep]]
    common = np.zeros((left or n, n - left), np.float32)
    at = 0
    while at < len(rows):  # by slices of columns; counts stay exact in single precision
        first = column[at]
        end = int(np.searchsorted(column, first + 4096))
        part = np.zeros((n, int(column[end - 1] - first) + 1), np.float32)
        part[rows[at:end], column[at:end] - first] = 1
        common += (part[:left] @ part[left:].T) if left else part @ part.T
        at = end
    union = (sizes[:left, None] + sizes[None, left:] if left else sizes[:, None] + sizes[None, :]) - common.astype(np.float64)
    share = common / union
    i, j = np.nonzero(share >= threshold)
    if not left:
        i, j = i[i < j], j[i < j]
    return i, j + left, share[i, j]


def own_pairs(label: np.ndarray, asking: np.ndarray, left: int, tree: int, depth: int) -> np.ndarray:
    """Which pairs (of the first `left` with the others, or of all) a trie node of this tree and depth is the first one to hold, of those that one of both asks for."""
    rows, cols = (slice(0, left), slice(left, None)) if left else (slice(None), slice(None))
    out = asking[rows, None] | asking[None, cols]
    for k in range(TREES):
        d = depth if k < tree else depth + 1
        there = label["there"][:, k] > 0
        if d > DEPTH or not (there[rows].any() and there[cols].any()):
            continue
        hi, lo = (label[c][:, k] & np.int64(m) for c, m in zip(("hi", "lo"), masks(d), strict=True))
        out &= ~((hi[rows, None] == hi[None, cols]) & (lo[rows, None] == lo[None, cols]) & there[rows, None] & there[None, cols])
    return out if left else np.triu(out, 1)


def with_pairs(asking: np.ndarray, label: np.ndarray, left: int, tree: int, depth: int) -> np.ndarray:
    """Which classes of a trie node have a pair to compare in it; see own_pairs()."""
    mine = own_pairs(label, asking, left, tree, depth)
    return np.flatnonzero(np.concatenate([mine.any(axis=1), mine.any(axis=0)]) if left else mine.any(axis=1) | mine.any(axis=0))


def verify(nodes: np.ndarray, weights: np.ndarray, asking: np.ndarray, label: np.ndarray, sets: list[np.ndarray], left: int, tree: int, depth: int, threshold: float) -> list[tuple]:
    """Rows of LINKS for one unit of work: (node, None, documents linked, classes linked, sum of 1 / p) and (node, node, 0, 0, 0) for a spanning forest of the links."""
    if len(sets) == 2:  # most units
        a, b = label
        both = (a["there"] > 0) & (b["there"] > 0)
        same = [both & (a["hi"] & np.int64(h) == b["hi"] & np.int64(h)) & (a["lo"] & np.int64(m) == b["lo"] & np.int64(m)) for h, m in (masks(depth), masks(min(depth + 1, DEPTH)))]
        if same[0][:tree].any() or depth < DEPTH and same[1].any() or not asking.any():
            return []
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        share = common / (len(sets[0]) + len(sets[1]) - common)
        i, j, shares = (np.array([x]) for x in (0, 1, share)) if share >= threshold else (np.array([], int),) * 3
    else:
        mine = own_pairs(label, asking, left, tree, depth)
        if not mine.any():
            return []
        # only classes that have a pair to compare here
        used = np.flatnonzero(np.concatenate([mine.any(axis=1), mine.any(axis=0)]) if left else mine.any(axis=1) | mine.any(axis=0))
        first = int((used < left).sum())
        i, j, shares = similar([sets[k] for k in used], first, threshold)
        i, j = used[i], used[j]
        fine = mine[i, j - left]
        i, j, shares = i[fine], j[fine], shares[fine]
    if not len(i):
        return []
    n, stand_for = len(nodes), 1 / met(shares, depth)
    count = (np.bincount(i, weights=weights[j], minlength=n) + np.bincount(j, weights=weights[i], minlength=n)).astype(np.int64)
    found = np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
    sums = np.bincount(i, weights=stand_for, minlength=n) + np.bincount(j, weights=stand_for, minlength=n)
    forest = Union(n)
    out = [(int(nodes[k]), None, int(count[k]), int(found[k]), float(sums[k])) for k in np.nonzero(count)[0]]
    return out + [(int(nodes[a]), int(nodes[b]), 0, 0, 0.0) for a, b in zip(i.tolist(), j.tolist(), strict=True) if forest.join(a, b)]


def units_of(trie: DataFrame, finished: DataFrame | None, depth: int) -> tuple[DataFrame, DataFrame]:
    """The trie nodes of one level to verify (tree, hi, lo, size), and its rows (tree, hi, lo, node, asking)."""
    rows = trie
    if finished is not None:
        rows = rows.join(finished.select("node", F.lit(True).alias("done")), "node", "left")
    asking = F.lit(True) if finished is None else F.col("done").isNull()
    cut = lambda d: [F.col(c).bitwiseAND(F.lit(m).cast("long")) for c, m in zip(("hi", "lo"), masks(d), strict=True)]
    hi, lo = cut(depth)
    rows = rows.select("tree", hi.alias("hi"), lo.alias("lo"), "node", asking.alias("asking"), F.xxhash64(*cut(min(depth + 1, DEPTH))).alias("branch"))
    found = rows.groupBy("tree", "hi", "lo").agg(
        F.count("*").alias("size"), F.max(F.col("asking").cast("int")).alias("asks"), F.min("branch").alias("one"), F.max("branch").alias("other"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")
    )
    found = found.where((F.col("size") > 1) & (F.col("asks") > 0) & (F.lit(depth == DEPTH) | (F.col("one") != F.col("other"))))
    # of nodes with the same classes the one of the least tree
    once = found.groupBy("size", "x", "y").agg(F.min(F.struct("tree", "hi", "lo")).alias("unit")).select("unit.*", "size")
    return once, rows.drop("branch")


def forest_links(classes: DataFrame, plain: DataFrame, threshold: float, words: int, target: float, block: int = BLOCK, levels: list | None = None) -> list[DataFrame]:
    """LINKS of classes (node, first, weight, hi, lo), a table or two for each level; plain (oid, tkey, text) holds their texts.

    levels: a list that gets (depth, units, classes finished after it) of each level.
    """
    least = prefix_depth(threshold, target)
    trie = materialize(tries(classes, least), "tries")
    own = trie.groupBy("node").agg(F.collect_list(F.struct("tree", "hi", "lo")).alias("strings"))
    # a class that is alone with its prefix in every tree has met no one: its rows are boundaries of partitions
    asked = own.join(classes.select("node", "weight", F.col("first.oid").alias("oid"), F.col("first.tkey").alias("tkey")), "node")
    asked = materialize(asked, "asked")
    # rows that agree in oid and tkey hold the same text: any of them serves. The candidates grow with the data, so they are not broadcast
    texts = asked.join(plain.hint("merge"), ["oid", "tkey"]).select("node", "weight", "strings", "text")

    def to_sets(batches):
        for b in batches:
            packed = []
            for strings in b.column(2).to_pylist():
                label = np.zeros(TREES, LABEL)
                for s in strings:
                    label[s["tree"]] = (1, s["hi"], s["lo"])
                packed.append(label.tobytes())
            sets = [shingle_set(t, words).tobytes() for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary()), pa.array(sets, pa.binary())], ["node", "weight", "label", "shingles"])

    with batches_of(classes.sparkSession, 1000):
        sets = materialize(texts.mapInArrow(tidy(to_sets), "node long, weight long, label binary, shingles binary"), "shingles")
    discard(asked)
    out: list[DataFrame] = []
    finished = None
    for depth in range(DEPTH, least - 1, -1):
        units, rows = units_of(trie, finished, depth)
        units = materialize(units, "trie-nodes")
        n, largest = units.agg(F.count("*"), F.max("size")).first()
        if n:
            out += level_links(units, rows, sets, depth, threshold, block, largest > block)
        discard(units)
        if depth > least:
            if n:
                found = out[0]
                for t in out[1:]:
                    found = found.unionByName(t)
                sums = found.where(F.col("b").isNull()).groupBy(F.col("a").alias("node")).agg(F.sum("found").alias("found"), F.sum("stand_for").alias("stand_for"))
                enough = (F.col("found") + met(threshold, depth)) / (F.col("stand_for") + 1) >= target
                if finished is not None:
                    discard(finished)
                finished = materialize(sums.where(enough).select("node"), "finished")
            if levels is not None:
                levels.append((depth, n, finished.count() if finished is not None else 0))
        elif levels is not None:
            levels.append((depth, n, classes.count()))
    discard(trie, sets)
    return out


#: What names a block of a trie node, and what a meeting of two of them.
KEY, MEETING = ["tree", "hi", "lo", "blocks", "block"], ["tree", "hi", "lo", "i", "j"]
NAMED = "tree int, hi long, lo long, blocks int, block int"
#: Classes of a block in one row, end to end. Rows hold about ROW bytes of shingles at most.
PACKED = f"{NAMED}, nodes binary, asking binary, labels binary, weights binary, sizes binary, shingles binary"
CHOSEN = f"{NAMED}, nodes binary, asking binary"
ROW = 1 << 23


class Classes(NamedTuple):
    """Classes of a trie node; without weights and sets where only strings meet."""

    nodes: np.ndarray
    asking: np.ndarray
    label: np.ndarray
    weights: np.ndarray
    sets: list[np.ndarray]


def rows_of(batches):
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def held_together(batches):
    """The key and Classes of each block of sorted rows (KEY, node, asking, label and possibly weight, shingles)."""
    for key, rows in groupby(rows_of(batches), itemgetter(slice(0, 5))):
        nodes, asking, label, *more = zip(*{r[5]: r[5:] for r in rows}.values(), strict=True)  # rows that repeat doc_id and text gave the same node more than once
        weights, sets = more or ((), ())
        yield key, Classes(np.array(nodes), np.array(asking), np.frombuffer(b"".join(label), LABEL).reshape(-1, TREES), np.array(weights, np.int64), [np.frombuffer(x, np.uint64) for x in sets])


def alone(batches):
    """(key, block of each class, left, Classes) for each trie node of one block, from rows as held_together() takes them."""
    for key, c in held_together(batches):
        if len(c.nodes) > 1:
            yield key, np.zeros(len(c.nodes), np.int32), 0, c


def pack(batches):
    """Rows of PACKED from rows as held_together() takes them."""
    for key, c in held_together(batches):
        sizes = np.array([len(x) for x in c.sets] or [0] * len(c.nodes), np.int64)
        for k in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(np.cumsum(sizes) * 8 // ROW)) + 1):
            data = [c.nodes[k], c.asking[k], c.label[k], c.weights[k] if c.sets else c.weights, sizes[k], np.concatenate([c.sets[x] for x in k]) if c.sets else sizes[:0]]
            yield batch_of([[x] for x in (*key, *(x.tobytes() for x in data))], PACKED)


def meeting(batches):
    """(key, block of each class, left, Classes) for each two blocks of a trie node, or one with itself, from sorted rows (MEETING, columns of PACKED): left classes are of block i if that is not j, else 0."""
    for (*_, i, j), rows in groupby(rows_of(batches), itemgetter(slice(0, 5))):
        key, parts = None, []
        for r in rows:
            key = r[5:10]
            nodes, asking, label, weights, sizes, flat = (np.frombuffer(x, t) for x, t in zip(r[10:], (np.int64, np.bool_, LABEL, np.int64, np.int64, np.uint64), strict=True))
            parts.append((np.full(len(nodes), key[4], np.int32), nodes, asking, label.reshape(-1, TREES), weights, np.split(flat, np.cumsum(sizes)[:-1])))
        block, nodes, asking, label, weights = (np.concatenate(x) for x in list(zip(*parts, strict=True))[:5])
        left = int((block == i).sum()) if i != j else 0
        if len(nodes) > 1 and (i == j or 0 < left < len(nodes)):
            yield key, block, left, Classes(nodes, asking, label, weights, [x for p in parts for x in p[5]])


def batch_of(columns: list, schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names)


def meet(rows: DataFrame, work, schema: str, label: str, batch: int, large: bool) -> list[DataFrame]:
    """Tables of what work makes of alone() and meeting(). Classes of large trie nodes become rows of whole blocks first, and those meet."""
    small = rows.where("blocks = 1").repartition(*KEY).sortWithinPartitions(*KEY, "node")
    with batches_of(rows.sparkSession, batch):
        out = [materialize(small.mapInArrow(tidy(lambda batches: work(alone(batches))), schema), label)]
    if large:
        packed = rows.where("blocks > 1").repartition(*KEY).sortWithinPartitions(*KEY, "node").mapInArrow(tidy(pack), PACKED)
        packed = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        both = packed.select("tree", "hi", "lo", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), *(F.col(x.split()[0]) for x in PACKED.split(", ")))
        # tree, hi and lo are there twice: once in the name of the meeting, once in the block's
        both = both.toDF(*MEETING, "t", "h", "l", *both.columns[8:]).repartition(*MEETING).sortWithinPartitions(*MEETING, "block")
        with batches_of(rows.sparkSession, 16):
            out.append(materialize(both.mapInArrow(tidy(lambda batches: work(meeting(batches))), schema), label))
    return out


def each(batches):
    """A row (NAMED, node, asking) for every class of sorted rows of CHOSEN, however often a block's rows name it."""
    for key, rows in groupby(rows_of(batches), itemgetter(slice(0, 5))):
        nodes, asking = (b"".join(x) for x in list(zip(*rows, strict=True))[5:])
        nodes, at = np.unique(np.frombuffer(nodes, np.int64), return_index=True)
        yield batch_of([*([x] * len(nodes) for x in key), nodes, np.frombuffer(asking, np.bool_)[at]], f"{NAMED}, node long, asking boolean")


def level_links(units: DataFrame, rows: DataFrame, sets: DataFrame, depth: int, threshold: float, block: int, large: bool) -> list[DataFrame]:
    """LINKS of the pairs that units (tree, hi, lo, size) are the first ones to hold; rows: see units_of(), sets: node, weight, label, shingles; large: whether a unit has more than block classes.

    Strings and shingles are joined to a class once for each of its units, before its block meets others.
    """
    blocks = F.ceil(F.col("size") / block).cast("int")
    members = rows.join(units, ["tree", "hi", "lo"]).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = materialize(members.select(*KEY, "node", "asking"), "members")

    def choose(met_units):
        for key, of, left, c in met_units:
            used = with_pairs(c.asking, c.label, left, key[0], depth)
            for k in np.unique(of[used]).tolist():
                mine = used[of[used] == k]
                yield batch_of([[x] for x in (*key[:4], k, c.nodes[mine].tobytes(), c.asking[mine].tobytes())], CHOSEN)

    strings = members.join(sets.select("node", "label").hint("merge"), "node").select(*KEY, "node", "asking", "label")
    chosen = meet(strings, choose, CHOSEN, "chosen", 1000, large)
    discard(members)
    compared = chosen[0].mapInArrow(tidy(each), f"{NAMED}, node long, asking boolean")
    if large:
        compared = compared.unionByName(chosen[1].repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(tidy(each), f"{NAMED}, node long, asking boolean"))
    compared = materialize(compared, "compared")
    discard(*chosen)

    def compare(met_units):
        out = []
        for key, _, left, c in met_units:
            out.extend(verify(c.nodes, c.weights, c.asking, c.label, c.sets, left, key[0], depth, threshold))
            if len(out) >= 1000:
                yield batch_of(list(zip(*out, strict=True)), LINKS)
                out.clear()
        if out:
            yield batch_of(list(zip(*out, strict=True)), LINKS)

    wide = compared.join(sets, "node").select(*KEY, "node", "asking", "label", "weight", "shingles")
    found = meet(wide, compare, LINKS, "similar", 256, large)
    discard(compared)
    return found


def join_similar(docs: DataFrame, threshold: float = 0.8, words: int = WORDS, target: float = TARGET_RECALL, block: int = BLOCK, levels: list | None = None) -> DataFrame:
    """oid, tkey (of the row), class_oid and group_oid, group_key, n_links, copies for every distinct (doc_id, text) of docs.

    oid is doc_id, NO_ID where that is null; class_oid: least oid among equal sets; (group_oid, group_key): the first
    document of its group; n_links: other documents with a similarity of at least threshold; copies: rows that agree in doc_id and text.
    """
    oid, tkey = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.xxhash64("text")
    plain = docs.select(oid.alias("oid"), tkey.alias("tkey"), F.col("text").cast("string").alias("text"))
    with batches_of(docs.sparkSession, 1000):
        found = materialize(profiles(plain, words), "profiles")
    keys = found.groupBy("oid", "tkey").agg(F.count("*").alias("copies"))
    classes = found.where(F.col("n") > 0).groupBy("digest").agg(F.min(F.struct("oid", "tkey")).alias("first"), F.count("*").alias("weight"), F.first("hi").alias("hi"), F.first("lo").alias("lo"))
    # the number is stored with the class: it names it from here on
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    tables = forest_links(classes, plain, threshold, words, target, block, levels)
    links = docs.sparkSession.createDataFrame([], LINKS)
    for t in tables:
        links = links.unionByName(t)
    counts = links.where(F.col("b").isNull()).groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    near = materialize(components(links.where(F.col("b").isNotNull()).select("a", "b")), "near-groups")
    per = classes.select("digest", "node", "first", "weight").join(counts, "node", "left").join(near, "node", "left").withColumn("component", F.coalesce("component", "node"))
    per = materialize(per, "near-classes")
    discard(near, classes, *tables)
    heads = materialize(per.groupBy("component").agg(F.min("first").alias("head")), "group-heads")
    per = per.join(heads, "component").select("digest", F.col("first.oid").alias("class_oid"), "head", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    per = materialize(per, "near-results")
    known = found.where(F.col("digest").isNotNull()).select("oid", "tkey", "digest").join(per, "digest").select("oid", "tkey", "class_oid", F.col("head.oid").alias("group_oid"), F.col("head.tkey").alias("group_key"), "n_links")
    alone = found.where(F.col("digest").isNull()).select("oid", "tkey", F.col("oid").alias("class_oid"), F.col("oid").alias("group_oid"), F.col("tkey").alias("group_key"), F.lit(0).cast("long").alias("n_links"))
    # one row per row of docs; copies tells rows that agree
    return known.unionByName(alone).join(keys, ["oid", "tkey"])


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row per row of docs: doc_id, class_id (least doc_id of an equal set), n_links, component_id (least doc_id of its group), kept."""
    out = join_similar(docs, threshold)
    back = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    kept = (F.col("oid") == F.col("group_oid")) & (F.col("tkey") == F.col("group_key"))
    return out.select(back("oid").alias("doc_id"), back("class_oid").alias("class_id"), "n_links", back("group_oid").alias("component_id"), F.coalesce(kept, F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """All columns of docs, one row per group of near-duplicates: its first by doc_id. Rows without words stay, but once if they repeat doc_id and text.

    Of rows that agree in doc_id and text, whatever else they hold, the one with the least hash of all its columns counts.
    """
    found = join_similar(docs, threshold)
    kept = materialize(found.where((F.col("oid") == F.col("group_oid")) & (F.col("tkey") == F.col("group_key"))).select(F.col("oid").alias("lexi_oid"), F.col("tkey").alias("lexi_key"), "copies").distinct(), "kept")
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)) == F.col("lexi_oid"), F.xxhash64("text") == F.col("lexi_key")]
    once = docs.join(kept.where(F.col("copies") == 1), key, "left_semi")
    if kept.where(F.col("copies") > 1).isEmpty():
        return once
    # few rows: those that repeat both doc_id and text
    columns = [quoted(c) for c in docs.columns]
    known = [quoted(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    again = docs.join(kept.where(F.col("copies") > 1), key, "left_semi")
    first = again.groupBy("doc_id", "text").agg(F.min_by(F.struct(*columns), F.xxhash64(*known)).alias("lexi_row"))
    return once.unionByName(first.select("lexi_row.*"))
