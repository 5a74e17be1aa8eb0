"""Nearest neighbours with a hierarchical navigable small-world graph per shard.

Vectors are dealt to shards by a hash of their id and components. Each shard is built by one task: equal vectors become one node, the layers of the
graph are flat arrays of neighbour numbers, filled by inserting blocks of nodes with a
beam search that runs for the whole block at once. An index row holds the ids, vectors and neighbour
arrays of a shard as binary columns. Shards grow with the table up to SHARD_MOST vectors, so a query asks at most SHARDS of them below 134 million vectors.

A task of a search gets several shards and opens each once. The queries lie in the shared folder in blocks; the task takes them from there, block after
block, scores each shard's nearest from the original vectors in double precision, and keeps the k nearest of each query over its shards. Tasks' answers, k for each query
and task, are merged per query. Tables of more than SLICE queries go in slices, which bound what a task keeps.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and null ids, take no part; vectors of another length than
the query's are no candidates; of rows that repeat a query's id one (by digest) asks, and none of them is its candidate; equal rows are counted, and are
as many candidates; fewer than k candidates give fewer rows; an empty table gives none; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filesystem, materialize, new_path, tidy
from .vectors import batches_of, matrix, valid

SHARD_ROWS, SHARD_MOST, SHARDS, BLOCK, SLICE, TASKS = 8192, 131_072, 1024, 512, 1 << 20, 1024
M, EF_BUILD, EF_SEARCH, EXPAND = 16, 96, 128, 4
INDEX = "shard long, dim long, n long, ids binary, copies binary, id_ends binary, vectors binary, top long, entry long, neighbours binary"


def distances(x: np.ndarray, q: np.ndarray, cand: np.ndarray) -> np.ndarray:
    """Squared distances of each row of q to its own candidates (numbers of rows of x)."""
    diff = x[cand] - q[:, None, :]
    return np.einsum("bcd,bcd->bc", diff, diff)


class Graph:
    """layers[l]: neighbour numbers of every node, -1 where none; layer 0 holds 2 M of them, the others M."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray], entry: int):
        self.x, self.layers, self.entry = x, layers, entry

    def beam(self, q: np.ndarray, layer: int, start: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row of q the ef nearest nodes found from its start nodes: numbers (-1: none) and squared distances, nearest first."""
        table, b = self.layers[layer], len(q)
        seen = np.zeros((b, len(self.x) + 1), bool)  # the last column stands for -1
        rows = np.arange(b)[:, None]
        ids = np.full((b, ef), -1, np.int64)
        dist = np.full((b, ef), np.inf, self.x.dtype)
        start = start[:, :ef]
        ids[:, : start.shape[1]] = start
        dist[:, : start.shape[1]] = np.where(start >= 0, distances(self.x, q, start), np.inf)
        seen[rows, start] = True
        done = ids < 0
        while True:
            open_ = np.where(done, np.inf, dist)
            pick = np.argpartition(open_, min(EXPAND, ef - 1), axis=1)[:, :EXPAND]
            ok = np.isfinite(open_[rows, pick])
            live = ok.any(axis=1)
            if not live.any():
                order = np.argsort(dist, axis=1, kind="stable")
                return ids[rows, order], dist[rows, order]
            done[rows, pick] = True
            near = np.where(ok[:, :, None], table[np.maximum(ids[rows, pick], 0)], -1)[live].reshape(live.sum(), -1)
            who = np.nonzero(live)[0][:, None]
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near = np.where(seen[who, near], -1, near)
            seen[who, near] = True
            keep = (near >= 0).sum(axis=1).max(initial=0)
            if not keep:
                continue
            near = -np.sort(-near, axis=1)[:, :keep]
            d = np.where(near >= 0, distances(self.x, q[live], near), np.inf)
            all_d = np.concatenate([dist[live], d], axis=1)
            best = np.argpartition(all_d, ef - 1, axis=1)[:, :ef]
            r = np.arange(len(best))[:, None]
            dist[live] = all_d[r, best]
            ids[live] = np.concatenate([ids[live], near], axis=1)[r, best]
            fresh = np.concatenate([done[live], np.zeros(near.shape, bool)], axis=1)[r, best]
            done[live] = fresh | ~np.isfinite(dist[live])

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        start = np.full((len(q), 1), self.entry)
        for layer in range(len(self.layers) - 1, 0, -1):
            start = self.beam(q, layer, start, 8)[0]
        return self.beam(q, 0, start, ef)


def spread(x: np.ndarray, at: np.ndarray, cand: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
    """Of each node's candidates (nearest first) up to most of them, each nearer to the node than to any chosen before it; the nearest others fill up."""
    b, c = cand.shape
    vec = x[np.maximum(cand, 0)]
    norm = np.einsum("bcd,bcd->bc", vec, vec)
    mutual = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(vec, vec.transpose(0, 2, 1))
    nearest = np.full((b, c), np.inf, x.dtype)  # to the chosen
    chosen = np.zeros((b, c), bool)
    valid_ = cand >= 0
    for k in range(c):
        take = valid_[:, k] & (dist[:, k] < nearest[:, k]) & (chosen.sum(axis=1) < most)
        chosen[:, k] = take
        nearest = np.where(take[:, None], np.minimum(nearest, mutual[:, k]), nearest)
    order = np.argsort(np.where(chosen, 0, np.where(valid_, 1, 2)), axis=1, kind="stable")[:, :most]
    out = np.where(np.take_along_axis(valid_, order, 1), np.take_along_axis(cand, order, 1), -1)
    return out if c >= most else np.pad(out, ((0, 0), (0, most - c)), constant_values=-1)


def build(x: np.ndarray, seed: int = 0) -> Graph:
    """Insert the rows of x (all different), nodes of the upper layers first, in blocks no larger than what is there already."""
    n = len(x)
    level = np.minimum((-np.log(np.random.default_rng(seed).random(n)) / np.log(M)).astype(np.int64), 8)
    order = np.argsort(-level, kind="stable")
    g = Graph(x, [np.full((n, 2 * M if k == 0 else M), -1, np.int32) for k in range(int(level.max(initial=0)) + 1)], int(order[0]))
    at = 1
    while at < n:
        new = order[at : at + min(BLOCK, max(at, 8))]
        q, start = x[new], np.full((len(new), 1), g.entry)
        for layer in range(len(g.layers) - 1, -1, -1):
            found, dist = g.beam(q, layer, start, EF_BUILD if layer <= level[new].max() else 8)
            start = found[:, :8]
            here = np.nonzero(level[new] >= layer)[0]
            if len(here):
                connect(g, layer, new[here], found[here], dist[here])
        at += len(new)
    return g


def connect(g: Graph, layer: int, new: np.ndarray, found: np.ndarray, dist: np.ndarray) -> None:
    x, table, most = g.x, g.layers[layer], g.layers[layer].shape[1]
    # the block's own nodes are candidates of each other
    own = x[new]
    norm = np.einsum("bd,bd->b", own, own)
    peers = norm[:, None] + norm[None, :] - 2 * own @ own.T
    np.fill_diagonal(peers, np.inf)
    k = min(len(new) - 1, 2 * M)
    if k:
        near = np.argpartition(peers, k - 1, axis=1)[:, :k]
        found = np.concatenate([found, new[near]], axis=1)
        dist = np.concatenate([dist, np.take_along_axis(peers, near, 1)], axis=1)
    first = np.argsort(dist, axis=1, kind="stable")[:, :EF_BUILD]
    cand, dist = np.take_along_axis(found, first, 1), np.take_along_axis(dist, first, 1)
    picked = spread(x, new, cand, dist, M)
    table[new, :M] = picked
    # and back
    src, dst = np.repeat(new, picked.shape[1]), picked.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    by = np.argsort(dst, kind="stable")
    src, dst = src[by], dst[by]
    nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
    for lo in range(0, len(nodes), 1024):
        some, n, f = nodes[lo : lo + 1024], count[lo : lo + 1024], first[lo : lo + 1024]
        slots = np.arange(n.max())[None, :]
        back = np.where(slots < n[:, None], src[np.minimum(f[:, None] + slots, len(src) - 1)], -1)
        both = np.concatenate([table[some].astype(np.int64), back], axis=1)
        both = -np.sort(-both, axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        room = (both >= 0).sum(axis=1)
        d = np.where(both >= 0, distances(x, x[some], np.maximum(both, 0)), np.inf)
        rank = np.argsort(d, axis=1, kind="stable")
        both, d = np.take_along_axis(both, rank, 1), np.take_along_axis(d, rank, 1)
        over = room > most
        table[some[~over]] = np.pad(both[~over], ((0, 0), (0, max(0, most - both.shape[1]))), constant_values=-1)[:, :most]
        if over.any():
            wide = min(both.shape[1], 3 * most)
            table[some[over]] = spread(x, some[over], both[over][:, :wide], d[over][:, :wide], most)


def shard_row(shard: int, ids: np.ndarray, copies: np.ndarray, x: np.ndarray) -> dict:
    """An index row. Equal vectors are one node that lists all their ids, ascending, with the number of each."""
    by = np.argsort(ids, kind="stable")
    ids, copies, x = ids[by], copies[by], x[by]
    x = x + 0.0  # one zero
    _, first, node = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
    by = np.argsort(node, kind="stable")
    g = build(np.ascontiguousarray(x[first], np.float32), int(shard))
    return {
        "shard": shard, "dim": x.shape[1], "n": len(first), "ids": ids[by].astype("<i8").tobytes(), "copies": copies[by].astype("<i8").tobytes(), "id_ends": np.cumsum(np.bincount(node)).astype("<i8").tobytes(),
        "vectors": x[first].astype("<f8").tobytes(), "top": len(g.layers), "entry": g.entry, "neighbours": b"".join(t.astype("<i4").tobytes() for t in g.layers),
    }


def open_row(row: dict):
    n, dim = row["n"], row["dim"]
    x = np.frombuffer(row["vectors"], "<f8").reshape(n, dim)
    flat, layers, at = np.frombuffer(row["neighbours"], "<i4"), [], 0
    for k in range(row["top"]):
        wide = 2 * M if k == 0 else M
        layers.append(flat[at : at + n * wide].reshape(n, wide))
        at += n * wide
    return Graph(x.astype(np.float32), layers, row["entry"]), x, np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["copies"], "<i8"), np.frombuffer(row["id_ends"], "<i8")


def shards_of(n: int, shard_rows: int = SHARD_ROWS) -> int:
    """The number of shards of n vectors: of shard_rows each up to SHARDS of them, then growing ones of up to SHARD_MOST."""
    return max(1, min(-(-n // shard_rows), max(SHARDS, -(-n // SHARD_MOST))))


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """INDEX rows of vectors (vec_id, embedding), stored in the shared folder. Every row is indexed."""
    found = valid(vectors)
    n = found.count()
    # equal rows would meet in one shard, however many there are: where ids repeat, they are counted first
    repeated = found.groupBy("vec_id").count().where("count > 1").limit(1).count()
    counted = found.groupBy("vec_id", "embedding").agg(F.count("*").alias("copies")) if repeated else found.withColumn("copies", F.lit(1).cast("long"))
    keyed = counted.withColumn("shard", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards_of(n, shard_rows))))

    def run(table):
        ids, copies, lists = table["vec_id"].to_numpy(), table["copies"].to_numpy(), table["embedding"].combine_chunks()
        dims, out = np.diff(lists.offsets.to_numpy()), []
        for dim in np.unique(dims):
            at = np.nonzero(dims == dim)[0]
            out.append(shard_row(table["shard"][0].as_py(), ids[at], copies[at], matrix(lists.take(pa.array(at)))))
        return pa.Table.from_pylist(out, pa.schema([(c.split()[0], pa.binary() if c.endswith("binary") else pa.int64()) for c in INDEX.split(", ")]))

    # much work for few bytes: a range of numbers gives each shard a task, where a hash and the adaptive plan would put several into one
    dealt = keyed.repartitionByRange(shards_of(n, shard_rows), "shard")
    return materialize(dealt.groupBy("shard").applyInArrow(run, INDEX), "hnsw")


def query_blocks(folder: str, part: int):
    """(dimension, ids, vectors) of a slice's blocks of queries, in one order for every reader."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, path = filesystem(f"{folder}/slice={part}")
    for f in sorted(system.get_file_info(fs.FileSelector(path)), key=lambda f: f.path):
        if f.path.endswith(".parquet"):
            with system.open_input_file(f.path) as file, pq.ParquetFile(file) as table:
                for batch in table.iter_batches(batch_size=1, columns=["q_dim", "q_ids", "q_vectors"]):
                    for row in batch.to_pylist():
                        yield row["q_dim"], np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["q_vectors"], "<f8").reshape(-1, row["q_dim"])


def answers(opened, asks: np.ndarray, q: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """(distances, ids) of the k nearest found in a shard for each query, nearest first, ties to the smaller id; infinite where there are fewer."""
    g, x, ids, copies, ends = opened
    found = g.search(q.astype(np.float32), max(ef, k + 1))[0]
    diff = x[np.maximum(found, 0)] - q[:, None, :]
    dist = np.where(found >= 0, np.sqrt(np.einsum("bcd,bcd->bc", diff, diff)), np.inf)
    out_d, out_v = np.full((len(asks), k), np.inf), np.full((len(asks), k), -1, np.int64)
    for i, own in enumerate(asks.tolist()):
        best: list = []
        for j in np.argsort(dist[i], kind="stable"):
            d = dist[i, j]
            if not np.isfinite(d) or len(best) >= k and d > best[k - 1][0]:
                break
            node = found[i, j]
            # of equal vectors only the first k other ids can be among the k nearest
            some = slice(ends[node - 1] if node else 0, ends[node])
            others = np.flatnonzero(ids[some] != own)[:k]
            same = np.repeat(ids[some][others], np.minimum(copies[some][others], k))[:k]
            best += [(float(d), int(v)) for v in same]
            best.sort()
        for r, (d, v) in enumerate(best[:k]):
            out_d[i, r], out_v[i, r] = d, v
    return out_d, out_v


def merged(one: tuple, two: tuple, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of two answers."""
    d, v = (np.concatenate(x, axis=1) for x in zip(one, two, strict=True))
    order = np.lexsort((v, d), axis=1)[:, :k]  # by distance, then by id
    return np.take_along_axis(d, order, 1), np.take_along_axis(v, order, 1)


def search(index: DataFrame, queries: DataFrame, k: int = 10, ef: int = EF_SEARCH, block: int = 1024, slice_rows: int = SLICE, tasks: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found by Euclidean distance, ties to the smaller vec_id, the query's own id left out."""
    spark = index.sparkSession
    asked = valid(queries).groupBy("vec_id").agg(F.min_by("embedding", F.xxhash64("embedding")).alias("embedding"))
    n = asked.count()
    slices = -(-n // slice_rows) or 1

    def gather(batches):
        part = TaskContext.get().partitionId() % slices
        for b in batches:
            dims = np.diff(b.column(1).offsets.to_numpy())
            for dim in np.unique(dims):
                at = np.nonzero(dims == dim)[0]
                for lo in range(0, len(at), block):
                    some = at[lo : lo + block]
                    x = matrix(b.column(1).take(pa.array(some)))
                    yield pa.RecordBatch.from_pylist([{"slice": part, "q_dim": int(dim), "q_ids": b.column(0).to_numpy()[some].astype("<i8").tobytes(), "q_vectors": x.astype("<f8").tobytes()}], pa.schema([("slice", pa.int32()), ("q_dim", pa.int32()), ("q_ids", pa.binary()), ("q_vectors", pa.binary())]))

    folder = new_path(spark, "hnsw-queries")
    parts = max(slices, -(-n // (4 * block)))
    asked.repartition(parts).mapInArrow(gather, "slice int, q_dim int, q_ids binary, q_vectors binary").write.partitionBy("slice").parquet(folder)
    there = [r[0] for r in spark.read.parquet(folder).select("slice").distinct().collect()] if n else []
    shards = index.count()
    # several shards a task once there are more than keep all tasks busy
    tasks = tasks or max(1, min(shards * max(1, len(there)), TASKS))
    dealt = index.withColumn("slice", F.explode(F.array(*map(F.lit, there)) if there else F.array().cast("array<int>"))).repartition(tasks)
    if len(there) > 1:
        dealt = dealt.sortWithinPartitions("slice")

    def run(batches):
        now, best = None, []

        def told():
            for asks, (d, v) in best:
                at = np.nonzero(np.isfinite(d))
                yield pa.RecordBatch.from_arrays([pa.array(asks[at[0]]), pa.array(v[at]), pa.array(d[at])], ["query_id", "vec_id", "score"])

        for b in batches:
            for row in b.to_pylist():
                if row["slice"] != now:
                    yield from told()
                    now, best = row["slice"], []
                opened = open_row(row)
                for t, (dim, asks, q) in enumerate(query_blocks(folder, now)):
                    found = answers(opened, asks, q, k, ef) if dim == row["dim"] else (np.full((len(asks), k), np.inf), np.full((len(asks), k), -1, np.int64))
                    if t == len(best):
                        best.append((asks, found))
                    else:
                        best[t] = (asks, merged(best[t][1], found, k))
        yield from told()

    with batches_of(spark, 1):
        found = materialize(dealt.mapInArrow(tidy(run), "query_id long, vec_id long, score double"), "hnsw-found")
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
