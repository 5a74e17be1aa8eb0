"""Near-duplicate embeddings by an epsilon grid order join.

On unit vectors a cosine of at least c is a distance of at most eps = sqrt(2 - 2 c). Distinct vectors are
sorted by their grid cells (side eps) on the leading principal dimensions, lexicographically, and cut into
blocks. The join runs over the sorted sequence: pairs of sequence intervals (the range partitions) are
halved recursively, and an interval pair whose bounding boxes are farther apart than eps is skipped as a whole;
the same recursion over the blocks of two joined intervals leaves the pairs of blocks that can hold links. For a pair of
blocks a single-precision product finds candidates with a safe margin, a
double-precision cosine of the original vectors decides. It returns link counts and a spanning
forest of its links, never the links themselves.

A pair of intervals is one task. The blocks lie in the shared folder, a folder per interval; the task reads those of one interval that it needs, then goes through the other's
one by one. So vectors are shuffled once, when they are sorted, and read once for each interval that theirs is paired with: at most INTERVALS times, until an
interval would hold more than INTERVAL_MOST vectors (about 128 million vectors in all), beyond which there are more of them.

The principal axes are fitted on at most SAMPLE vectors; they only set the order and the boxes,
so a bad fit costs time and no link. The driver holds the intervals' boxes and pairs.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id, link with nothing;
vectors of different lengths do not link; equal vectors are joined once, with their number as weight
(a number stored with the distinct vector names them, so rows that repeat an id stay apart);
an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, drop_path, filesystem, materialize, new_path, tidy
from .graph import components
from .vectors import matrix, valid

SAMPLE, INTERVALS, INTERVAL_ROWS, INTERVAL_MOST, BLOCK_ROWS, LEADING = 4096, 128, 4096, 1_000_000, 2048, 8
BLOCKS = "part long, dim long, n long, low array<double>, high array<double>, reps binary, weights binary, vectors binary"


def axes(sample: np.ndarray, leading: int) -> np.ndarray:
    """The leading principal axes, one per column."""
    _, vec = np.linalg.eigh(np.cov(sample.T).reshape(sample.shape[1], -1))
    return np.ascontiguousarray(vec[:, ::-1][:, :leading])


def interval_pairs(boxes: list[tuple], eps: float, start: list[tuple[int, int, int, int]] | None = None) -> list[tuple[int, int]]:
    """Pairs i <= j of a sequence of boxes (dim, low, high) that come within eps, by recursion over pairs of its stretches; a box of dimension 0 meets none.

    start: the pairs of stretches (a to b, c to d, ends excluded) to begin with; by default the whole sequence with itself.
    """
    tree: dict = {}

    def box(a: int, b: int):
        if (a, b) not in tree:
            if b - a == 1:
                dim, low, high = boxes[a]
                tree[a, b] = ({dim}, np.array(low), np.array(high)) if dim else (set(), None, None)
            else:
                m = (a + b) // 2
                (d, l1, h1), (e, l2, h2) = box(a, m), box(m, b)
                tree[a, b] = (d | e, l1 if l2 is None else l2 if l1 is None else np.minimum(l1, l2), h1 if h2 is None else h2 if h1 is None else np.maximum(h1, h2))
        return tree[a, b]

    out, todo = [], ([(0, len(boxes), 0, len(boxes))] if boxes else []) if start is None else list(start)
    while todo:
        a, b, c, d = todo.pop()
        (e, l1, h1), (f, l2, h2) = box(a, b), box(c, d)
        if not e & f:
            continue
        gap = np.maximum(0, np.maximum(l1 - h2, l2 - h1))
        if gap @ gap > eps * eps:
            continue
        if b - a == 1 and d - c == 1:
            out.append((a, c))
        elif (a, b) == (c, d):
            m = (a + b) // 2
            todo += [(a, m, a, m), (a, m, m, b), (m, b, m, b)]
        elif b - a >= d - c:
            m = (a + b) // 2
            todo += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            todo += [(a, b, c, m), (a, b, m, d)]
    return out


class Blocks:
    """The stored blocks of an interval, which is some parts of the sorted sequence: boxes (of dimension 0 for vectors of another dimension), then vectors by number."""

    def __init__(self, folder: str, dim: int, parts: list[int]):
        from pyarrow import fs

        self.files = []
        for part in parts:
            system, path = filesystem(f"{folder}/part={part}")
            # files of one finished job, in one order for every reader
            self.files += [(system, f.path) for f in sorted(system.get_file_info(fs.FileSelector(path)), key=lambda f: f.path) if f.path.endswith(".parquet")]
        heads = [r for b in self.rows(["dim", "low", "high"], 64) for r in b]
        self.boxes = [(r["dim"] if r["dim"] == dim else 0, r["low"], r["high"]) for r in heads]

    def rows(self, columns: list[str], size: int = 1):
        import pyarrow.parquet as pq

        for system, path in self.files:
            with system.open_input_file(path) as f, pq.ParquetFile(f) as table:
                for batch in table.iter_batches(batch_size=size, columns=columns):
                    yield batch.to_pylist()

    def vectors(self, wanted: set[int]):
        """(number, reps, weights, vectors) of the blocks of these numbers, one at a time."""
        for k, (r,) in enumerate(self.rows(["dim", "n", "reps", "weights", "vectors"])):
            if k in wanted:
                yield k, np.frombuffer(r["reps"], "<i8"), np.frombuffer(r["weights"], "<i8"), stored(r["vectors"], r["n"], r["dim"])


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def links(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of x and y with a cosine of at least `least`, in double precision."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    near = (x / nx[:, None]).astype(np.float32) @ (y / ny[:, None]).astype(np.float32).T
    # single precision errs by less than 1e-6 for each of the components' roots
    i, j = np.nonzero(near >= np.float32(least - 1e-5 - 1e-7 * x.shape[1]))
    keep = np.zeros(len(i), bool)
    for lo in range(0, len(i), 65536):
        a, b = i[lo : lo + 65536], j[lo : lo + 65536]
        keep[lo : lo + 65536] = np.einsum("nd,nd->n", x[a], y[b]) / (nx[a] * ny[b]) >= least
    return i[keep], j[keep]


def intervals_of(n: int, interval_rows: int = INTERVAL_ROWS, most: int = INTERVAL_MOST) -> int:
    """The number of intervals of n vectors: of interval_rows each up to INTERVALS, then growing ones of up to `most`."""
    return max(1, min(-(-n // interval_rows), max(INTERVALS, -(-n // most))))


def grouped(parts: list[tuple], rows: int) -> list[tuple]:
    """Intervals (dim, low, high, parts) of about `rows` vectors from the boxes (dim, part, low, high, n) of consecutive parts of the sequence, whatever number of them it was dealt to."""
    out: list[tuple] = []
    room = 0
    for dim, part, low, high, n in parts:
        low, high = np.array(low), np.array(high)
        if out and out[-1][0] == dim and n <= room:
            _, l0, h0, some = out[-1]
            out[-1] = (dim, np.minimum(l0, low), np.maximum(h0, high), [*some, part])
            room -= n
        else:
            out.append((dim, low, high, [part]))
            room = rows - n
    return out


def near_duplicates(vectors: DataFrame, least: float = 0.9, interval_rows: int = INTERVAL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of vectors (vec_id, embedding): vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable), kept."""
    spark = vectors.sparkSession
    eps = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-6
    found = valid(vectors)
    classes = materialize(found.groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight")).withColumn("rep", F.monotonically_increasing_id()), "eps-classes")
    n = classes.count()

    # principal axes of the commonest length, from a bounded sample
    lengths = classes.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    common = lengths[0]["dim"] if lengths else 0
    some = classes.where(F.size("embedding") == common).orderBy(F.xxhash64("embedding"), "embedding").limit(SAMPLE).select("embedding").collect()
    basis = axes(unit(np.array([r[0] for r in some])), LEADING) if len(some) > 1 else np.eye(common)[:, :LEADING]
    basis_ = spark.sparkContext.broadcast((common, basis))

    def place(batches):
        dim0, axes_ = basis_.value
        for b in batches:
            lists = b.column(0)
            dims = np.diff(lists.offsets.to_numpy())
            for dim in np.unique(dims):
                at = pa.array(np.nonzero(dims == dim)[0])
                x = matrix(lists.take(at))
                lead = unit(x) @ (axes_ if dim == dim0 else np.eye(dim)[:, :LEADING])
                lead = np.pad(lead, ((0, 0), (0, LEADING - lead.shape[1])))
                cell = np.floor(lead / eps).astype(np.int64) + (1 << 20)
                order = [c.tobytes() for c in cell.astype(">u4")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(dim)] * len(x), pa.int64()), pa.array(order, pa.binary()), pa.array(lead.tolist(), pa.list_(pa.float64())), b.column(1).take(at), b.column(2).take(at), lists.take(at)],
                    ["dim", "cell", "lead", "rep", "weight", "embedding"],
                )

    placed = materialize(classes.select("embedding", "rep", "weight").mapInArrow(place, "dim long, cell binary, lead array<double>, rep long, weight long, embedding array<double>"), "eps-placed")
    parts = intervals_of(n, interval_rows)

    def cut(batches):
        part, held = TaskContext.get().partitionId(), []
        for b in batches:
            at = 0
            while at < b.num_rows:
                room = block_rows - sum(h.num_rows for h in held)
                held.append(b.slice(at, room))
                at += room
                if sum(h.num_rows for h in held) >= block_rows:
                    yield from rows_of(held, part)
                    held = []
        if held:
            yield from rows_of(held, part)

    def rows_of(held, part):
        t = pa.Table.from_batches(held).combine_chunks()
        dims = t["dim"].to_numpy()
        for dim in np.unique(dims):
            some_ = t.filter(pa.array(dims == dim)).combine_chunks()
            lead = matrix(some_["lead"].combine_chunks())
            x = matrix(some_["embedding"].combine_chunks())
            short = x.astype(np.float32)
            x = short if np.array_equal(short, x) else x
            yield pa.RecordBatch.from_pylist([{
                "part": part, "dim": int(dim), "n": len(x), "low": lead.min(axis=0).tolist(), "high": lead.max(axis=0).tolist(),
                "reps": some_["rep"].to_numpy().astype("<i8").tobytes(), "weights": some_["weight"].to_numpy().astype("<i8").tobytes(), "vectors": x.astype(x.dtype.newbyteorder("<")).tobytes(),
            }], pa.schema([(c.split()[0], pa.list_(pa.float64()) if "array" in c else pa.binary() if c.endswith("binary") else pa.int64()) for c in BLOCKS.split(", ")]))

    ordered = placed.repartitionByRange(parts, "dim", "cell", F.col("lead")[0]).sortWithinPartitions("dim", "cell", F.col("lead")[0])
    folder = new_path(spark, "eps-blocks")
    ordered.mapInArrow(cut, BLOCKS).write.partitionBy("part").parquet(folder)
    discard(placed)

    # the recursion over intervals; that over their blocks is the tasks'
    blocks = spark.read.schema(BLOCKS).parquet(folder)
    sums = blocks.groupBy("dim", "part").agg(F.array(*(F.min(F.col("low")[k]) for k in range(LEADING))).alias("low"), F.array(*(F.max(F.col("high")[k]) for k in range(LEADING))).alias("high"), F.sum("n").alias("n")).collect()
    intervals = grouped(sorted(map(tuple, sums)), -(-n // parts))
    pairs = [(intervals[i][0], intervals[i][3], intervals[j][3] if i != j else None) for i, j in interval_pairs([x[:3] for x in intervals], eps)]
    pairs_ = spark.sparkContext.broadcast(pairs)

    def work(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                dim, one, two = pairs_.value[k]
                left = Blocks(folder, dim, one)
                right = left if two is None else Blocks(folder, dim, two)
                na, nb = len(left.boxes), len(right.boxes)
                found = interval_pairs(left.boxes, eps) if two is None else interval_pairs(left.boxes + right.boxes, eps, [(0, na, na, na + nb)])
                with_: dict[int, list[int]] = {}
                for x, y in found:
                    with_.setdefault(y if two is None else y - na, []).append(x)
                held = {x: (ra, wa, v) for x, ra, wa, v in left.vectors({x for x, _ in found})}
                for y, rb, wb, v in right.vectors(set(with_)):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in joined_blocks([(x == y and two is None, *held[x]) for x in with_[y]], (rb, wb, v), least)], ["a", "b", "links"])

    tasks = max(1, min(len(pairs), 20_000))
    found_links = materialize(spark.range(0, len(pairs), 1, tasks).mapInArrow(tidy(work), "a long, b long, links long"), "eps-links")
    counts = found_links.where(F.col("b").isNull()).groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    group = components(found_links.where(F.col("b").isNotNull()).select("a", "b"))
    per_class = classes.join(counts, "rep", "left").join(group, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep"))
    per_class = materialize(per_class, "eps-components")
    least = materialize(per_class.groupBy("component").agg(F.min("first").alias("component_id")), "eps-heads")
    per_class = per_class.join(least, "component")
    per_class = materialize(per_class.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"), "eps-result")
    drop_path(spark, folder)
    rows_ = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows_ = rows_.withColumn("embedding", F.when(F.col("vec_id").isNotNull(), F.col("embedding")))
    # a null vector matches no class; a null key would meet in one task, so each gets a key of its own
    key = F.coalesce(F.col("embedding"), F.array(F.lit(float("nan")), F.coalesce(F.col("vec_id"), F.xxhash64(F.monotonically_increasing_id())).cast("double")))
    joined = rows_.select("vec_id", key.alias("embedding")).join(per_class, "embedding", "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None]


def stored(data: bytes, n: int, dim: int) -> np.ndarray:
    """A block's vectors as they are stored: as floats where these hold its values exactly, else as doubles."""
    return np.frombuffer(data, f"<f{len(data) // (n * dim)}").reshape(n, dim)


def joined_blocks(others: list[tuple], block: tuple, least: float) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(a, b, links) of a block (reps, weights, vectors) with each of others (whether it is itself, reps, weights, vectors): a row with the number of links of each vector that has some, and rows of a forest that spans the links."""
    rb, wb, y = block
    y = y.astype(np.float64)
    a, b, n = [], [], []
    mine = np.zeros(len(rb), np.int64)
    for same, ra, wa, x in others:
        i, j = links(y if same else x.astype(np.float64), y, least)
        if same:
            i, j = i[i < j], j[i < j]
        na = np.bincount(i, weights=wb[j], minlength=len(ra)).astype(np.int64)
        mine += np.bincount(j, weights=wa[i], minlength=len(rb)).astype(np.int64)
        forest, shift = Union(len(ra) + len(rb)), 0 if same else len(ra)
        tree = np.fromiter((forest.join(p, q + shift) for p, q in zip(i.tolist(), j.tolist(), strict=True)), bool, len(i))
        has = np.flatnonzero(na)
        a += [ra[has], ra[i[tree]]]
        b += [np.full(len(has), -1), rb[j[tree]]]
        n += [na[has], np.zeros(int(tree.sum()), np.int64)]
    has = np.flatnonzero(mine)
    a, b, n = np.concatenate([*a, rb[has]]), np.concatenate([*b, np.full(len(has), -1)]).astype(np.int64), np.concatenate([*n, mine[has]])
    return a, pa.array(b, mask=b < 0), n
