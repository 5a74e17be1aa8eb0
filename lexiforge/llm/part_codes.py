"""Product codes of integer vectors, found with a ball tree for each part position.

A vector of finite components becomes floor(scale * x) and is cut into equal parts. Each part position has a codebook that starts as that part of the first vectors by
vec_id and is refined in rounds: every part goes to its nearest entry, then entries become floor(sum / count) of their parts. The nearest entry is found by
metric branch and bound in a ball tree over the entries, for a whole batch of parts at once: balls have radii that are rounded up and distances to their centres
that are rounded down, so a ball is left out only if none of its points can be as near as the best so far; a ball that could tie is visited (the lower index wins ties), and
entries are compared by integer distances. The codebooks are broadcast (parts x entries), integer sums are merged by grouped aggregation as
in lloyd.py, and no vector moves.

Edge cases: vectors that are null or hold null or non-finite components are left out; the vector with the smallest vec_id whose length is a positive multiple of `parts` sets the length,
and vectors of other lengths have a null code and error and take no part in the codebooks; rows without an id come last, rows that repeat an id are vectors of their own, smaller
vectors first; with fewer vectors than entries the codebooks are smaller; equal entries: the lower index gets all parts; distances are exact at any magnitude, and null where they exceed a long (so is the sum
of a label with such a row); a table without vectors gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .integers import Sums, as_long, finite, floors, ids_of, means, merged, named, rows_of, sum_schema, table

LEAF = 16
#: Relative margin of distances in double precision: far above its errors, far below what would cost visits.
MARGIN = 1e-9


def floats(x: np.ndarray) -> np.ndarray:
    """Integers as doubles; those beyond them are infinite, and a ball with infinite bounds is always visited."""
    try:
        return x.astype(np.float64)
    except OverflowError:
        most = 1 << 1000
        return np.where(np.abs(x) < most, np.clip(x, -most, most).astype(np.float64), np.inf)


class Ball:
    """A node over entries `at` (ascending): centre, radius (rounded up), and two children or none."""

    def __init__(self, entries: np.ndarray, at: np.ndarray):
        x = floats(entries[at])
        self.at, self.entries = at, entries[at]
        with np.errstate(all="ignore"):
            self.centre = x.mean(axis=0)
            self.radius = float(np.sqrt(((x - self.centre) ** 2).sum(axis=1)).max()) * (1 + MARGIN)
            spread = x.max(axis=0) - x.min(axis=0)
        self.children: tuple[Ball, ...] = ()
        if len(at) > LEAF and spread.max() > 0:
            order = np.argsort(x[:, int(spread.argmax())], kind="stable")
            self.children = tuple(Ball(entries, np.sort(at[half])) for half in np.array_split(order, 2))

    def bound(self, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Distances (rounded down) from rows of x (doubles, a row for each dimension) to the ball."""
        with np.errstate(all="ignore"):
            return np.sqrt(sum((c[rows] - m) ** 2 for c, m in zip(x, self.centre, strict=True))) * (1 - MARGIN) - self.radius


class Found:
    """The best entry so far of each row."""

    def __init__(self, q: np.ndarray, entries: np.ndarray):
        self.q, self.x = np.ascontiguousarray(q.T), np.ascontiguousarray(floats(q).T)
        self.exact = object in (q.dtype, entries.dtype)
        self.distance = np.full(len(q), -1, object if self.exact else np.int64)
        self.limit = np.full(len(q), np.inf)  # the distance as a double, rounded up
        self.entry = np.full(len(q), len(entries), np.int64)

    def visit(self, ball: Ball, rows: np.ndarray) -> None:
        d = sum((c[rows][:, None] - e[None, :]) ** 2 for c, e in zip(self.q, ball.entries.T, strict=True))
        k = d.argmin(axis=1)
        d, k = d[np.arange(len(rows)), k], ball.at[k]
        had, old = self.entry[rows], self.distance[rows]
        better = (old < 0) | (d < old) | ((d == old) & (k < had))
        rows, d = rows[better], d[better]
        self.entry[rows], self.distance[rows] = k[better], d
        with np.errstate(all="ignore"):
            self.limit[rows] = np.sqrt(floats(d)) * (1 + MARGIN)


def nearest(root: Ball, q: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of each row of q; ties to the lower index."""
    best = Found(q, entries)
    todo = [(root, np.arange(len(q)))]
    while todo:
        ball, rows = todo.pop()
        rows = rows[~(ball.bound(best.x, rows) > best.limit[rows])]
        if not len(rows):
            continue
        if not ball.children:
            best.visit(ball, rows)
            continue
        one, two = ball.children
        first = one.bound(best.x, rows) <= two.bound(best.x, rows)
        todo += [(two, rows[first]), (one, rows[~first]), (one, rows[first]), (two, rows[~first])]  # the nearer child is on top for either half
    return best.entry, best.distance


def first_entries(vectors: DataFrame, parts: int, entries: int, scale: int) -> tuple[int, list[list[list[int]]]]:
    """(length of a part, for each part position its entries) from the first vectors by vec_id."""
    order = (F.col("none"), "id", "embedding")
    fine = vectors.where(finite() & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0))
    head = fine.orderBy(*order).select(F.size("embedding").alias("length")).limit(1).collect()
    if not head:
        return 0, [[] for _ in range(parts)]
    length = head[0]["length"]
    rows = fine.where(F.size("embedding") == length).orderBy(*order).select("embedding").limit(entries).collect()
    x = np.array([r["embedding"] for r in rows], np.float64)
    whole: list[list[int]] = [[] for _ in rows]
    for at, q in floors(x, scale):
        for i, row in zip(at, q.tolist(), strict=True):
            whole[i] = [int(v) for v in row]
    d = length // parts
    return d, [[row[p * d : (p + 1) * d] for row in whole] for p in range(parts)]


def encode(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, group: str = "label") -> DataFrame:
    """vec_id, `group`, code (two hex digits for each part), error, label_error (error summed over equal values of `group`), codebooks_sha256 of vectors (vec_id, embedding, `group`)."""
    spark = vectors.sparkSession
    plain = named(vectors.where(finite()), group)
    d, books = first_entries(plain, parts, entries, scale)

    def opened(shared):
        """For each part its entries and their tree."""
        return [(t, Ball(t, np.arange(len(t)))) for t in (table(b, d) for b in shared.value) if len(t)]

    def assigned(batches, trees):
        """Of each batch: its rows, and groups of (places, integers by part, entries by part, distances by part)."""
        for b in batches:
            at, x = rows_of(b["embedding"], parts * d)
            groups = []
            for i, q in floors(x, scale) if len(trees) else []:
                cut = [q[:, p * d : (p + 1) * d] for p in range(parts)]
                groups.append((at[i], cut, *zip(*(nearest(tree, part, t) for part, (t, tree) in zip(cut, trees, strict=True)), strict=True)))
            yield b, groups

    def sums(shared):
        def task(batches):
            out = Sums(parts * entries, d)
            for _, groups in assigned(batches, opened(shared)):
                for _, cut, codes, _ in groups:
                    out.add(np.concatenate([code + p * entries for p, code in enumerate(codes)]), list(np.concatenate(cut).T))
            yield out.frame()

        return merged(plain.select("id", "none", "embedding").mapInPandas(task, sum_schema(d)), d)

    for _ in range(rounds if d else 0):
        shared = spark.sparkContext.broadcast(books)
        found = sums(shared)
        books = [means(book, {g - p * entries: v for g, v in found.items() if g // entries == p}) for p, book in enumerate(books)]
        shared.destroy()
    shared = spark.sparkContext.broadcast(books)
    digest = hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()

    def result(batches):
        for b, groups in assigned(batches, opened(shared)):
            code, error = np.full(len(b), None, object), np.full(len(b), None, object)
            for at, _, codes, distances in groups:
                hexes = np.stack(codes, axis=1).astype(np.uint8 if entries <= 256 else ">u2")
                wide = 2 * hexes.shape[1] * hexes.itemsize
                text = np.ascontiguousarray(hexes).tobytes().hex()
                code[at] = [text[k * wide : (k + 1) * wide] for k in range(len(at))]
                error[at] = as_long(sum(x.astype(object) for x in distances))
            yield pd.DataFrame({"vec_id": ids_of(b, np.arange(len(b))), group: b[group].array, "code": code, "error": pd.array(error, "Int64")})

    kind = plain.schema[group].dataType.simpleString()
    coded = materialize(plain.mapInPandas(result, f"vec_id long, `{group}` {kind}, code string, error long"), "part-codes")
    total = F.when(F.count("error") == F.count("*"), F.sum(F.col("error").cast("decimal(38,0)"))).try_cast("long")
    by_group = materialize(coded.groupBy(F.col(group).alias("of")).agg(total.alias("label_error")), "part-errors")
    # few labels are broadcast, by the size of their stored table; with many, the join is a shuffle whose hot labels the adaptive skew join splits
    joined = coded.join(by_group, F.col(group).eqNullSafe(F.col("of")))
    return joined.select("vec_id", group, "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def sql(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """DuckDB SQL of the same rows from embeddings, for components of ordinary size, vectors of one length and ids that are there and differ."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""cut AS MATERIALIZED (SELECT vec_id, part, q[1 + part * len(q) // {parts} : (part + 1) * len(q) // {parts}] AS v FROM (SELECT vec_id, q, unnest(range({parts})) AS part FROM kept))""",
        f"""b0 AS MATERIALIZED (SELECT part, entry, v FROM cut JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept) USING (vec_id) WHERE entry < {entries})""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, part, any_value(v) AS v, min(d * {entries} + entry) % {entries} AS entry, min(d) AS d
  FROM (SELECT vec_id, c.part, c.v, entry, list_sum(list_transform(list_zip(c.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT AS d FROM cut c JOIN b{r} b ON b.part = c.part) GROUP BY vec_id, part)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY k)::BIGINT[] AS m
  FROM (SELECT part, entry, k, sum(x)::HUGEINT AS s, count(*) AS n FROM (SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS k FROM a{r}) GROUP BY part, entry, k) GROUP BY part, entry)""")
            steps.append(f"""b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.m, b.v) AS v FROM b{r} b LEFT JOIN m{r} m ON m.part = b.part AND m.entry = b.entry)""")
    return f"""WITH {", ".join(steps)},
coded AS (SELECT vec_id, string_agg(printf('%02x', entry::INT), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT c.vec_id, k.label, code, error, (sum(error) OVER (PARTITION BY k.label))::BIGINT AS label_error, codebooks_sha256 FROM coded c JOIN kept k ON k.vec_id = c.vec_id, book"""
