"""Vectors as integers: exact floors, squared distances and means, at any magnitude.

Components of ordinary size are 64-bit integers in NumPy. Rows whose squared distances would not fit are
Python's integers, in arrays of objects, and go the same way, only slower.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sums travel as digits of this base, so that those of millions of tasks add up in 64 bits.
BASE = 1 << 40
MOST = (1 << 63) - 1


def finite(embedding: str = "embedding") -> Column:
    """True where no component is null, NaN or infinite; false for null vectors."""
    e = F.col(embedding)
    return F.coalesce(F.forall(e, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def named(vectors: DataFrame, *more: str) -> DataFrame:
    """id (0 for null), none (whether it is null), embedding (floats or doubles) and the columns `more`: pandas would turn ids with nulls among them into doubles."""
    kind = vectors.schema["embedding"].dataType
    fine = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))
    id_, e = F.col("vec_id").cast("long"), F.col("embedding")
    return vectors.select(F.coalesce(id_, F.lit(0)).alias("id"), id_.isNull().alias("none"), (e if fine else e.cast("array<double>")).alias("embedding"), *more)


def ids_of(batch: pd.DataFrame, at: np.ndarray) -> pd.arrays.IntegerArray:
    return pd.arrays.IntegerArray(batch["id"].to_numpy()[at].astype(np.int64), batch["none"].to_numpy()[at].astype(bool))


def safe(dims: int) -> int:
    """Integers below it have squared distances over dims components that fit 64 bits, and exact sums as doubles."""
    return min(math.isqrt((1 << 62) // max(dims, 1)) // 2, 1 << 28)


def rows_of(column: pd.Series, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, doubles) of the vectors of dims finite components."""
    fits = np.fromiter((e is not None and len(e) == dims for e in column), bool, len(column))
    at = np.flatnonzero(fits)
    if not len(at):
        return at, np.zeros((0, dims))
    x = np.concatenate([np.asarray(e, np.float64) for e in column.to_numpy()[at]]).reshape(len(at), dims)
    good = np.isfinite(x).all(axis=1)
    return at[good], x[good]


def floors(x: np.ndarray, scale: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, integers) of floor(scale * x): one group of 64-bit rows and one of rows of large integers, if there are any. scale: a power of two."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    large = (np.abs(y) >= safe(x.shape[1])).any(axis=1)
    out = []
    if not large.all():
        out.append((np.flatnonzero(~large), y[~large].astype(np.int64)))
    if large.any():
        exact = [[math.floor(Fraction(v) * scale) for v in row] for row in x[large].tolist()]
        out.append((np.flatnonzero(large), np.array(exact, object).reshape(-1, x.shape[1])))
    return out


def table(rows: list[list[int]], dims: int) -> np.ndarray:
    """Rows of integers as an array: of 64 bits where all are safe."""
    small = all(abs(v) < safe(dims) for r in rows for v in r)
    return np.array(rows, np.int64 if small else object).reshape(len(rows), dims)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances over the last axis."""
    if object in (x.dtype, y.dtype):
        x, y = x.astype(object), y.astype(object)
    d = x - y
    return (d * d).sum(axis=-1)


def as_long(values) -> list[int | None]:
    """Integers, or null for those that do not fit 64 bits."""
    return [v if v <= MOST else None for v in map(int, values)]


def sums_by(group: np.ndarray, column: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of a column of integers in each of n groups, as Python's integers."""
    if column.dtype == object:
        out = np.zeros(n, object)
        np.add.at(out, group, column)
        return out
    # halves of a batch's values add up exactly as doubles
    low, high = column & 0x7FFFFFFF, column >> 31
    return sum(np.bincount(group, weights=part, minlength=n).astype(np.int64).astype(object) * unit for part, unit in ((low, 1), (high, 1 << 31)))


class Sums:
    """Exact sums of integer columns by group, of one task."""

    def __init__(self, groups: int, width: int):
        self.count, self.total = np.zeros(groups, object), np.zeros((groups, width), object)

    def add(self, group: np.ndarray, columns: list[np.ndarray]) -> None:
        n = len(self.count)
        self.count = self.count + np.bincount(group, minlength=n)
        self.total = self.total + np.stack([sums_by(group, c, n) for c in columns], axis=1)

    def frame(self) -> pd.DataFrame:
        """A row for each group and digit: grp, digit, n, s0, s1, ..."""
        out = []
        for g in np.flatnonzero(self.count):
            rest, digit = [int(v) for v in self.total[g]], 0
            while digit == 0 or any(rest):
                sign = [-1 if v < 0 else 1 for v in rest]
                out.append([int(g), digit, int(self.count[g]) if digit == 0 else 0, *(s * (abs(v) % BASE) for s, v in zip(sign, rest, strict=True))])
                rest = [s * (abs(v) // BASE) for s, v in zip(sign, rest, strict=True)]
                digit += 1
        return pd.DataFrame(out, columns=sum_names(self.total.shape[1])).astype("int64")


def sum_names(dims: int) -> list[str]:
    return ["grp", "digit", "n", *(f"s{k}" for k in range(dims))]


def sum_schema(dims: int) -> str:
    return ", ".join(f"{c} long" for c in sum_names(dims))


def merged(partial: DataFrame, dims: int) -> dict[int, tuple[int, list[int]]]:
    """{group: (rows, sums)} of the tasks' frames, added up by a grouped aggregation; the driver gets a row for each group and digit."""
    names = sum_names(dims)
    out: dict[int, tuple[int, list[int]]] = {}
    for r in partial.groupBy("grp", "digit").agg(*(F.sum(c).alias(c) for c in names[2:])).collect():
        n, sums = out.get(r["grp"], (0, [0] * dims))
        out[r["grp"]] = (n + r["n"], [s + r[f"s{k}"] * BASE ** r["digit"] for k, s in enumerate(sums)])
    return out


def means(rows: list[list[int]], found: dict[int, tuple[int, list[int]]]) -> list[list[int]]:
    """floor(sum / count) of every group that has rows; the others keep their own."""
    return [[s // found[g][0] for s in found[g][1]] if g in found else row for g, row in enumerate(rows)]
