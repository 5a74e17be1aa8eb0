"""Clustering and codes of integer vectors against Python's integers."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiforge.llm import lloyd, part_codes
from lexiforge.llm.integers import Sums, floors, squares, table

SCHEMA = "vec_id long, embedding array<double>, label int, id int, none string, digit int, cluster string"


@pytest.fixture(scope="module")
def vectors(spark):
    """Nulls in every column, equal vectors, repeated ids and rows, other lengths, magnitudes beyond 64 bits, and columns named as inner ones."""
    r = np.random.default_rng(11)
    x = r.normal(size=(300, 16))
    x[40:60] = x[3]
    rows = [(i, v.tolist(), i % 4 if i % 7 else None) for i, v in enumerate(x)]
    rows += [(400, None, 1), (401, [1.0] * 15 + [None], 1), (402, [1.0] * 15 + [math.inf], 1), (403, [math.nan] * 16, 1), (404, [1.0] * 15, 2), (405, [], 2), (406, [0.0] * 16, None)]
    rows += [(7, x[8].tolist(), 3), (7, x[7].tolist(), 3), (None, x[9].tolist(), 1), (None, x[10].tolist(), None), (2**62 + 1, x[11].tolist(), 1), (410, [3e7] + [0.5] * 15, 5), (411, [1e200] * 16, 6), (412, [-1e200] * 8 + [1.0] * 8, 6)]
    return spark.createDataFrame([(*row, 1, "x", None, "c") for row in rows], SCHEMA).repartition(3)


def floor_(v, scale):
    return [math.floor(Fraction(c) * scale) for c in v]


def far(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def least(v, entries):
    return min((far(v, e), k) for k, e in enumerate(entries))


def long_(v):
    return v if v < 1 << 63 else None


def kept(rows, dims):
    return [r for r in rows if r["embedding"] is not None and len(r["embedding"]) == dims and all(c is not None and math.isfinite(c) for c in r["embedding"])]


def same(got, want):
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("k", [5, 400])
def test_lloyd_equals_plain_integers(vectors, k):
    rows = kept(vectors.collect(), 16)
    order = sorted(rows, key=lambda r: (r["vec_id"] is None, hashlib.sha256(f"3:{r['vec_id']}".encode()).hexdigest() if r["vec_id"] is not None else "", r["embedding"]))
    q = [floor_(r["embedding"], 1024) for r in rows]
    centroids = [floor_(r["embedding"], 1024) for r in order[:k]]
    for _ in range(3):
        at = [least(v, centroids)[1] for v in q]
        for c in range(len(centroids)):
            mine = [v for v, a in zip(q, at, strict=True) if a == c]
            if mine:
                centroids[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    best = [least(v, centroids) for v in q]
    of = [sum(d for d, a in best if a == c) for c in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    want = [(r["vec_id"], c, long_(d), long_(of[c]), long_(sum(of)), digest[c]) for r, (d, c) in zip(rows, best, strict=True)]
    out = lloyd.lloyd(vectors, k=k, rounds=3, dims=16)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    same(out.collect(), want)


def test_codes_equal_plain_integers(vectors):
    rows = [r for r in vectors.collect() if r["embedding"] is not None and all(c is not None and math.isfinite(c) for c in r["embedding"])]
    full = kept(rows, 16)
    first = sorted(full, key=lambda r: (r["vec_id"] is None, r["vec_id"] or 0, r["embedding"]))[:64]
    parts = lambda r: [floor_(r["embedding"], 256)[p * 4 : p * 4 + 4] for p in range(4)]
    books = [[parts(r)[p] for r in first] for p in range(4)]
    cut = [parts(r) for r in full]
    for _ in range(2):
        for p in range(4):
            at = [least(v[p], books[p])[1] for v in cut]
            new = []
            for e, old in enumerate(books[p]):
                mine = [v[p] for v, a in zip(cut, at, strict=True) if a == e]
                new.append([sum(col) // len(mine) for col in zip(*mine, strict=True)] if mine else old)
            books[p] = new
    best = [[least(v[p], books[p]) for p in range(4)] for v in cut]
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    coded = [(r["vec_id"], r["label"], "".join(f"{k:02x}" for _, k in b), long_(sum(d for d, _ in b))) for r, b in zip(full, best, strict=True)]
    coded += [(r["vec_id"], r["label"], None, None) for r in rows if len(r["embedding"]) != 16]
    by = {}
    for c in coded:
        by.setdefault(c[1], []).append(c[3])
    total = {k: None if None in v else sum(v) for k, v in by.items()}
    out = part_codes.encode(vectors, parts=4)
    assert out.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    same(out.collect(), [(*c, total[c[1]], digest) for c in coded])


def test_tables_without_vectors(vectors):
    for none in (vectors.limit(0), vectors.where("vec_id = 400")):
        assert lloyd.lloyd(none, dims=16, rounds=1).count() == 0
        assert part_codes.encode(none, rounds=1).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 70), st.integers(1, 5), st.sampled_from([1, 3, 50, 10**6, 1 << 80, 1 << 1100]))
def test_ball_tree_finds_the_first_nearest(seed, n, d, most):
    r = np.random.default_rng(seed)
    unit = min(most, 10**6)
    e, q = r.integers(-unit, unit + 1, (n, d)), r.integers(-unit, unit + 1, (40, d))
    if most > unit:
        e, q = e.astype(object) * (most // unit), q.astype(object) * (most // unit)
    entry, distance = part_codes.nearest(part_codes.Ball(e, np.arange(n)), q, e)
    all_ = squares(q[:, None, :], e[None])
    assert (entry == all_.argmin(axis=1)).all() and (distance == all_.min(axis=1)).all()


def test_ball_tree_leaves_balls_out():
    r = np.random.default_rng(2)
    far_apart = r.integers(-500, 500, (8, 4)) * 100
    e, q = np.repeat(far_apart, 8, axis=0) + r.integers(-500, 500, (64, 4)), np.repeat(far_apart, 25, axis=0) + r.integers(-500, 500, (200, 4))
    seen = []
    visit = part_codes.Found.visit
    part_codes.Found.visit = lambda self, ball, rows: (seen.append(len(ball.at) * len(rows)), visit(self, ball, rows))[1]
    try:
        part_codes.nearest(part_codes.Ball(e, np.arange(64)), q, e)
    finally:
        part_codes.Found.visit = visit
    assert sum(seen) < 0.5 * 64 * 200


def test_sums_are_exact():
    r = np.random.default_rng(5)
    group = r.integers(0, 3, 500)
    for x in (r.integers(-(1 << 62), 1 << 62, 500), r.integers(-9, 9, 500), r.integers(-9, 9, 500).astype(object) * (1 << 200)):
        out = Sums(4, 1)
        for half in (slice(0, 250), slice(250, 500)):
            out.add(group[half], [x[half]])
        f = out.frame()
        assert f["s0"].abs().max() < 1 << 40
        for g in range(4):
            mine = f[f["grp"] == g]
            assert sum(int(s) << (40 * int(k)) for s, k in zip(mine["s0"], mine["digit"], strict=True)) == sum(int(v) for v in x[group == g])
            assert mine["n"].sum() == (group == g).sum()
    assert table([[1 << 60, 0]], 2).dtype == object and [q.dtype for _, q in floors(np.array([[1.5, -0.1], [1e30, 0.0]]), 256)] == [np.int64, object]
