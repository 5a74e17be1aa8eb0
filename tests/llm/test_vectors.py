import math

import numpy as np
import pytest

from lexiforge.llm.epsilon_join import grouped, interval_pairs, intervals_of, near_duplicates
from lexiforge.llm.hnsw import build_index, search, shards_of

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(700, 16)).astype(np.float32)
    x[300:340] = x[10] + r.normal(size=(40, 16)) * 0.08
    x[400:430] = x[20]
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    rows += [(1000, None, None), (1001, [0.0] * 16, 1), (1100, [float("nan")] + [1.0] * 15, 1), (1101, [1.0, None], 1), (1102, [1.0, 2.0], 1), (1103, [2.0, 4.0], 1), (None, x[5].tolist(), 1), (1200, [], 1), (7, (x[7] * 3).tolist(), 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def clean(rows):
    out = []
    for r in rows:
        v = r["embedding"]
        if r["vec_id"] is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v):
            out.append((r["vec_id"], np.array(v, np.float64)))
    return out


@pytest.mark.parametrize("sizes", [{}, {"block": 16, "slice_rows": 30, "tasks": 2}])
def test_neighbours_recall(vectors, sizes):
    """Shards and queries, in one piece and in many: several shards a task, several slices."""
    all_ = clean(vectors.collect())
    got = {}
    for r in search(build_index(vectors, shard_rows=200), vectors.where("vec_id % 10 = 0"), k=10, **sizes).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q, v in all_:
        if q % 10 == 0:
            best = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in all_ if i != q and len(w) == len(v))[:10]
            found = sorted(got[q])
            assert [f[0] for f in found] == list(range(1, len(found) + 1)) and [(f[2], f[1]) for f in found] == sorted((f[2], f[1]) for f in found)
            hits += len({i for _, i in best} & {f[1] for f in found})
            total += len(best)
    assert hits / total >= 0.95
    assert search(build_index(vectors.limit(0)), vectors, k=3).count() == 0


def test_rows_that_repeat_the_query_hide_no_neighbour(spark):
    rows = [(1, [1.0, 0.0])] * 15 + [(2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0])]
    table = spark.createDataFrame(rows, spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").schema)
    got = {r["vec_id"] for r in search(build_index(table), table.where("vec_id = 1").limit(1), k=2).collect()}
    assert got == {2, 3}


def test_equal_rows_are_as_many_candidates(spark):
    rows = [(1, [1.0, 0.0]), *[(2, [1.0, 0.0])] * 4, *[(2, [0.0, 1.0])] * 2, (3, [1.0, 0.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS shard", "'x' AS copies", "2 AS ids", "3 AS slice")
    got = [(r["rank"], r["vec_id"], r["score"]) for r in search(build_index(table), table.where("vec_id = 1"), k=6).orderBy("rank").collect()]
    assert [g[:2] for g in got] == [(1, 2), (2, 2), (3, 2), (4, 2), (5, 3), (6, 2)] and got[3][2] == 0.0 and got[4][2] == 0.5


def test_shards_stay_bounded_in_number_and_size():
    assert [shards_of(n) for n in (0, 8192, 8193, 10**7, 10**8, 10**9)] == [1, 1, 2, 1024, 1024, 7630]


@pytest.mark.parametrize("sizes", [{}, {"interval_rows": 40, "block_rows": 16}])
def test_join_equals_brute_force(vectors, sizes):
    rows = vectors.collect()
    all_ = clean(rows)
    n = len(all_)
    links = [set() for _ in range(n)]
    for a in range(n):
        for b in range(a + 1, n):
            x, y = all_[a][1], all_[b][1]
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.9:
                links[a].add(b)
                links[b].add(a)
    want, seen = [], {}
    for a in range(n):
        if a not in seen:
            todo, comp = [a], {a}
            while todo:
                for b in links[todo.pop()] - comp:
                    comp.add(b)
                    todo.append(b)
            least = min(all_[k][0] for k in comp)
            seen.update(dict.fromkeys(comp, least))
        want.append((all_[a][0], len(links[a]), seen[a], all_[a][0] == seen[a]))
    used = {id(v) for _, v in all_}
    assert len(used) == n
    out = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_duplicates(vectors, **sizes).collect()]
    assert len(out) == len(rows)
    lone = [o for o in out if o[1] == 0 and o[0] in (None, 1000, 1001, 1100, 1101, 1200)]
    assert sorted(lone, key=str) == sorted([(None, 0, None, False), *((i, 0, i, True) for i in (1000, 1001, 1100, 1101, 1200))], key=str)
    for o in lone:
        out.remove(o)
    assert sorted(out) == sorted(want)
    assert near_duplicates(vectors.limit(0)).count() == 0


def test_intervals_skip_distant_pairs_only():
    r = np.random.default_rng(1)
    boxes = []
    for _ in range(23):
        low = r.random(3) * 5
        boxes.append((int(r.integers(2, 4)), low, low + r.random(3)))
    want = {(i, j) for i in range(23) for j in range(i, 23) if boxes[i][0] == boxes[j][0] and (np.maximum(0, np.maximum(boxes[i][1] - boxes[j][2], boxes[j][1] - boxes[i][2])) ** 2).sum() <= 0.25}
    got = interval_pairs(boxes, 0.5)
    assert sorted(got) == sorted(want)
    assert sorted(interval_pairs(boxes, 0.5, [(0, 9, 9, 23)])) == sorted((i, j) for i, j in want if i < 9 <= j)


def test_small_parts_make_one_interval():
    parts = [(2, k, [float(k)], [k + 0.5], 10) for k in range(7)] + [(3, 6, [0.0], [1.0], 4), (3, 7, [2.0], [3.0], 50)]
    got = [(d, low.tolist(), high.tolist(), p) for d, low, high, p in grouped(parts, 30)]
    assert got == [(2, [0.0], [2.5], [0, 1, 2]), (2, [3.0], [5.5], [3, 4, 5]), (2, [6.0], [6.5], [6]), (3, [0.0], [1.0], [6]), (3, [2.0], [3.0], [7])]


def test_intervals_stay_bounded_in_number_and_size():
    assert [intervals_of(n) for n in (0, 1, 4096, 4097, 524_288, 10**7, 128 * 10**6, 10**9)] == [1, 1, 1, 2, 128, 128, 128, 1000]
    # each vector is read once for each interval: the number does not grow with the table until intervals are full
    assert max(intervals_of(10**k) for k in range(9)) == 128
