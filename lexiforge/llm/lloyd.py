"""Plain Lloyd clustering of integer vectors.

A vector of `dims` finite components becomes floor(scale * x). The centroids start as the k vectors with the smallest SHA-256 of "<seed>:<vec_id>". In each
round they are broadcast, every task computes integer squared differences to each of them in NumPy and takes the lowest number among the nearest; its
integer sums by centroid are merged by a grouped aggregation, and a centroid that has vectors becomes their floor(sum / count). The rows stay where they
are: no round moves more than a row for each centroid and task, and the driver holds k centroids. All is exact, so any division into tasks gives the same result.

Each round reads vec_id and embedding of the given table again; it should be a stored one.

Edge cases: vectors that are null, of another length or hold null or non-finite components are left out; with fewer than k vectors there are as many
centroids, with none no rows; rows that repeat an id are vectors of their own (of equal hashes the smaller vector comes first); rows without an id take part and start
no centroid before those that have one; equal centroids: the lower number gets all; distances and sums are exact at any magnitude, and null where they exceed a long; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .integers import Sums, as_long, finite, floors, ids_of, means, merged, named, rows_of, squares, sum_schema, table


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each row; ties to the lower number."""
    d = np.stack([squares(x, c) for c in centroids], axis=1)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(x)), best]


def first_centroids(vectors: DataFrame, k: int, dims: int, scale: int, seed: str) -> list[list[int]]:
    fine = vectors.where((F.size("embedding") == dims) & finite())
    hash_ = F.when(~F.col("none"), F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
    rows = fine.select(hash_.alias("hash"), "embedding").orderBy(F.asc_nulls_last("hash"), "embedding").limit(k).collect()
    x = np.array([r["embedding"] for r in rows], np.float64).reshape(len(rows), dims)
    out: list[list[int]] = [[] for _ in rows]
    for at, q in floors(x, scale):
        for i, row in zip(at, q.tolist(), strict=True):
            out[i] = [int(v) for v in row]
    return out


def lloyd(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    plain = named(vectors)
    centroids = first_centroids(plain, k, dims, scale, seed)

    def assigned(batches, now):
        """Of each batch: its rows, and groups of (places, integers, clusters, distances)."""
        for b in batches:
            at, x = rows_of(b["embedding"], dims)
            yield b, [(at[i], q, *nearest(q, now)) for i, q in floors(x, scale)] if len(now) else []

    def sums(shared):
        def task(batches):
            out = Sums(k, dims + 1)
            for _, groups in assigned(batches, table(shared.value, dims)):
                for _, q, cluster, distance in groups:
                    out.add(cluster, [*q.T, distance])
            yield out.frame()

        return merged(plain.mapInPandas(task, sum_schema(dims + 1)), dims + 1)

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(centroids)
        centroids = [c[:dims] for c in means(centroids, sums(shared))]
        shared.destroy()
    shared = spark.sparkContext.broadcast(centroids)
    by_cluster = {g: s[dims] for g, (_, s) in sums(shared).items()}
    inertia, (total,) = dict(zip(by_cluster, as_long(by_cluster.values()), strict=True)), as_long([sum(by_cluster.values())])
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def result(batches):
        for b, groups in assigned(batches, table(shared.value, dims)):
            for at, _, cluster, distance in groups:
                yield pd.DataFrame({
                    "vec_id": ids_of(b, at), "cluster": cluster.astype(np.int32), "distance": pd.array(as_long(distance), "Int64"),
                    "cluster_inertia": pd.array([inertia[c] for c in cluster.tolist()], "Int64"), "inertia": pd.array([total] * len(at), "Int64"), "centroid_sha256": [digest[c] for c in cluster.tolist()],
                })

    return plain.mapInPandas(result, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3") -> str:
    """DuckDB SQL of the same rows from embeddings, for components of ordinary size and ids that are there and differ."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, q AS c FROM (SELECT sha256('{seed}:' || vec_id) AS h, q FROM kept ORDER BY h LIMIT {k}))""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, any_value(q) AS q, min(d * {k} + cluster) % {k} AS cluster, min(d) AS distance
  FROM (SELECT vec_id, q, cluster, list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT AS d FROM kept, c{r}) GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY k)::BIGINT[] AS m
  FROM (SELECT cluster, k, sum(x)::HUGEINT AS s, count(*) AS n FROM (SELECT cluster, unnest(q) AS x, unnest(range({dims})) AS k FROM a{r}) GROUP BY cluster, k) GROUP BY cluster)""")
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.m, c.c) AS c FROM c{r} c LEFT JOIN m{r} m ON m.cluster = c.cluster)""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, a.cluster::INT AS cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.cluster"""
