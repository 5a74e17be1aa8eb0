"""Fitting the weights of the letter model: conditional likelihood by L-BFGS, sums over words by Spark.

Words with their labels are counted once, and their features are joined with the feature numbers once; the table of both is kept (and made again by Spark where an executor
is lost). In each step the weights are broadcast; tasks run forward and backward over blocks of words of one length and give sparse parts of the
gradient, which a grouped aggregation adds up. The driver holds vectors of one number per weight: at most MOST_WEIGHTS, else an error that asks for a
higher min_count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import SUFFIX, WEIGHTS, Factory, all_features

MOST_WEIGHTS = 20_000_000
PAIR = SUFFIX + "CpC"


def labelled_words(rows: DataFrame) -> DataFrame:
    """word, labels (array), n (how often) of letter rows (word_id, pos, letter, label)."""
    words = rows.groupBy("word_id").agg(F.array_sort(F.collect_list(F.struct("pos", "letter", "label"))).alias("l"))
    return words.groupBy(F.array_join(F.col("l.letter"), "").alias("word"), F.col("l.label").alias("labels")).agg(F.count("*").alias("n"))


class Data:
    """Numbered features and labels, and the table that the objective goes over."""

    def __init__(self, words: DataFrame, lexicon: DataFrame | None, features: Factory, min_count: int):
        spark = words.sparkSession
        self.labels = [r[0] for r in words.select(F.explode("labels").alias("l")).distinct().orderBy("l").collect()]
        m = len(self.labels)
        spelled = words.groupBy("word").agg(F.sum("n").alias("times"))
        named = features(spelled.select(F.col("word").alias("word_id"), "word"), lexicon)
        seen = named.join(spelled, F.col("word_id") == F.col("word")).groupBy("feature").agg(F.sum("times").alias("times")).where(F.col("times") >= min_count).select("feature")
        wide = F.when(F.col("feature").endswith(PAIR), m * m).otherwise(m)
        total = seen.agg(F.sum(wide)).first()[0] or 0
        if total > MOST_WEIGHTS:
            raise ValueError(f"{total} weights: more than {MOST_WEIGHTS}; a min_count above {min_count} leaves fewer features")
        self.features = sorted(r[0] for r in seen.collect())
        pair = np.array([f.endswith(PAIR) for f in self.features], bool)
        sizes = np.where(pair, m * m, m)
        self.first = (np.cumsum(sizes) - sizes).astype(np.int64)
        self.size = int(sizes.sum())
        numbers = spark.createDataFrame(pa.table({"feature": pa.array(self.features, pa.string()), "first": self.first, "pair": pair}))
        at = named.join(numbers, "feature").groupBy(F.col("word_id").alias("_word")).agg(F.collect_list(F.struct("pos", "first", "pair")).alias("places"))
        label = F.create_map(*(x for k, name in enumerate(self.labels) for x in (F.lit(name), F.lit(k)))) if m else None
        table = words.select("word", F.transform("labels", lambda x: label[x]).alias("path") if m else F.array().cast("array<int>").alias("path"), "n").join(at, F.col("word") == F.col("_word"), "left")
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.table = table.select("path", F.col("n").cast("double").alias("n"), F.col("places.pos").alias("pos"), F.col("places.first").alias("first"), F.col("places.pair").alias("pair")).repartition(tasks).persist()

    def objective(self, weights: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
        """(negative penalised log likelihood, its gradient)."""
        shared = self.table.sparkSession.sparkContext.broadcast(weights)
        m = len(self.labels)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grad, loss = np.zeros(len(shared.value)), 0.0
            for b in batches:
                loss += add_batch(b, shared.value, m, grad)
            some = np.flatnonzero(grad)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], some])), pa.array(np.concatenate([[loss], grad[some]]))], ["k", "g"])

        sums = self.table.mapInArrow(task, "k long, g double").groupBy("k").agg(F.sum("g").alias("g")).toArrow()
        shared.destroy()
        k, g = sums["k"].to_numpy(), sums["g"].to_numpy()
        grad = l2 * weights
        grad[k[k >= 0]] += g[k >= 0]
        return float(g[k < 0].sum() + 0.5 * l2 * weights @ weights), grad


def add_batch(b: pa.RecordBatch, weights: np.ndarray, m: int, grad: np.ndarray) -> float:
    """Adds a batch's part of the gradient of the negative log likelihood, and returns its part of that."""
    paths, times = b.column("path"), b.column("n").to_numpy()
    sizes = np.diff(paths.offsets.to_numpy())
    flat, first = paths.flatten().to_numpy(), np.cumsum(sizes) - sizes
    lists = b.column("pos").fill_null(pa.scalar([], b.schema.field("pos").type))
    counts = np.diff(lists.offsets.to_numpy())
    word, pos = np.repeat(np.arange(b.num_rows), counts), lists.flatten().to_numpy()
    at, pair = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("first", "pair"))
    loss = 0.0
    for n in np.unique(sizes[sizes > 0]).tolist():
        places = np.flatnonzero(sizes == n)
        most = max(1, 2_000_000 // (n * m * m))
        for lo in range(0, len(places), most):
            rows = places[lo : lo + most]
            number = np.full(b.num_rows, -1)
            number[rows] = np.arange(len(rows))
            mine = number[word] >= 0
            one, two = np.flatnonzero(mine & ~pair), np.flatnonzero(mine & pair & (pos > 0))
            own, step = np.zeros((len(rows), n, m)), np.zeros((len(rows), n, m, m))
            k1, k2 = at[one][:, None] + np.arange(m), at[two][:, None] + np.arange(m * m)
            np.add.at(own, (number[word[one]], pos[one]), weights[k1])
            np.add.at(step, (number[word[two]], pos[two]), weights[k2].reshape(-1, m, m))
            path = flat[first[rows][:, None] + np.arange(n)]
            part, p_own, p_step = expectations(own, step, path)
            loss += float(part @ times[rows])
            weight = times[rows]
            np.add.at(grad, k1, p_own[number[word[one]], pos[one]] * weight[number[word[one]]][:, None])
            np.add.at(grad, k2, p_step[number[word[two]], pos[two]].reshape(-1, m * m) * weight[number[word[two]]][:, None])
    return loss


def expectations(own: np.ndarray, step: np.ndarray, path: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(negative log likelihood, probabilities of labels less those of path, of label pairs likewise) of words of one length, forward and backward in logarithms."""
    rows, n, m = own.shape

    def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)

    ahead, behind = [own[:, 0]], [np.zeros((rows, m))]
    for k in range(1, n):
        ahead.append(log_sum(ahead[-1][:, :, None] + step[:, k], 1) + own[:, k])
        q = n - k
        behind.append(log_sum(step[:, q] + (own[:, q] + behind[-1])[:, None, :], 2))
    behind.reverse()
    total = log_sum(ahead[-1], 1)
    every, places = np.arange(rows)[:, None], np.arange(n)[None, :]
    p_own = np.exp(np.stack(ahead, axis=1) + np.stack(behind, axis=1) - total[:, None, None])
    p_step = np.zeros_like(step)
    for k in range(1, n):
        p_step[:, k] = np.exp(ahead[k - 1][:, :, None] + step[:, k] + (own[:, k] + behind[k])[:, None, :] - total[:, None, None])
    score = own[every, places, path].sum(axis=1)
    p_own[every, places, path] -= 1
    if n > 1:
        score += step[every, places[:, 1:], path[:, :-1], path[:, 1:]].sum(axis=1)
        p_step[every, places[:, 1:], path[:, :-1], path[:, 1:]] -= 1
    return total - score, p_own, p_step


def l_bfgs(objective: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int, memory: int = 6, tolerance: float = 1e-4) -> tuple[np.ndarray, list[float]]:
    """(minimum, values on the way) of a smooth convex objective: two-loop recursion, steps halved until the value falls enough."""
    value, grad = objective(x)
    values, pairs = [value], []
    for _ in range(rounds):
        way = grad.copy()
        used = []
        for s, y in reversed(pairs):
            a = (s @ way) / (y @ s)
            used.append(a)
            way -= a * y
        if pairs:
            s, y = pairs[-1]
            way *= (s @ y) / (y @ y)
        else:
            way /= max(1.0, float(np.abs(grad).sum()))
        for (s, y), a in zip(pairs, reversed(used), strict=True):
            way += (a - (y @ way) / (y @ s)) * s
        slope, size = float(grad @ way), 1.0
        if slope <= 0:
            break
        for _ in range(20):
            new_value, new_grad = objective(x - size * way)
            if new_value <= value - 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, y = -size * way, new_grad - grad
        if s @ y > 1e-12 * (y @ y):
            pairs = [*pairs[1 - memory :], (s, y)]
        x, gain, value, grad = x + s, value - new_value, new_value, new_grad
        values.append(value)
        if gain <= tolerance * abs(value):
            break
    return x, values


def fit(rows: DataFrame, lexicon: DataFrame | None = None, features: Factory = all_features, rounds: int = 50, l2: float = 0.1, min_count: int = 1) -> tuple[DataFrame, list[str], list[float]]:
    """(weights, labels, objective's values) of a linear-chain model from letter rows (word_id, pos, letter, label).

    features: a factory as in features.decode(); those whose name ends in |CpC weigh label pairs, all others labels. Features of fewer than min_count words get no weight.
    """
    spark = rows.sparkSession
    data = Data(labelled_words(rows), lexicon, features, min_count)
    try:
        x, values = l_bfgs(lambda w: data.objective(w, l2), np.zeros(data.size), rounds)
    finally:
        data.table.unpersist()
    m, labels = len(data.labels), pa.array(data.labels, pa.string())
    sizes = np.diff(np.append(data.first, data.size))
    feature, at = np.repeat(np.arange(len(sizes)), sizes), np.arange(data.size) - np.repeat(data.first, sizes)
    pair = sizes[feature] > m if m > 1 else np.array([data.features[k].endswith(PAIR) for k in feature], bool)
    some = np.flatnonzero(x)
    before = pa.array((at[some] // max(m, 1)).astype(np.int64), mask=~pair[some])
    table = pa.table({"feature": pa.array(data.features, pa.string()).take(pa.array(feature[some])), "label_prev": labels.take(before), "label": labels.take(pa.array(at[some] % max(m, 1))), "weight": pa.array(x[some], pa.float64())})
    weights = spark.createDataFrame(table) if table.num_rows else spark.createDataFrame([], WEIGHTS)
    return weights, data.labels, values
