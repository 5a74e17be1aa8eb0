"""Fitting of the letter model."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiforge import cli
from lexiforge.operators import features, fitting, letters
from lexiforge.plans import queries

ROOTS, SUFFIXES, ENDINGS = ["дом", "стол", "рук", "вод", "лес", "кот", "мост", "сад", "нос", "зуб"], ["ик", "н", "ок", "оват", "ск"], ["а", "ы", "ами", "ого", "ый", "ом"]


def words(n, seed):
    """word_id, value of random words of a root, up to two suffixes and an ending."""
    r = random.Random(seed)
    out = []
    for k in range(n):
        parts = [("корень", r.choice(ROOTS)), *(("суфф", r.choice(SUFFIXES)) for _ in range(r.randint(0, 2))), ("оконч", r.choice(ENDINGS))]
        out.append((k, " ".join(f"{t}_{p}" for t, p in parts)))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    return letters.letters(spark.createDataFrame(words(250, 1), "word_id long, value string")).persist()


def test_gradient_equals_finite_differences(spark):
    rows = letters.letters(spark.createDataFrame([(1, "корень_аб суфф_б"), (2, "корень_а"), (3, "суфф_ба"), (4, "корень_а")], "word_id long, value string"))
    data = fitting.Data(fitting.labelled_words(rows), None, features.all_features, 1)
    x = np.random.default_rng(1).normal(size=data.size)
    value, grad = data.objective(x, 0.3)
    for k in np.random.default_rng(2).choice(data.size, 6, replace=False).tolist():
        e = np.zeros(data.size)
        e[k] = 1e-5
        assert grad[k] == pytest.approx((data.objective(x + e, 0.3)[0] - data.objective(x - e, 0.3)[0]) / 2e-5, abs=1e-4)
    data.table.unpersist()


def test_likelihood_equals_the_sum_over_all_paths():
    r = np.random.default_rng(3)
    for n, m in ((1, 3), (4, 3), (3, 1)):
        own, step, path = r.normal(size=(2, n, m)), r.normal(size=(2, n, m, m)), r.integers(0, m, (2, n))
        loss, p_own, p_step = fitting.expectations(own, step, path)
        for i in range(2):
            score = lambda p: sum(own[i, k, p[k]] for k in range(n)) + sum(step[i, k, p[k - 1], p[k]] for k in range(1, n))  # noqa: B023, E731
            all_ = list(itertools.product(range(m), repeat=n))
            z = sum(np.exp(score(p)) for p in all_)
            assert loss[i] == pytest.approx(np.log(z) - score(path[i]))
            for k, y in itertools.product(range(n), range(m)):
                assert p_own[i, k, y] + (path[i, k] == y) == pytest.approx(sum(np.exp(score(p)) for p in all_ if p[k] == y) / z)
            for k, u, y in itertools.product(range(1, n), range(m), range(m)):
                assert p_step[i, k, u, y] + (path[i, k - 1] == u and path[i, k] == y) == pytest.approx(sum(np.exp(score(p)) for p in all_ if (p[k - 1], p[k]) == (u, y)) / z)


def test_l_bfgs_finds_a_minimum():
    a = np.diag([1.0, 50.0, 3.0]) + 0.3
    b = np.array([1.0, -2.0, 5.0])
    x, values = fitting.l_bfgs(lambda x: (0.5 * x @ a @ x - b @ x, a @ x - b), np.zeros(3), 60, tolerance=1e-14)
    assert np.allclose(x, np.linalg.solve(a, b), atol=1e-4) and values == sorted(values, reverse=True)


def test_a_fitted_model_beats_single_letters(spark, rows):
    weights, labels, values = fitting.fit(rows, rounds=12, l2=0.05)
    assert len(values) > 5 and values == sorted(values, reverse=True) and values[-1] < 0.2 * values[0]
    held_out = letters.letters(spark.createDataFrame(words(120, 2), "word_id long, value string"))
    seen = rows.groupBy("letter", "label").count()
    best = {r["letter"]: r["label"] for r in seen.groupBy("letter").agg(F.max_by("label", "count").alias("label")).collect()}
    want = {(tuple(r["word"]), tuple(r["labels"])) for r in fitting.labelled_words(held_out).select(F.split("word", "").alias("word"), "labels").collect()}
    table = spark.createDataFrame([("".join(w),) for w, _ in want], "word string")
    got = {"".join(x["letter"] for x in r["labelled"]): [x["label"] for x in r["labelled"]] for r in features.decode(table, weights, labels).collect()}
    right = sum(a == b for w, path in want for a, b in zip(path, got["".join(w)], strict=True))
    single = sum(best.get(c) == b for w, path in want for c, b in zip(w, path, strict=True))
    total = sum(len(path) for _, path in want)
    assert right / total > 0.93 and right > single + 0.1 * total


def test_a_bound_asks_for_a_higher_count(spark, rows, monkeypatch):
    monkeypatch.setattr(fitting, "MOST_WEIGHTS", 50)
    with pytest.raises(ValueError, match="min_count above 1"):
        fitting.fit(rows)
    weights, labels, values = fitting.fit(rows.limit(0))
    assert (weights.count(), labels, values[0]) == (0, [], 0.0)


def test_letters_of_files_to_a_model_that_segments(spark, tmp_path):
    (tmp_path / "seg").write_text("\n".join(v for _, v in words(60, 5)) + "\n")
    assert cli.main(["letters", str(tmp_path / "seg"), "--beside"], spark) == 0
    again = letters.letters_from_text(spark.read.format("text").option("wholetext", True).load(str(tmp_path / "seg.conll")).select(F.lit("d").alias("doc"), "value"))
    direct = letters.letters(spark.createDataFrame(words(60, 5), "word_id long, value string"))
    assert sorted(map(tuple, fitting.labelled_words(again).collect())) == sorted(map(tuple, fitting.labelled_words(direct).collect()))
    (tmp_path / "suffixes").write_text("ик\nок\n")
    assert cli.main(["fit", str(tmp_path / "seg.conll"), "--model", str(tmp_path / "model"), "--rounds", "6", "--lexicon", f"суфф={tmp_path / 'suffixes'}"], spark) == 0
    (tmp_path / "a.conll").write_text("1\tдомика\tl\tN\tN\tf\t0\tr\tp\tq\n")
    assert cli.main(["segment", str(tmp_path / "a.conll"), "--model", str(tmp_path / "model"), "--beside"], spark) == 0
    assert "\t_\tдом\tик\tа\t" in (tmp_path / "a.segmented.conll").read_text()


def test_a_model_of_the_documents_words(spark):
    """The registered query: all words that the ending rules segment, most of their letters labelled alike."""
    sf = "/root/testdata/sf0.001"
    got = queries.QUERIES["fit_model"](spark, sf).collect()
    want = queries.QUERIES["labelled_words"](spark, sf).count()
    pairs = [(a, b) for r in got for a, b in zip(r["labels"].split(), r["found"].split(), strict=True)]
    assert len(got) == want > 100 and sum(a == b for a, b in pairs) / len(pairs) > 0.9
