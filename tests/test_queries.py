"""Every registered query of the engine against its SQL."""

import glob
import os

import duckdb
import pytest

from lexiforge.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    r = duck.execute(queries.ORACLE_SQL[name])
    cols = [x[0] for x in r.description]
    assert sorted(cols) == sorted(df.columns)
    key = lambda row: tuple((x is None, str(x)) for x in row)
    assert sorted(map(tuple, df.select(*cols).collect()), key=key) == sorted(r.fetchall(), key=key)


def test_queries_without_sql_are_few():
    assert set(queries.QUERIES) - set(queries.ORACLE_SQL) == {"fit_model"}


@pytest.mark.parametrize("name", ["ctx_features", "lexicon_features"])
def test_features_cover_words_after_the_first(spark, tmp_path, name):
    spark.createDataFrame([(1, "one two, Two"), (2, "one"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["word_id"], r["pos"]) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
    assert got == {(w, k) for w in ("one", "two", "Two") for k in range(3)}
