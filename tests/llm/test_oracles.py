"""Registered queries of this subpackage against their SQL."""

import glob
import os

import duckdb
import pytest

from lexiforge.llm import queries


@pytest.mark.parametrize("name", ["op7_warc_revisits", "op10_epsilon_grid_join", "op11_lloyd", "op12_ball_tree_codes"])
def test_same_rows(spark, tmp_path, name):
    """On the small tables, with equal payloads, one of them very common, and near vectors added."""
    sf = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    twice = pages.selectExpr("page_id + 1000 AS page_id", "url", "CASE WHEN page_id % 3 = 0 THEN 'a common page é' WHEN page_id % 7 = 1 THEN NULL ELSE html END AS html")
    pages.unionByName(twice).write.parquet(f"{tmp_path}/pages.parquet")
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    near = vectors.selectExpr("* EXCEPT (vec_id, embedding)", "vec_id + 5000 AS vec_id", "CASE WHEN vec_id % 5 = 0 THEN NULL ELSE transform(embedding, (x, k) -> CAST(x * 2 + IF(k = vec_id % 9, 0.1, 0) AS float)) END AS embedding")
    vectors.unionByName(near).write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    for f in glob.glob(f"{tmp_path}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}/*.parquet'")
    r = c.execute(queries.ORACLE_SQL[name])
    cols = [x[0] for x in r.description]
    want = r.fetchall()
    df = queries.QUERIES[name](spark, str(tmp_path))
    assert sorted(cols) == sorted(df.columns)
    got = [tuple(x) for x in df.select(*cols).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {"op7": lambda: any(x[3] == "revisit" for x in got), "op10": lambda: sum(x[1] > 0 for x in got) > 20}.get(name.split("_")[0], lambda: len(got) > 500)()
