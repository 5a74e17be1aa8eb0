"""Extra columns named as inner ones, null ids, repeated rows and empty tables: rows are those of the plain tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiforge.llm import lloyd, part_codes, suffix_dedup, warc
from lexiforge.llm.epsilon_join import near_duplicates
from lexiforge.llm.hnsw import build_index, search
from lexiforge.llm.packing import pack
from lexiforge.llm.token_tables import encode_to_tables
from lexiforge.llm.tokens import public_tokenizer

EXTRA = ["oid", "tkey", "start", "n", "ids", "range", "kind", "run", "part", "shard", "slice", "copies", "digest", "origin", "payload", "rep", "dim", "id", "none", "code", "error", "cluster", "distance", "length", "offset", "text_", "a.b", "c`d"]


def widened(table):
    return table.select("*", *(F.lit(f"x{k}").alias(c) for k, c in enumerate(EXTRA) if c not in table.columns))


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


DOC_OPERATORS = {
    "op4": lambda docs: pack(docs, public_tokenizer("byte_bpe_50k.json"), end_id=1, length=64, with_ids=False).drop("sequence_id", "offset"),
    "op6": suffix_dedup.digests,
    "op9": lambda docs: encode_to_tables(docs, public_tokenizer("word_bpe_49k.json"), end_id=2).drop("path"),
}


@pytest.mark.parametrize("name", list(DOC_OPERATORS))
def test_documents(docs, name):
    run = DOC_OPERATORS[name]
    plain = docs.where("doc_id IS NULL OR doc_id <> 10").coalesce(1)
    assert rows(run(widened(plain))) == rows(run(plain)) != []


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(9)
    x = r.normal(size=(90, 16))
    x[5:9] = x[4]
    data = [(i if i % 30 else None, v.tolist(), i % 3) for i, v in enumerate(x)] + [(7, x[7].tolist(), 1)] * 2 + [(200, None, 1), (201, [0.0] * 16, None)]
    return spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").coalesce(1)


VECTOR_OPERATORS = {
    "op2": lambda v: search(build_index(v), v.where("vec_id % 9 = 0"), k=3), "op10": near_duplicates, "op11": lambda v: lloyd.lloyd(v, k=3, rounds=1, dims=16), "op12": lambda v: part_codes.encode(v, parts=4, entries=5, rounds=1),
}


@pytest.mark.parametrize("name", list(VECTOR_OPERATORS))
def test_vectors(vectors, name):
    run = VECTOR_OPERATORS[name]
    assert rows(run(widened(vectors))) == rows(run(vectors)) != []


def test_pages_and_small_archives(spark, tmp_path):
    """Archives of a few records each, extra columns, copies and null pages."""
    data = [(k, f"http://h/{k}", None if k % 7 == 3 else f"<p>page {k % 5}</p>" * 50) for k in range(40)] + [(None, None, "<p>only</p>")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").coalesce(2)
    want = rows(warc.deduplicated_archives(pages))
    (tmp_path / "small").mkdir()
    manifest = warc.write_archives(widened(pages), f"file://{tmp_path}/small", archive_bytes=900)
    assert manifest.count() > 5 and manifest.agg(F.sum("n_records")).first()[0] == 41 and len(list((tmp_path / "small").glob("*.gz"))) == manifest.count()
    assert rows(warc.read_archives(spark, manifest)) == want
