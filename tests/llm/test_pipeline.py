"""The stages of the pipeline, each on what its predecessor kept, against plain versions of them."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_texts import slow_chunks, slow_runs
from test_tokens import ids

import corpus_pipeline
from lexiforge.llm import chunk_dedup, forest_join, language, mixing


@pytest.fixture(scope="module")
def stages(spark, docs, tmp_path_factory):
    """{name: (documents read, rows written)}; doc 12 is left out, as it names two texts."""
    more = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id + 100 AS doc_id", "text", "lang", "source", "CAST(n_chars AS long) AS n_chars")
    before, out = docs.where("doc_id IS NULL OR doc_id != 12").unionByName(more), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, before, "").write.parquet(path)
        after = spark.read.parquet(path)
        if name != "pack":
            assert after.columns == docs.columns
        out[name] = (before, after)
        before = after
    return out


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def softmax(x):
    e = np.exp(np.array(x) - max(x))
    return e / e.sum()


def test_language_drops_what_is_undetermined(stages):
    before, after = stages["language"]
    names, table = language.fit_on(before)
    n, rows, scores = len(names), before.collect(), []
    for r in rows:
        data, s = (r["text"] or "").encode(), np.zeros(n)
        for code in language.trigrams(data) if data else ():
            for c in code:
                s += table[c]
        scores.append(s)
    share = [softmax(language.TEMPER * s) for s in scores]
    everywhere = (sum(share) + 1) / (len(rows) + n)
    parent = (sum(share) + language.SUFFIX_WEIGHT * everywhere) / (len(rows) + language.SUFFIX_WEIGHT)
    want = Counter()
    for r, s, own in zip(rows, scores, share, strict=True):
        host = [x for q, x in zip(rows, share, strict=True) if (q["source"] or "") == (r["source"] or "")]
        prior = (np.maximum(sum(host) - own, 0) + language.HOST_WEIGHT * parent) / (len(host) - 1 + language.HOST_WEIGHT)
        said = np.zeros(n)
        if r["lang"] in names[:-1]:
            said[:] = np.log((1 - language.DECLARED_RIGHT) / max(1, n - 2))
            said[names.index(r["lang"])], said[-1] = np.log(language.DECLARED_RIGHT), np.log(1 / (n - 1))
        post = softmax(language.TEMPER * s + said + np.log(prior))
        if any(len(c) for c in language.trigrams((r["text"] or "").encode())) and post.argmax() < n - 1 and post.max() >= language.LEAST_POSTERIOR:
            want[tuple(r)] += 1
    assert rows_of(after) == want and 0 < sum(want.values()) < len(rows)


def test_one_document_of_each_group_stays(stages):
    before, after = stages["near_dups"]
    rows = before.withColumn("tkey", F.xxhash64("text")).collect()

    def shingles(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    rows = sorted(rows, key=lambda r: (forest_join.NO_ID if r["doc_id"] is None else r["doc_id"], r["tkey"]))
    sets, group = [shingles(r["text"]) for r in rows], list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                group[b] = a
    want = Counter(tuple(r)[:-1] for i, r in enumerate(rows) if top(i) == i and (sets[i] or i == 0 or tuple(r) != tuple(rows[i - 1])))
    assert rows_of(after) == want and sum(want.values()) < len(rows)


def test_repeated_passages_go(stages):
    before, after = stages["substrings"]
    rows = {r["doc_id"]: (r["text"] or "").encode() for r in before.collect()}
    assert len(rows) == before.count()
    none = 1 << 62  # a null id counts as the largest
    first, found, texts = {}, {}, {none if k is None else k: t for k, t in rows.items()}
    for doc in sorted(texts):
        found[doc] = slow_chunks(texts[doc]) if texts[doc] else []
        for a, c, *_ in found[doc]:
            first.setdefault(c, (doc, a))
    cut = 0
    after = after.collect()
    assert Counter(r["doc_id"] for r in after) == Counter(list(rows))
    for r in after:
        doc = none if r["doc_id"] is None else r["doc_id"]
        kept, spans = chunk_dedup.remove(texts[doc], slow_runs((doc, texts[doc]), found[doc], first, texts), chunk_dedup.MIN_RUN)
        assert (r["text"] or "").encode() == kept and r["n_chars"] == (len(r["text"]) if r["text"] is not None else None), doc
        cut += len(spans)
    assert cut


def test_mix_takes_what_sql_takes(stages):
    before, after = stages["mix"]
    c = duckdb.connect()
    documents = before.toPandas()  # noqa: F841
    c.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text, source FROM documents")
    want = Counter()
    for doc, size, _, _, taken in c.execute(mixing.SQL).fetchall():
        if taken:
            want[doc] += taken // size
    assert Counter(r["doc_id"] for r in after.collect()) == want
    assert set(rows_of(after)) <= set(rows_of(before))


def test_sequences_hold_every_token_once(stages):
    before, after = stages["pack"]
    want = Counter(zlib.crc32(np.array(ids(r["text"], False, 1), "<u4").tobytes()) for r in before.collect())
    got, open_, filled = Counter(), b"", Counter()
    for r in sorted(after.collect(), key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled[r["sequence_id"]] and r["start"] == len(open_) // 4
        filled[r["sequence_id"]] += r["length"]
        open_ += r["ids"]
        if r["start"] + r["length"] == r["doc_tokens"]:
            got[zlib.crc32(open_)] += 1
            open_ = b""
    assert got == want and not open_
    assert all(n == 2048 for s, n in filled.items() if s != max(filled))


def test_run_is_the_stages_in_order(spark, stages, tmp_path):
    assert list(stages) == ["language", "near_dups", "substrings", "mix", "pack"] and corpus_pipeline.ORACLE_SQL is None
    stages["language"][0].write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert rows_of(got.select(*key)) == rows_of(stages["pack"][1].select(*key))


def test_no_documents_give_no_sequences(spark, no_docs, tmp_path):
    no_docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_stage_leaves_its_output_alone(spark):
    """After a run the shared folder holds the last output that is read, and what the last stage reads."""
    import os

    import corpus_pipeline
    from lexiforge.llm import common

    folder = common.shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    there = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before}
    assert "stage-mix" in there and not there & {"stage-language", "stage-near_dups", "stage-substrings", "chunks", "scores", "mix", "answers"}
    assert out.count() > 0
