import base64
import hashlib
import random

import duckdb
import pytest

from lexiforge.llm import mixing
from lexiforge.llm.warc import deduplicated_archives


def test_archives(spark):
    rows = [(1, "u1", "<p>é</p>"), (2, "u\n2", "<p>é</p>"), (3, None, "other"), (4, "u4", None), (5, "u5", ""), (None, "u6", "<p>é</p>"), (None, "n", "alone"), (7, "u7", "x" * 200_000), (2, "u\n2", "<p>é</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or 0) for r in deduplicated_archives(df).collect())
    origin = {}
    for p, _, h in rows:
        origin[h or ""] = max(origin.get(h or "", 0), p or 0)
    copies = [h or "" for _, _, h in rows]
    want = []
    for p, _, h in rows:
        data = (h or "").encode()
        again = copies.count(h or "") > 1 and (p or 0) != origin[h or ""]
        want.append((p or 0, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", origin[h or ""] if again else 0))
    assert got == sorted(want)
    assert deduplicated_archives(df.limit(0)).count() == 0
    assert deduplicated_archives(df, min_bytes=10).where("record_type = 'revisit'").count() == 0


def test_mix_equals_sql(spark, docs, odd_docs):
    c = duckdb.connect()
    rows = docs.toPandas()  # noqa: F841
    c.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text, lang, source, n_chars FROM rows")
    want = sorted(map(str, c.execute(mixing.SQL).fetchall()))
    got = sorted(str(tuple(r)) for r in mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken").collect())
    assert [w.replace("nan", "None") for w in want] == got
    assert mixing.apply_mix(odd_docs).columns == odd_docs.columns
    taken = mixing.mix(docs).agg({"taken": "sum"}).first()[0]
    size = {(r["doc_id"], r["text"]): len((r["text"] or "").split()) for r in docs.collect()}
    assert sum(size[r["doc_id"], r["text"]] for r in mixing.apply_mix(docs).collect()) == taken


def test_overlapping_sources_and_rows_that_differ_elsewhere(spark):
    sources = [["a"], ["b"], ["a", "b"], ["b", "c"], [], None, ["a", "a"]]
    rows = [(k, f"w{k} " * (k % 7), sources[k % 7], "x", k) for k in range(300)] + [(500, "two words", ["a"], o, 1) for o in ("x", "y", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source array<string>, other string, size long").repartition(3)
    taken = {}
    for r in mixing.mix(docs).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
    runs = [sorted((r["doc_id"], r["other"]) for r in mixing.apply_mix(docs.repartition(n)).collect()) for n in (1, 4)]
    assert runs[0] == runs[1] and len(runs[0]) > 200
    for k, text, *_ in rows:
        n = len(text.split())
        assert sum(i == k for i, _ in runs[0]) == (taken[k] // n if n else 0)
    got = [o for i, o in runs[0] if i == 500]
    assert not got or abs(2 * got.count("x") - got.count("y")) <= 2


def test_mix_of_nothing(no_docs):
    assert mixing.mix(no_docs).count() == 0 and mixing.apply_mix(no_docs).count() == 0


def test_flow_of_overlapping_sources_is_optimal():
    r = random.Random(5)
    for _ in range(60):
        words = {p: r.randint(1, 6) for p in [("a",), ("b",), ("a", "b"), ("b", "c")] if r.random() < 0.8} or {("a",): 1}
        quotas = {s: r.randint(0, 6) for s in "abc"}
        out = mixing.route(words, quotas, 2)
        used = {s: sum(n for f in out.values() for (_, t), n in f.items() if t == s) for s in quotas}
        assert all(used[s] <= quotas[s] for s in quotas)
        for p, f in out.items():
            assert all(s in p for _, s in f) and all(sum(n for (c, _), n in f.items() if c == k) <= words[p] for k in (0, 1))
        best = brute(words, quotas)
        got = (sum(used.values()), -sum(n * c for f in out.values() for (c, _), n in f.items()))
        assert got == best


def brute(words, quotas):
    """(most words, least repeats) over all integer flows, source by source."""
    states = {tuple(0 for _ in words): 0}
    patterns = list(words)
    for s, q in quotas.items():
        for k, p in enumerate(patterns):
            if s in p:
                states = {**states}
        new = {}
        for state in states:
            stack = [(state, 0, 0)]
            while stack:
                st, k, used = stack.pop()
                if k == len(patterns):
                    new[st] = max(new.get(st, -1), states[state] + used)
                    continue
                room = min(q - used, 2 * words[patterns[k]] - st[k]) if s in patterns[k] else 0
                for n in range(room + 1):
                    stack.append(((*st[:k], st[k] + n, *st[k + 1 :]), k + 1, used + n))
        states = new
    return max((n, -sum(max(0, st[k] - words[p]) for k, p in enumerate(patterns))) for st, n in states.items())


def test_targets_reshare_the_excess():
    t = mixing.targets({"a": 10, "b": 100, "c": 100}, {"a": 3, "b": 1, "c": 2}, 1.5, 2)
    assert t["a"] == 20 and t["c"] == 197 + 1 / 3 - 1 / 3 or t["c"] <= 200
    assert sum(t.values()) == pytest.approx(315) and all(t[k] <= 2 * v for k, v in {"a": 10, "b": 100, "c": 100}.items())


def test_more_sources_than_the_driver_takes(spark, docs):
    """The plan that stays in Spark takes what the driver's takes; overlapping sources raise."""
    from pyspark.sql import functions as F

    many = spark.range(900).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") * 7919 % 61).cast("string")).alias("source"), F.repeat(F.lit("w "), (F.col("id") * 31 % 97 * F.when(F.col("id") % 61 == 5, 40).otherwise(1)).cast("int")).alias("text"))
    many = many.withColumn("source", F.when(F.col("doc_id") % 61 != 3, F.col("source")))
    for table in (many, docs):
        rows = lambda **more: sorted(map(str, mixing.mix(table, **more).select("doc_id", "size", "source_size", F.round("target", 6), "taken").collect()))  # noqa: B023, E731
        assert rows(max_patterns=1) == rows()
    both = many.withColumn("source", F.array("source", F.lit("all")))
    with pytest.raises(ValueError, match="overlapping"):
        mixing.mix(both, max_patterns=5)


def test_rows_without_ids_are_spread(spark):
    from pyspark.sql import functions as F

    table = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.concat(F.lit("a b c "), F.col("id").cast("string")).alias("text"))
    out = mixing.mix(table)
    assert out.agg(F.sum("taken")).first()[0] == pytest.approx(1.5 * 8000, abs=4)
    assert out.where("taken = 4").count() == pytest.approx(1000, abs=2)
