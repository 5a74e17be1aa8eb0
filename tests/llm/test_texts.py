import hashlib
import re
import time
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiforge.llm import chunk_dedup, forest_join, language, mixing, suffix_dedup
from lexiforge.llm.graph import components
from lexiforge.llm.shingles import shingle_set


def removed(rows):
    """Brute force: spans of bytes that 200-byte strings cover which start elsewhere too."""
    texts = [(t or "").encode() for t in rows]
    count = Counter(t[k : k + 200] for t in texts for k in range(len(t) - 199))
    out = []
    for t in texts:
        spans = []
        for k in range(len(t) - 199):
            if count[t[k : k + 200]] > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + 200
                else:
                    spans.append([k, k + 200])
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + t[at:a], b
        kept += t[at:]
        out.append((len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot, sizes", [(suffix_dedup.HOT, {}), (1, {}), (suffix_dedup.HOT, {"run_bytes": 20_000, "block_records": 5, "range_bytes": 2_000}), (2, {"run_bytes": 9_000, "block_records": 3, "range_bytes": 1_000})])
def test_suffixes_equal_brute_force(docs, no_docs, hot, sizes):
    """With one run and range, and with many of both, whose blocks end anywhere."""
    rows = docs.collect()
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, *x) for r, x in zip(rows, removed([r["text"] for r in rows]), strict=True))
    out = suffix_dedup.dedup_suffixes(docs, hot, **sizes)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in out.collect())
    assert got == want
    assert suffix_dedup.digests(no_docs).count() == 0


def test_references_in_slices_are_the_same(monkeypatch):
    from conftest import passage

    data = (passage(60, 3000) + "x" * 1500 + passage(61, 500)).encode()
    whole = suffix_dedup.references(data)
    for size in (1, 37, 200, 5000):
        monkeypatch.setattr(suffix_dedup, "SLICE", size)
        some = data if size > 1 else data[:900]
        want = whole if size > 1 else None
        if want is None:
            monkeypatch.setattr(suffix_dedup, "SLICE", 1 << 20)
            want = suffix_dedup.references(some)
            monkeypatch.setattr(suffix_dedup, "SLICE", size)
        assert all(np.array_equal(a, b) for a, b in zip(suffix_dedup.references(some), want, strict=True))


def test_a_long_text_takes_bounded_memory():
    """32 MB of text: the references' arrays are made in slices."""
    data = np.random.default_rng(1).integers(97, 123, 32 << 20).astype(np.uint8).tobytes()
    suffix_dedup.references(data[: 1 << 20])
    tracemalloc.start()
    q, _, _, _ = suffix_dedup.references(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(q) > 100_000 and peak < 400 << 20


def test_blocks_know_their_prefix_with_the_block_before():
    entries = [(w, b"", 0, 0, (1, 2), 3) for w in (b"abcd", b"abce", b"b")]
    data = suffix_dedup.encode_block(entries, 3)
    assert [(e[0], e[1]) for e in suffix_dedup.decode_block(data)] == [(3, b"abcd"), (3, b"abce"), (0, b"b")]


def test_sampled_keys_are_spread(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SAMPLE", 300)
    runs = spark.range(20_000).select(F.encode(F.format_string("%06d", "id"), "UTF-8").alias("first"), F.col("id").alias("run"), F.lit(0).alias("seq"))
    few = suffix_dedup.sampled_keys(runs, 20_000, 10, 4)
    many = suffix_dedup.sampled_keys(runs, 20_000, 200, 6)
    assert 150 < len(few) < 450 and set(map(len, few)) == {4} and few == sorted(few)
    assert 140 < len(many) < 260 and many == sorted(many) and max(np.diff([int(k) for k in many])) < 1000
    assert len(suffix_dedup.sampled_keys(runs.limit(50), 50, 3, 6)) == 50


def test_merge_of_runs_keeps_prefixes():
    r = np.random.default_rng(2)
    words = [[bytes(r.integers(97, 99, r.integers(0, 9)).astype(np.uint8)) for _ in range(r.integers(0, 40))] for _ in range(7)]
    runs = [suffix_dedup.decode_block(suffix_dedup.encode_block([(w, b"", 0, 0, (1, 2), 3) for w in sorted(ws)])) for ws in words if ws]
    out = list(suffix_dedup.merge(runs))
    assert [e[1] for e in out] == sorted(w for ws in words for w in ws)
    for a, b in zip(out, out[1:], strict=False):
        assert b[0] == suffix_dedup.common_prefix(a[1], b[1])


def test_chunks_catch_shared_passages(docs, odd_docs, no_docs):
    rows = {r["doc_id"]: r for r in chunk_dedup.dedup_chunks(docs).collect() if r["doc_id"] is not None}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert rows[5]["text"] == before[5] and rows[11]["text"] == before[11] and rows[7]["text"] is None and rows[8]["text"] == ""
    for k in (6, 15):
        cut = len(before[k].encode()) - len(rows[k]["text"].encode())
        assert 250 <= cut <= 700, k
    assert len(rows[3]["text"]) < 0.2 * len(before[3])
    assert chunk_dedup.dedup_chunks(no_docs).count() == 0
    assert chunk_dedup.dedup_chunks(odd_docs).columns[: len(odd_docs.columns)] == odd_docs.columns


def test_chunks_remove_passages_of_51_words(spark):
    """Every second copy goes, to a few bytes at its edges; its neighbours stay."""
    from conftest import passage

    rows, want = [], {}
    for k in range(200):
        shared, before, after = passage(1000 + k, 51), passage(3000 + k, 40), passage(5000 + k, 40)
        rows += [(k, f"{passage(7000 + k, 40)} {shared} {passage(9000 + k, 40)}"), (1000 + k, f"{before} {shared} {after}")]
        want[1000 + k] = (before, after)
    got = {r["doc_id"]: r["text"] for r in chunk_dedup.dedup_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == t for k, t in rows if k < 1000)
    left = [len(got[k]) - len(a) - len(b) for k, (a, b) in want.items()]
    assert max(left) <= 2
    assert all(got[k].startswith(a) and got[k].endswith(b) for k, (a, b) in want.items())


def test_runs_grow_past_their_chunks(spark):
    from conftest import passage

    for seed, words in ((1, 51), (2, 200)):
        shared = passage(seed, words)
        rows = [(1, f"{passage(12, 30)} {shared} {passage(13, 30)}"), (2, f"{passage(14, 30)} {shared} {passage(15, 30)}")]
        got = {r["doc_id"]: r["text"] for r in chunk_dedup.dedup_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got[1] == rows[0][1] and got[2].split() == f"{passage(14, 30)} {passage(15, 30)}".split()


def slow_chunks(data):
    """(start, chunk, bytes from the cut before, bytes to the cut after) by the rule, byte by byte."""
    low, cuts = [], [0]
    for p in range(16, len(data) + 1):
        h = sum(int(chunk_dedup.GEAR[data[p - 1 - k]]) << k for k in range(16)) & 0xFFFF
        if h < chunk_dedup.LOW * 65536:
            if not low or p - low[-1] > chunk_dedup.APART:
                cuts.append(p)
            low.append(p)
    cuts = [c for c in cuts if c < len(data)] + [len(data)]
    k = min(chunk_dedup.SPAN, len(cuts) - 1)
    return [(cuts[i], data[cuts[i] : cuts[i + k]], cuts[i] - cuts[i - 1] if i else 0, cuts[i + k + 1] - cuts[i + k] if i + k + 1 < len(cuts) else 0) for i in range(len(cuts) - k)]


def slow_runs(text, pieces, first, texts):
    """Marked places: chunks that are not the first ones, and what equals the bytes beside each first one's place at both ends of a run."""
    doc, data = text
    marked = [(a, len(c), first[c], before, after) for a, c, before, after in pieces if first[c] != (doc, a)]
    out = [(a, n) for a, n, *_ in marked]
    at = 0
    while at < len(marked):
        run, end = [marked[at]], marked[at][0] + marked[at][1]
        while at + len(run) < len(marked) and marked[at + len(run)][0] <= end:
            run.append(marked[at + len(run)])
            end = max(end, run[-1][0] + run[-1][1])
        begin, more = run[0][0], run[-1][4]
        room = min(begin, run[0][3] + 16 + chunk_dedup.APART)
        for a, _, (d, s), *_ in run:
            other, n = texts[d], 0
            while n < room and begin + s - a - n > 0 and data[begin - n - 1] == other[begin + s - a - n - 1]:
                n += 1
            m = 0
            while m < more and end + s - a + m < len(other) and data[end + m] == other[end + s - a + m]:
                m += 1
            if end - begin + room + more >= chunk_dedup.MIN_RUN:
                out += [(begin - n, n), (end, m)]
        at += len(run)
    return [x for x in out if x[1]]


def test_chunks_equal_brute_force(spark, docs):
    """Which bytes go, and which documents stay as they are: all chunks but the first ones, in runs of MIN_RUN bytes or more."""
    rows = docs.where("doc_id IS NOT NULL").collect() + spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id + 100 AS doc_id", "text", "lang", "source", "CAST(n_chars AS long) AS n_chars").collect()
    rows = [r for r in rows if len(r["text"] or "") < 20_000]
    first, found = {}, {}
    for doc, text in sorted({(r["doc_id"], r["text"] or "") for r in rows if r["doc_id"] != 12}):
        found[doc] = slow_chunks(text.encode()) if text else []
        for a, c, *_ in found[doc]:
            first.setdefault(c, (doc, a))
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in rows}
    got = {r["doc_id"]: r for r in chunk_dedup.dedup_chunks(spark.createDataFrame(rows, docs.schema).where("doc_id != 12")).collect()}
    n = 0
    for doc, pieces in found.items():
        kept, spans = chunk_dedup.remove(texts[doc], slow_runs((doc, texts[doc]), pieces, first, texts), chunk_dedup.MIN_RUN)
        assert (got[doc]["text"] or "").encode() == kept and [tuple(x) for x in got[doc]["lexi_spans"]] == spans, doc
        n += len(spans)
    assert n > 10


def test_cuts_do_not_depend_on_what_is_far(monkeypatch):
    data = np.random.default_rng(4).integers(32, 127, 20_000).astype(np.uint8)
    whole = chunk_dedup.cuts(data)
    moved = chunk_dedup.cuts(np.concatenate([data[:5000], np.frombuffer(b"insert!", np.uint8), data[5000:]]))
    near = range(4900, 5100)
    assert {c for c in whole.tolist() if c not in near} == {c - 7 * (c > 5000) for c in moved.tolist()} - set(near)
    monkeypatch.setattr(chunk_dedup, "_SLICE", 333)
    assert chunk_dedup.cuts(data).tolist() == whole.tolist()
    assert chunk_dedup.cuts(np.full(1000, 120, np.uint8)).tolist() in ([0, 1000], [0, 16, 1000])


def test_columns_of_any_name_stay(spark, docs):
    from pyspark.sql import functions as F

    odd = docs.select("*", F.lit(1).alias("a.b"), F.lit("t").alias("c`d"), F.struct(F.lit(1).alias("x y")).alias("e f"))
    for out in (chunk_dedup.dedup_chunks(odd).drop("lexi_bytes", "lexi_spans"), forest_join.keep_one(odd), mixing.apply_mix(odd), language.keep_accepted(odd, language.fit_on(docs))):
        rows = out.collect()
        assert out.columns == odd.columns and rows and all(r["a.b"] == 1 and r["c`d"] == "t" and r["e f"][0] == 1 for r in rows)


def test_similarity_join_equals_brute_force(docs, no_docs, odd_docs):
    rows = docs.collect()

    def shingles(t):
        w = [x for x in (t or "").lower().split() if x]
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(r["text"]) for r in rows]
    assert all(len(shingle_set(r["text"])) == len(s) for r, s in zip(rows, sets, strict=True))
    ids = [r["doc_id"] if r["doc_id"] is not None else forest_join.NO_ID for r in rows]
    n = len(rows)
    links = [{j for j in range(n) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8} for i in range(n)]
    group = list(range(n))
    for _ in range(n):
        for i in range(n):
            group[i] = min([group[i], *(group[j] for j in links[i])], key=lambda k: (ids[k], k))
    want = sorted((ids[i], len(links[i]), ids[group[i]]) for i in range(n))
    out = forest_join.near_duplicates(docs).collect()
    back = lambda v: forest_join.NO_ID if v is None else v
    assert sorted((back(r["doc_id"]), r["n_links"], back(r["component_id"])) for r in out) == want
    assert forest_join.near_duplicates(no_docs).count() == 0
    kept = forest_join.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    left = Counter(r["doc_id"] for r in kept.collect())
    assert left[0] == 1 and left[1] == 0 and left[3] == 0 and left[7] == left[8] == left[9] == left[None] == 1
    assert forest_join.keep_one(docs.where("doc_id = 4")).count() == 1


def test_prefix_depth_meets_the_recall():
    d = forest_join.prefix_depth(0.8)
    assert 1 - (1 - 0.8**d) ** forest_join.TREES >= forest_join.TARGET_RECALL > 1 - (1 - 0.8 ** (d + 1)) ** forest_join.TREES


def test_tries_keep_strings_with_company(spark):
    r = np.random.default_rng(8)
    values = r.integers(0, 2, (200, 3, 8)).astype(">u2")
    pairs = values.view(">i8").astype(np.int64)
    classes = spark.createDataFrame([(k, p[:, 0].tolist(), p[:, 1].tolist()) for k, p in enumerate(pairs)], "node long, hi array<long>, lo array<long>").repartition(3)
    for depth in (3, 6, 8):
        prefixes = Counter((t, v[t, :depth].tobytes()) for v in values for t in range(3))
        want = {(t, k) for k, v in enumerate(values) for t in range(3) if prefixes[t, v[t, :depth].tobytes()] > 1}
        got = [(x["tree"], x["node"]) for x in forest_join.tries(classes, depth).collect()]
        assert len(got) == len(set(got)) and want <= set(got) and len(set(got) - want) <= 2 * 8


def near_copies(n, edits, seed, words=120):
    """n texts that share all words but `edits` each."""
    from conftest import passage

    r, base = np.random.default_rng(seed), passage(seed, words).split()
    out = []
    for k in range(n):
        w = list(base)
        for at in r.choice(words, edits, replace=False):
            w[at] = f"w{k}x{at}"
        out.append(" ".join(w))
    return out


def links_by_force(texts, threshold=0.8):
    sets = [shingle_set(t) for t in texts]
    groups = {}
    for k, s in enumerate(sets):
        for x in s.tolist():
            groups.setdefault(x, []).append(k)
    common = Counter((a, b) for ks in groups.values() for i, a in enumerate(ks) for b in ks[i + 1 :])
    count = Counter()
    for (a, b), n in common.items():
        if n / (len(sets[a]) + len(sets[b]) - n) >= threshold:
            count[a] += 1
            count[b] += 1
    return count


def test_prefixes_shorten_until_the_recall_is_reached(spark):
    """A class with many near copies stops on the first level, one with a single partner at the threshold goes on to the last; blocks agree with one block."""
    texts = near_copies(120, 1, 50, 400) + [t for k in range(40) for t in near_copies(2, 1, 200 + k)]  # similarities of 0.95 and 0.84
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = links_by_force(texts)
    for block in (256, 20):
        levels: list = []
        got = {r["oid"]: r["n_links"] for r in forest_join.join_similar(docs, block=block, levels=levels).collect()}
        assert got == {k: want[k] for k in range(len(texts))}
        assert [d for d, _, _ in levels] == list(range(8, forest_join.prefix_depth(0.8) - 1, -1)) and levels[0][1] > 0
        finished = [n for _, _, n in levels]
        assert 100 <= finished[0] <= 120 and finished == sorted(finished) and finished[-2] < 120 + 80 == finished[-1]


def test_recall_on_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = links_by_force([r["text"] for r in rows])
    got = {r["doc_id"]: r["n_links"] for r in forest_join.near_duplicates(docs).collect()}
    assert sum(want.values()) > 50 and all(got[r["doc_id"]] <= want[k] for k, r in enumerate(rows))
    assert sum(got.values()) >= 0.999 * sum(want.values())


def test_one_row_stays_of_rows_that_differ_elsewhere(spark):
    from conftest import passage

    t = passage(1, 50)
    docs = spark.createDataFrame([(1, t, "x", 1), (1, t, "y", 2), (2, t + " more", "z", 3), (3, "", "q", 4), (3, "", "r", 5)], "doc_id long, text string, `a.b` string, copies int")
    kept = [forest_join.keep_one(docs.repartition(n)).collect() for n in (1, 3)]
    assert sorted(kept[0]) == sorted(kept[1]) and Counter(r["doc_id"] for r in kept[0]) == {1: 1, 3: 1} and kept[0][0].asDict().keys() == {"doc_id", "text", "a.b", "copies"}


def test_blocks_of_a_large_component_agree():
    r = np.random.default_rng(6)
    base = r.integers(0, 1 << 60, 50, np.uint64)
    sets = [np.unique(np.concatenate([base[r.random(50) < 0.97], r.integers(0, 1 << 60, 2, np.uint64)])) for _ in range(40)]
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j])) >= 0.8}
    i, j, share = forest_join.similar(sets, 0, 0.8)
    assert all(x == len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) for a, b, x in zip(i, j, share, strict=True))
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want
    i, j, _ = forest_join.similar(sets, 15, 0.8)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(a, b) for a, b in want if a < 15 <= b}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 102), (5, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 102: 100}


def test_languages_on_held_out_rows(spark, docs, no_docs, odd_docs):
    all_ = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit_on(all_.where("doc_id % 2 = 0"), sample_docs=300)
    rest = all_.where("doc_id % 2 = 1")
    found = language.identify(rest.selectExpr("doc_id AS id", "0L AS tkey", "text", "CAST(NULL AS string) AS declared", "source AS host", "'' AS suffix"), model)
    right = found.join(rest, found["id"] == rest["doc_id"]).selectExpr("avg(CAST(language = lang AS double))", "avg(CAST(accepted AS double))").first()
    assert right[0] > 0.97 and right[1] > 0.99
    kept = language.keep_accepted(odd_docs, model)
    assert kept.columns == odd_docs.columns and not {7, 8, 9} & {r["doc_id"] for r in kept.collect()}
    assert language.keep_accepted(no_docs, model).count() == 0
    foreign = spark.createDataFrame([(1, "Ξεσκεπάζω την ψυχοφθόρα βδελυγμία " * 5, None, "a", 1)], docs.schema)
    assert language.keep_accepted(foreign, model).count() == 0
    unlabelled = language.fit_on(no_docs)
    assert language.of_documents(docs, unlabelled).where("accepted").count() > 10


def test_rare_languages_and_copies_in_the_sample(spark, monkeypatch):
    from conftest import passage

    rows = [(passage(k, 20), "en") for k in range(1000)] + [("the same text", "de")] * 500 + [(f"der andere text {k}", "de") for k in range(30)] + [("Ξεσκεπάζω την ψυχοφθόρα βδελυγμία", "el")]
    seen: list = []
    counted = language.counted
    monkeypatch.setattr(language, "counted", lambda sample: seen.append([(r["text"], r["lang"]) for r in sample.collect()]) or counted(sample))
    names, _ = language.fit_on(spark.createDataFrame(rows, "text string, lang string"), sample_docs=30)
    assert names == ["de", "el", "en", language.UNDETERMINED]
    assert Counter(x for _, x in seen[0]) == {"en": 10, "de": 10, "el": 1} and len(set(seen[0])) == 21


def test_very_many_labels_stay_bounded(spark):
    """5,000 labels: the commonest ones are taken, ties by name, and their counts are exact."""
    rows = [(f"text number {k}", f"x{k % 5000:04d}") for k in range(5000)] + [(f"common text {k}", f"c{k % 5}") for k in range(40)]
    names, table = language.fit_on(spark.createDataFrame(rows, "text string, lang string"), sample_docs=40, languages=8)
    assert names == ["c0", "c1", "c2", "c3", "c4", "x0000", "x0001", "x0002", language.UNDETERMINED] and table.shape == (language.BUCKETS, 9)
    texts = sorted((t for t, x in rows if x == "c1"), key=lambda t: spark.range(1).select(F.xxhash64(F.lit(t))).first()[0])[:5]
    want = sum(np.bincount(c, minlength=language.BUCKETS) for t in texts for c in language.trigrams(t.encode()))
    assert np.allclose(table[:, 1], np.log((want + 0.01) / (want.sum() + 0.01 * language.BUCKETS)), atol=1e-5)


def test_pages_equal_a_plain_version(spark):
    """Likelihoods, declared languages and the smoothing from host to suffix to all, page by page."""
    sf = "/root/testdata/sf0.001"
    model = language.fit_on(spark.read.parquet(f"{sf}/documents.parquet"))
    names, table = model
    n = len(names)
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    rows += [(1000 + k, ["http://a.example.de/x", "https://A.example.de:80/y", "http://b.de", None, "nonsense"][k % 5], h) for k, (_, _, h) in enumerate(rows[:25])] + [(2000, None, None), (2001, "http://a.example.de", "<p>1 2 3</p>"), (2002, "http://z.org", "<html lang=xx><p>der die und nicht</p>")]
    seen = []
    for key, url, h in rows:
        codes = [c for c in language.trigrams(language.visible(h or "").encode())] if h else []
        score = sum((table[c].sum(axis=0, dtype=np.float64) for c in codes), np.zeros(n))
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", url or "")
        host = m[1].lower() if m else ""
        said = re.search(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", h or "", re.S | re.I)
        e = np.exp(language.TEMPER * score - (language.TEMPER * score).max())
        seen.append((key, host, host.rsplit(".", 1)[-1], said and said[1].lower(), score, e / e.sum(), sum(map(len, codes))))
    everywhere = (sum(x[5] for x in seen) + 1) / (len(seen) + n)
    want = {}
    for key, host, suffix, said, score, own, letters in seen:
        same, near = [x[5] for x in seen if x[1] == host], [x[5] for x in seen if x[2] == suffix]
        parent = (sum(near) + language.SUFFIX_WEIGHT * everywhere) / (len(near) + language.SUFFIX_WEIGHT)
        prior = (np.maximum(sum(same) - own, 0) + language.HOST_WEIGHT * parent) / (len(same) - 1 + language.HOST_WEIGHT)
        declared = np.zeros(n)
        if said and said.split("-")[0] in names[:-1]:
            declared[:] = np.log((1 - language.DECLARED_RIGHT) / (n - 2))
            declared[names.index(said.split("-")[0])] = np.log(language.DECLARED_RIGHT)
            declared[-1] = np.log(1 / (n - 1))
        log = language.TEMPER * score + declared + np.log(prior)
        post = np.exp(log - log.max())
        post /= post.sum()
        k = int(post.argmax())
        want[key] = (said, host, names[k], float(post[k]), letters > 0 and k < n - 1 and post[k] >= language.LEAST_POSTERIOR)
    got = {r["id"]: tuple(r)[2:] for r in language.of_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    assert got.keys() == want.keys() and len({x[1] for x in want.values()}) > 10
    for key, w in want.items():
        assert got[key][:3] == w[:3] and got[key][3] == pytest.approx(w[3], abs=1e-6) and got[key][4] == w[4], key


def test_pages_use_markup_and_host(spark):
    model = language.fit_on(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    pages = spark.createDataFrame([(1, "http://a.example.de/x", '<html lang="de"><p>der die und ist nicht keit heit schen</p>'), (2, None, None), (3, "bad", "<p>")], "page_id long, url string, html string")
    got = {r["id"]: (r["declared"], r["host"], r["language"], r["accepted"]) for r in language.of_pages(pages, model).collect()}
    assert got[1] == ("de", "a.example.de", "de", True) and got[2][1] == "" and not got[2][3] and not got[3][3]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["<!--", "-->", "<script", "<STYLE", "</script >", "</style", ">", "<", "&amp;", "&x", "word", " ", "\n", "b", "</", "<!-->"]), max_size=14))
def test_visible_text_by_the_rule(parts):
    hidden = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>|&\w+;", re.S | re.I)
    assert language.visible("".join(parts)) == hidden.sub(" ", "".join(parts))


def test_unclosed_markup_takes_linear_time():
    for part in ("<script ", "<style ", "<!--", "<", "</", "&a", "<script></script", "<!-- >"):
        began = time.time()
        language.visible(part * (2_000_000 // len(part)))
        assert time.time() - began < 10, part


def test_equal_row_keys_lose_no_text(spark, monkeypatch):
    """Rows without ids whose keys all agree: text that occurs once stays."""
    from conftest import passage

    shared = passage(40, 60)
    texts = [passage(41, 80), f"{passage(42, 30)} {shared}", f"{shared} {passage(43, 45)}"]
    rows = [(None, t) for t in texts]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(chunk_dedup, "row_key", lambda: F.lit(1).cast("long"))
    got = [r["text"] for r in chunk_dedup.dedup_chunks(table).collect()]
    assert texts[0] in got
    assert all(any(passage(s, n) in t for t in got) for s, n in ((42, 30), (43, 45)))
    monkeypatch.undo()
    got = sorted(len(r["text"]) for r in chunk_dedup.dedup_chunks(table).collect())
    assert sum(map(len, texts)) - sum(got) >= len(shared) - 2 and texts[0] in [r["text"] for r in chunk_dedup.dedup_chunks(table).collect()]


def test_stretches_with_other_bytes_are_no_marks():
    data = b"abcdefgh" * 40
    check = {"kind": chunk_dedup.CHECK, "at": 8, "n": 200}
    after = {"kind": chunk_dedup.AFTER, "at": 208, "n": 12, "answer": b"abcdefghXXXX"}
    assert chunk_dedup.confirmed(data, [{**check, "answer": chunk_dedup.digest_of(data[8:208])}, after]) == [(8, 200), (208, 8)]
    assert chunk_dedup.confirmed(data, [{**check, "answer": b"another"}, after]) == []


def test_rows_of_one_id_and_other_texts_are_deduplicated(spark):
    from conftest import passage

    shared = passage(50, 70)
    texts = [f"{passage(51, 30)} {shared}", f"{passage(52, 30)} {shared}"]
    got = sorted(len(r["text"]) for r in chunk_dedup.dedup_chunks(spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string")).collect())
    assert len(shared) - 2 <= sum(map(len, texts)) - sum(got) <= len(shared) + 2


def test_asks_equal_a_plain_version():
    """Runs, their stretches and ends, chunk by chunk."""
    r = np.random.default_rng(4)
    names = ("start", "size", "s_id", "s_key", "s_at", "before", "after")
    for trial in range(60):
        n = int(r.integers(0, 40))
        doc = np.sort(r.integers(0, 4, n))
        start = r.integers(0, 300, n)
        cols = dict(zip(names, (start, r.integers(1, 60, n), r.integers(0, 3, n), r.integers(0, 2, n), start + r.integers(-3, 2, n) * 100 + 300, r.integers(0, 20, n), r.integers(0, 20, n)), strict=True))
        none = (cols["s_id"] == 0) & (r.random(n) < 0.5)
        want = []
        for d in range(4):
            rows = sorted(({k: int(v[i]) for k, v in cols.items()} | {"none": bool(none[i])} for i in np.flatnonzero(doc == d)), key=lambda x: (x["start"], x["size"]))
            runs, end = [], -1
            for x in rows:
                if x["start"] > end:
                    runs.append([])
                runs[-1].append(x)
                end = max(end, x["start"] + x["size"])
            for part in runs:
                first, last = part[0], max(part, key=lambda x: x["start"] + x["size"])
                a, e, after = first["start"], last["start"] + last["size"], last["after"]
                back = min(a, first["before"] + chunk_dedup.LOOK)
                if e - a + back + after < 100:
                    continue
                by = {}
                for x in part:
                    of = by.setdefault((x["none"], x["s_id"], x["s_key"], x["s_at"] - x["start"]), [])
                    if of and x["start"] <= of[-1][1]:
                        of[-1][1] = max(of[-1][1], x["start"] + x["size"])
                    else:
                        of.append([x["start"], x["start"] + x["size"]])
                for (none_, s_id, s_key, shift), places in by.items():
                    ask = lambda at, kind, n: want.append((d, at, kind, n, none_, s_id, s_key, at + shift))  # noqa: B023, E731
                    for lo, hi in places:
                        ask(lo, chunk_dedup.CHECK, hi - lo)
                    if back and a + shift > 0:
                        ask(a, chunk_dedup.BEFORE, back)
                    if after:
                        ask(e, chunk_dedup.AFTER, after)
        got = chunk_dedup.asks_of(doc, cols | {"s_none": none}, 100)
        assert sorted(zip(*(got[k].tolist() for k in ("doc", "at", "kind", "n", "s_none", "s_id", "s_key", "s_at")), strict=True)) == sorted(want), trial


def test_texts_and_marks_meet_in_small_batches(spark, docs):
    """What is returned is a stored table: no map over texts and marks is left to run in whatever batches its reader uses."""
    out = chunk_dedup.dedup_chunks(docs)
    assert "MapInArrow" not in out._jdf.queryExecution().toString()
    assert out.columns == [*docs.columns, "lexi_bytes", "lexi_spans"] and out.count() == docs.count()


def test_classes_without_a_pair_to_compare_send_no_shingles():
    """Of four classes, two share a longer prefix and the others a prefix in an earlier tree: none is compared here, but for pairs of the last two with the first."""
    label = np.zeros((4, forest_join.TREES), forest_join.LABEL)
    label["there"][:, 3] = 1
    label["hi"][:, 3], label["lo"][:, 3] = 1 << 48, [1, 1, 1 << 32, 2 << 32]
    asking = np.ones(4, bool)
    assert forest_join.with_pairs(asking, label, 0, 3, 5).tolist() == [0, 1, 2, 3]
    assert forest_join.with_pairs(asking[:2], label[:2], 0, 3, 5).tolist() == []
    assert forest_join.with_pairs(asking[1:3], label[1:3], 1, 3, 5).tolist() == [0, 1]
    label["there"][2:, 1] = 1
    assert forest_join.with_pairs(asking[2:], label[2:], 0, 3, 5).tolist() == []
    assert forest_join.with_pairs(~asking, label, 0, 3, 5).tolist() == []


def rows_named(monkeypatch):
    """The rows that each table of forest_join.materialize() has got, by its label."""
    rows, write = Counter(), forest_join.materialize

    def counted(df, label, *more):
        out = write(df, label, *more)
        rows[label] += out.count()
        return out

    monkeypatch.setattr(forest_join, "materialize", counted)
    return rows


def test_rows_that_meet_do_not_grow_with_the_blocks(spark, monkeypatch):
    """op8_forest_join: strings and shingles are joined to a class once for each of its trie nodes, however many blocks the node has."""
    docs = spark.createDataFrame(list(enumerate(near_copies(60, 1, 50, 400))), "doc_id long, text string")
    rows, seen = rows_named(monkeypatch), []
    for block in (256, 6):
        links = {r["oid"]: r["n_links"] for r in forest_join.join_similar(docs, block=block).collect()}
        seen.append((links, rows["members"], rows["compared"]))
        rows.clear()
    assert seen[0] == seen[1] and seen[0][1] > 60


def test_blocks_of_several_rows_meet_whole(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(forest_join, "ROW", 64)
    sets = [np.arange(k, k + 5, dtype=np.uint64) for k in range(7)]
    label = np.zeros((7, forest_join.TREES), forest_join.LABEL)
    label["hi"] = np.arange(7)[:, None]
    names = [*forest_join.KEY, "node", "asking", "label", "weight", "shingles"]
    rows = [(3, 8, 9, 2, int(k > 3), k, k % 2 == 0, label[k].tobytes(), k + 1, sets[k].tobytes()) for k in (0, 1, 1, 2, 3, 4, 5, 6)]  # class 1 came twice
    packed = [r for b in forest_join.pack([pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])]) for r in b.to_pylist()]
    assert len(packed) > 2 and sum(len(r["nodes"]) for r in packed) == 7 * 8
    for i, j, left, want in ((0, 0, 0, range(4)), (0, 1, 4, range(7)), (1, 1, 0, range(4, 7))):
        held = [{"t": 3, "h": 8, "l": 9, "i": i, "j": j, **r} for r in packed if r["block"] in (i, j)]
        [(key, block, got, c)] = forest_join.meeting([pa.RecordBatch.from_pylist(held)])
        assert key[:4] == (3, 8, 9, 2) and got == left and block.tolist() == [int(k > 3) for k in want]
        assert c.nodes.tolist() == list(want) and c.weights.tolist() == [k + 1 for k in want] and c.asking.tolist() == [k % 2 == 0 for k in want]
        assert np.array_equal(c.label, label[list(want)]) and all(np.array_equal(s, sets[k]) for s, k in zip(c.sets, want, strict=True))
    assert not list(forest_join.meeting([pa.RecordBatch.from_pylist([{"t": 3, "h": 8, "l": 9, "i": 1, "j": 2, **r} for r in packed if r["block"] == 1])]))
