import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexiforge.llm import tokens
from lexiforge.llm.packing import pack
from lexiforge.llm.token_tables import Table, encode_to_tables, write_tables
from lexiforge.llm.tokens import Encoder, public_tokenizer

FILES = {False: "byte_bpe_50k.json", True: "word_bpe_49k.json"}
ENCODERS = {w: Encoder(public_tokenizer(f), w, cache_units=50) for w, f in FILES.items()}
PIECES = st.sampled_from(["a", "Foo", " ", "  ", "\n", "\n\n", "\t", "\r", "é", "'s", "'", "12", "3", ",", "!?", " ", "　", "\x1c", "\x85", "日本", "é", "<|endoftext|>", "​", "I'll", "ß", "ж", "ÉÀÜ", "straße", " Über", "ÿ"])


def plain(words):
    t = Tokenizer.from_file(public_tokenizer(FILES[words]))
    t.encode_special_tokens = True
    return t


PLAIN = {w: plain(w) for w in FILES}


@pytest.mark.parametrize("words", [False, True])
@settings(max_examples=300, deadline=None)
@given(parts=st.lists(PIECES, max_size=14))
def test_units_give_the_ids_of_the_whole_text(words, parts):
    text = "".join(parts)
    assert np.frombuffer(ENCODERS[words].encode(text), ENCODERS[words].dtype).tolist() == PLAIN[words].encode(text, add_special_tokens=False).ids


def ids(text, words, end):
    return [*PLAIN[words].encode(text or "", add_special_tokens=False).ids, end]


def test_packing_covers_each_id_once(docs, no_docs):
    rows = pack(docs, public_tokenizer(FILES[False]), length=256).collect()
    want = sorted(zlib.crc32(np.array(ids(r["text"], False, 1), "<u4").tobytes()) for r in docs.collect())
    by, got = {}, []
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        by.setdefault(r["sequence_id"], []).append(r)
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for seq, pieces in by.items():
        at = 0
        for p in pieces:
            assert p["offset"] == at
            at += p["length"]
        assert at == 256 or seq == max(by)
    open_, left = b"", 0
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):  # documents follow each other
        assert r["start"] == len(open_) // 4
        open_ += r["ids"]
        if r["start"] + r["length"] == r["doc_tokens"]:
            got.append(zlib.crc32(open_))
            open_ = b""
    assert sorted(got) == want and not left
    assert pack(no_docs, public_tokenizer(FILES[False])).count() == 0


def test_tables_round_trip_and_lookup(spark, docs, no_docs, tmp_path):
    manifest = write_tables(docs, f"file://{tmp_path}", public_tokenizer(FILES[True]), 2, True, shard_bytes=20_000)
    tables = [Table(r["path"]) for r in manifest.collect()]
    assert len(tables) > 1
    for r in docs.collect():
        want = ids(r["text"], True, 2)
        assert sum(want == x.tolist() for t in tables for x in t.get(r["doc_id"])) >= 1
    assert all(t.get(999_999) == [] for t in tables)
    rows = encode_to_tables(docs, public_tokenizer(FILES[True])).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in docs.collect()), key=lambda x: -1 if x is None else x)
    at = 0
    for r in rows:
        assert r["start"] == at and zlib.crc32(r["ids"]) == r["ids_crc32"]
        at += r["n_tokens"]
    assert sorted(r["ids_crc32"] for r in rows) == sorted(zlib.crc32(np.array(ids(r["text"], True, 2), "<u4").tobytes()) for r in docs.collect())
    assert encode_to_tables(no_docs, public_tokenizer(FILES[True])).count() == 0


def test_rows_that_repeat_an_identifier_fill_several_shards(spark, tmp_path):
    rows = [(None if k % 3 else 7, f"word{k} " * (k % 90)) for k in range(600)] + [(3, "same text")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    manifest = write_tables(docs, f"file://{tmp_path}", public_tokenizer(FILES[True]), 2, True, shard_bytes=8_000)
    tables = [Table(r["path"]) for r in manifest.collect()]
    assert len(tables) > 5 and sum(bool(t.get(None)) for t in tables) > 1 and sum(bool(t.get(7)) for t in tables) > 1
    assert sum(len(t.get(None)) for t in tables) == 400 and sum(len(t.get(3)) for t in tables) == 50
    got = encode_to_tables(docs, public_tokenizer(FILES[True]), shard_bytes=8_000).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in rows), key=lambda x: -1 if x is None else x)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert sorted(r["ids_crc32"] for r in got) == sorted(zlib.crc32(np.array(ids(t, True, 2), "<u4").tobytes()) for _, t in rows)


def test_damage_and_false_positives(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(2 * k, f"text {k}") for k in range(40)], "doc_id long, text string")
    path = write_tables(docs, f"file://{tmp_path}", public_tokenizer(FILES[True]), 2, True).first()["path"]
    table = Table(path)
    table.bloom = np.full_like(table.bloom, 255)  # the filter lets everything through: the block decides
    assert [len(table.get(k)) for k in (-1, 0, 1, 78, 79, 80, None)] == [0, 1, 0, 1, 0, 0, 0]
    data = bytearray(open(path[7:], "rb").read())
    data[table.blocks[0][0] + 3] ^= 1
    open(f"{tmp_path}/damaged.sst", "wb").write(data)
    with pytest.raises(ValueError, match="damaged"):
        Table(f"file://{tmp_path}/damaged.sst").get(2)
    open(f"{tmp_path}/other", "wb").write(bytes(200))
    with pytest.raises(ValueError, match="not a token table"):
        Table(f"file://{tmp_path}/other")


@pytest.mark.parametrize(("n", "last"), [(2048, 2048), (2048 + 256, 256), (2048 + 257, 2048), (2049, 1)])
def test_the_last_sequence_is_padded_unless_it_is_a_power_of_two(spark, n, last):
    docs = spark.createDataFrame([(1, " a" * (n - 1), "x", 5)], "doc_id long, text string, length string, part long")
    rows = sorted(pack(docs, public_tokenizer(FILES[False])).collect(), key=lambda r: r["start"])
    assert sum(r["length"] for r in rows) == n and rows[-1]["padded_length"] == last
    assert all(r["padded_length"] == 2048 for r in rows[:-1])


def test_long_units_are_not_kept():
    e = tokens.Encoder(tokens.public_tokenizer("byte_bpe_50k.json"), words=False)
    text = " ".join(["short", "x" * 300, "Ω" * 90, "short", "y" * 64])
    want = e.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(e.encode(text), e.dtype).tolist() == want == np.frombuffer(e.encode(text), e.dtype).tolist()
    assert e.cache and max(map(len, e.cache)) <= tokens.LONG + 1


@settings(max_examples=300, deadline=None)
@given(parts=st.lists(PIECES, max_size=14))
def test_texts_with_gaps_or_odd_characters_are_unusual(parts):
    text = "".join(parts)
    assert tokens.unusual(text) == any(len(c.encode()) > 1 and not c.isalpha() or c in "\t\r'\x1c" or tokens._ODD.match(c) is not None or a + c in ("  ", " \n", "\n ", "\n\n") for a, c in zip(" " * 0 + "x" + text, text))


def test_documents_are_cut_at_the_sequences_whatever_their_length(spark):
    """Pieces, digests and ids of documents that end at a sequence's end, span many or share one, in several batches."""
    texts = ["a b c d e f g", "a", None, "a b c", "x " * 40 + "x", "", "日本 é", "a b c d e f"]
    rows = [(k if k != 3 else None, texts[k % len(texts)]) for k in range(1200)]
    got = sorted((tuple(r) for r in pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), public_tokenizer(FILES[False]), end_id=1, length=8).collect()), key=lambda r: (r[5], r[6]))
    at, want, own = 0, [], {t: ids(t, False, 1) for t in texts}
    total = sum(len(own[t]) for _, t in rows)
    for doc, text in rows:
        x, start = own[text], 0
        while start < len(x):
            seq, off = divmod(at + start, 8)
            stop = min(len(x), start + 8 - off)
            data, rest = np.array(x[start:stop], "<u4").tobytes(), total % 8
            want.append((doc, start, stop - start, zlib.crc32(data), len(x), seq, off, rest if seq == total // 8 and rest in (0, 1, 2, 4) else 8, data))
            start = stop
        at += len(x)
    assert [(*r[:8], bytes(r[8])) for r in got] == want
