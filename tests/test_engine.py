import contextlib
import http.server
import itertools
import logging
import random
import threading
import time
import urllib.parse
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiforge import cli
from lexiforge.functions.automaton import automaton
from lexiforge.functions.base_form import base_form, format_parts
from lexiforge.functions.calls import template_call
from lexiforge.functions.endings import default_inflexions, default_suffixes, segment_ending, segment_endings
from lexiforge.operators import conll_arrays, conllx, features, letters, segmentation, templates, wikitext
from lexiforge.plans import api, fixtures, queries
from lexiforge.sources import dumps, files, html_tables, progress, sinks, texts
from lexiforge.streaming import dumps as streams

DUMP = """<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.11/">
<page><title>му́шка</title><ns>0</ns><revision><text xml:space="preserve">old</text></revision><revision><text xml:space="preserve">{{-ru-}} {{сущ ru f ina 3*a|основа=мушк|основа1=мушек}} {{морфо||муш|к|а}}</text></revision></page>
<page><title>Шаблон:сущ ru f ina 3*a</title><ns>10</ns><revision><text xml:space="preserve">x</text></revision></page>
<page><title>пусто</title><ns>0</ns><revision><text /></revision></page></mediawiki>"""


@pytest.fixture
def dump(tmp_path):
    p = tmp_path / "in" / "dump.xml"
    p.parent.mkdir()
    p.write_text(DUMP)
    return str(p)


def test_dictionary_sizes():
    assert len(default_inflexions()) == 86 and len(default_suffixes()) == 169


def test_endings(spark):
    df = spark.createDataFrame(fixtures.ENDINGS, "e string, want string")
    assert df.where(~segment_ending(F.col("e")).eqNullSafe(F.col("want"))).count() == 0


def test_nested_call_is_balanced(spark):
    df = spark.createDataFrame([("x {{морфо|a|{{b|c}}}} {{d|e}}",), ("{{морфо|{{a}}",), ("none",)], "t string")
    got = [r[0] for r in df.select(template_call(F.col("t"), wikitext.MORFO)).collect()]
    assert got == ["{{морфо|a|{{b№c}}}}", None, None]


def test_base_form_faults(spark):
    calls = {"{{морфо|а|б|в|г|д|е}}": "too_many_positional", "{{морфо|чушь=а}}": "unknown_part_name", "{{морфо||jj||}}": "bad_yot", "{{морфо|корень=|источник=x||дом}}": None}
    df = spark.createDataFrame([(k, v) for k, v in calls.items()], "m string, want string").withColumn("b", base_form(F.col("m")))
    assert [r for r in df.select("m", "want", "b.err").collect() if r["want"] != r["err"]] == []
    assert df.where(F.col("want").isNull()).select(format_parts(F.col("b.parts"))).first()[0] == "корень_дом"


def test_dump_to_metas_and_pages(spark, dump, tmp_path):
    pages = dumps.read_pages(spark, dump)
    assert {r["title"]: r["text"] is None for r in pages.collect()} == {"му́шка": False, "Шаблон:сущ ru f ina 3*a": False, "пусто": True}
    assert [r["title"] for r in api.pages(spark, dump, wikitext.TEMPLATE_TITLE).collect()] == ["Шаблон:сущ ru f ina 3*a"]
    row = api.metas(spark, dump).collect()
    assert [(r[0], r[1], r[2]) for r in row] == [("{{морфо||муш|к|а}}", "сущ ru f ina 3*a", ["основа=мушк", "основа1=мушек"])]
    sinks.write_metas(api.metas(spark, dump), str(tmp_path / "metas"))
    assert texts.metas(spark, str(tmp_path / "metas")).collect() == row
    assert dumps.land_pages(spark, dump, str(tmp_path / "landed")).where(F.col("kind") == "template").count() == 1


def test_stream_gives_the_same_metas(spark, dump, tmp_path):
    pages = streams.stream_pages(spark, str(tmp_path / "in"))
    streams.stream_metas(pages, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["{{морфо||муш|к|а}};сущ ru f ina 3*a;основа=мушк;основа1=мушек"]


def test_command_line_segments(spark, dump, tmp_path, capsys):
    tables = tmp_path / "tables"
    tables.mkdir()
    for name, text in fixtures.TABLES.items():
        (tables / (name.replace("/", "%") + ".table")).write_text(text)
    assert sorted(r[0] for r in texts.tables(spark, str(tables)).select("template_name").collect()) == sorted(fixtures.TABLES)
    assert cli.main(["-D", dump, "-T", str(tables), "-O", str(tmp_path / "seg")], spark) == 0
    assert spark.read.text(str(tmp_path / "seg")).count() == 9
    cli.main(["-D", dump, "pages", "му"], spark)
    assert "му́шка" in capsys.readouterr().out


def test_rendered_tables(spark):
    fetch = lambda titles: ((t, *((None, 404, 1, "404 Not Found") if "x" in t else ("<table style='float:right;'><tr><td>{{{1}}}а</td></tr></table>", 200, 1, None))) for t in titles)
    titles = spark.createDataFrame([("Шаблон:сущ ru a",), ("Шаблон:x",)], "title string")
    found = html_tables.answers(titles, fetch)
    rows = html_tables.parse_tables(html_tables.rendered(found)).collect()
    assert [(r["template_name"], r["row_no"], r["cells"], r["err"]) for r in rows] == [("сущ ru a", 0, ["{{{1}}}а"], None)]
    assert [tuple(r) for r in html_tables.unrendered(found).collect()] == [("tables", "status_404", "404 Not Found", "Шаблон:x")]
    bad = html_tables.parse_tables(spark.createDataFrame([("t", "<b></a>")], "template_name string, html string"))
    assert bad.first()["err"] and bad.first()["cells"] is None and [r["code"] for r in html_tables.table_rejects(bad).collect()] == ["bad_markup"]


class Wiki(http.server.BaseHTTPRequestHandler):
    """Answers at first with faults: busy titles twice 503, slow ones once too late, cut ones once with a broken connection; gone ones are not there."""

    protocol_version, asked = "HTTP/1.1", Counter()

    def do_GET(self):
        title = urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query)["title"][0]
        Wiki.asked[title] += 1
        status = 404 if "gone" in title else 503 if "busy" in title and Wiki.asked[title] < 3 or "never" in title else 200
        if "slow" in title and Wiki.asked[title] == 1:
            time.sleep(1.5)
        if "cut" in title and Wiki.asked[title] == 1:
            self.connection.close()
            return
        body = f"<table style='float:right;'><tr><td>{title}</td></tr></table>".encode()
        self.send_response(status)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        with contextlib.suppress(OSError):
            self.wfile.write(body)

    def log_message(self, *args):
        pass


def test_pages_come_through_faults(spark, tmp_path):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Wiki)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        names = [f"Шаблон:{kind} {k}" for kind in ("plain", "busy", "slow", "cut", "gone", "never") for k in range(3)]
        fetch = html_tables.http_fetch(f"127.0.0.1:{server.server_address[1]}", timeout=0.7, tries=4, wait=0.02, secure=False)
        found = sinks.write_answers(html_tables.answers(spark.createDataFrame([(n,) for n in names], "title string"), fetch, connections=3), str(tmp_path / "answers"))
        rows = {r["title"]: r for r in found.collect()}
    finally:
        server.shutdown()
        server.server_close()
    assert sorted(rows) == sorted(names)
    kinds = {kind: {(r["status"], r["html"] is not None, r["tries"]) for t, r in rows.items() if kind in t} for kind in ("plain", "busy", "slow", "cut", "gone", "never")}
    assert kinds == {"plain": {(200, True, 1)}, "busy": {(200, True, 3)}, "slow": {(200, True, 2)}, "cut": {(200, True, 2)}, "gone": {(404, False, 1)}, "never": {(503, False, 4)}}
    assert {r["code"] for r in html_tables.unrendered(found).collect()} == {"status_404", "status_503"}
    lost = html_tables.answers(spark.createDataFrame([("t",)], "title string"), html_tables.http_fetch("127.0.0.1:9", timeout=0.5, tries=2, wait=0.01, secure=False))
    assert [(r["status"], r["tries"], r["html"]) for r in lost.collect()] == [(None, 2, None)] and html_tables.unrendered(lost).first()["code"] == "no_answer"


def test_tables_of_saved_pages(spark, tmp_path):
    (tmp_path / "saved").mkdir()
    (tmp_path / "saved" / "сущ ru a%b.html").write_text("<table style='float:right;'><tr><td>{{{1}}}а</td></tr></table>")
    (tmp_path / "saved" / "bad.html").write_text("<b></a>")
    argv = ["-T", str(tmp_path / "tables"), "-R", str(tmp_path / "bad")]
    assert cli.main([*argv, "tables", "--saved", str(tmp_path / "saved"), "-H"], spark) == 0
    tables = lambda: sorted(map(tuple, cli.read_tables(spark, str(tmp_path / "tables")).collect()))
    assert tables() == [("сущ ru a/b", "{{{1}}}а |\n")]
    assert [(r["code"], r["key"]) for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [("bad_markup", "bad")]
    assert cli.main(["-T", str(tmp_path / "again"), "tables", "--saved", str(tmp_path / "tables.html")], spark) == 0
    assert sorted(map(tuple, cli.read_tables(spark, str(tmp_path / "again")).collect())) == tables()


def test_output_grammar_and_poison(spark):
    known = templates.templates(fixtures.table_texts(spark))
    assert known.where("poisoned").select("template_name").collect()[0][0] == "гл ru bad"
    metas = spark.createDataFrame([(m[0], m[1], m[2]) for m in fixtures.METAS], "morfo string, template_name string, stems array<string>")
    assert segmentation.segmentations(metas, known).count() == len(fixtures.expected_forms())
    assert segmentation.segmentations(metas.limit(0), known).count() == 0


def test_letters_reject_and_restore(spark):
    words = spark.createDataFrame([(1, "корень_муш суфф_ек оконч_"), (2, "bad"), (3, "а_б_в"), (4, "")], "word_id long, value string")
    assert {r["key"] for r in letters.letter_rejects(words).collect()} == {"2", "3"}
    back = letters.words_from_letters(letters.letters(words)).first()
    assert [(m["type"], m["part"]) for m in back["morphemes"]] == [("корень", "муш"), ("суфф", "ек")]
    start = spark.createDataFrame([(1, 0, "а", "корень")], "word_id long, pos int, letter string, label string")
    assert letters.words_from_letters(start).first()["err"] == "bad_start_tag"


def test_conll_columns_and_decoder(spark, tmp_path):
    f = tmp_path / "a.conll"
    f.write_text("1\tму-ша\tl\tN\tN\t_\t0\tr\t_\t_\n2\tна\tl\tP\tPR\t_\t0\tr\t_\t_\n\n\n1\tа\tl\tN\tN\t_\t0\tr\t_\t_")
    rows = [(f"{c}-WORD|C", None, "корень_начало", 1.0) for c in "мш"] + [(f"{c}-WORD|C", None, "корень", 1.0) for c in "уа"]
    weights = spark.createDataFrame(rows, "feature string, label_prev string, label string, weight double")
    out = {(r["sent_id"], r["id"]): r for r in api.segment_conll(spark, str(f), weights, ["корень_начало", "корень"]).collect()}
    assert len(out) == 3 and out[0, "1"]["корень"] == "му|ша" and out[0, "2"]["корень"] == "_" and out[1, "1"]["корень"] == "_"
    morphemes = F.array(*(F.struct(F.lit("суфф").alias("type"), F.lit(p).alias("part")) for p in "аб"))
    row = spark.range(1).select(*conllx.morpheme_columns(morphemes, compatible=True)).first()
    assert row["суфф"] == "|аб"


def files_in(folder):
    return {str(f.relative_to(folder)): f.read_text() for f in folder.rglob("*") if f.is_file() and not f.name.endswith(".crc")}


def test_sentences_of_several_files_stay_apart(spark, tmp_path):
    rows = [("/in/a.conll", 0, 1, "a0 second"), ("/in/x/b", 0, 0, "b0"), ("/in/a.conll", 1, 0, "a1"), ("/in/a.conll", 0, 0, "a0 first"), ("/in/x/a.conll", 0, 0, "other a")]
    lines = spark.createDataFrame(rows, "doc string, sent_id long, line_no int, line string").repartition(3)
    docs = lines.select("doc").union(spark.createDataFrame([("/in/empty",)], "doc string"))
    for _ in range(2):  # a rerun replaces the files
        sinks.write_sentences(lines, str(tmp_path / "out"), docs)
    assert files_in(tmp_path / "out") == {"a.segmented.conll": "a0 first\na0 second\n\na1\n\n", "x/b.segmented": "b0\n\n", "x/a.segmented.conll": "other a\n\n", "empty.segmented": ""}
    assert [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("_")] == []


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    rows = spark.range(4).select(F.concat(F.lit(f"{tmp_path}/out/f"), F.col("id").cast("string")).alias("file"), "id", F.when(F.col("id") < 3, "text").otherwise(F.raise_error(F.lit("stop"))).alias("value"))
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "f0").write_text("before")
    with pytest.raises(Exception, match="stop"):
        files.write_files(rows, str(tmp_path / "out"), "id")
    assert files_in(tmp_path / "out") == {"f0": "before"} and len(list((tmp_path / "out").iterdir())) == 1
    writer = files.FilesWriter(str(tmp_path / "out"))
    batch = pa.RecordBatch.from_pydict({"file": [f"{tmp_path}/out/a"], "value": ["x"]})
    lost, one, two = writer.write([batch]), writer.write([batch]), writer.write([batch])
    with pytest.raises(ValueError, match="several places"):
        writer.commit([one, two])
    writer.commit([writer.write([batch])])  # what a killed attempt (lost) has written goes with the folder
    assert files_in(tmp_path / "out") == {"f0": "before", "a": "x"} and lost.files[0][0].startswith(writer.temporary)


def test_outputs_of_equal_names_and_beside_their_inputs(spark, tmp_path):
    model = stored_model(spark, tmp_path)
    line = lambda form: f"1\t{form}\tl\tN\tN\tf\t0\tr\tp\tq\n"
    for folder, form in (("a", "му"), ("b c%20", "мукшу")):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "x.conll").write_text(line(form))
        (tmp_path / "in" / folder / "s").write_text(f"корень_{form}\n")
    inputs = [str(tmp_path / "in" / f / "x.conll") for f in ("a", "b c%20")]
    assert cli.main(["-O", str(tmp_path / "out"), "segment", *inputs, "--model", model], spark) == 0
    got = files_in(tmp_path / "out")
    assert sorted(got) == ["a/x.segmented.conll", "b c%20/x.segmented.conll"]
    assert "\tму\t" in got["a/x.segmented.conll"] and "му|шу\tк" in got["b c%20/x.segmented.conll"] and all(t.count("\n") == 2 for t in got.values())
    assert cli.main(["segment", *inputs, "--model", model, "--beside"], spark) == 0
    assert (tmp_path / "in" / "b c%20" / "x.segmented.conll").read_text() == got["b c%20/x.segmented.conll"]
    assert cli.main(["-O", str(tmp_path / "letters"), "letters", *(str(tmp_path / "in" / f / "s") for f in ("a", "b c%20"))], spark) == 0
    assert files_in(tmp_path / "letters") == {"a/s.conll": "м корень_начало\nу корень\n\n", "b c%20/s.conll": "м корень_начало\nу корень\nк корень\nш корень\nу корень\n\n"}
    assert not [p for p in tmp_path.rglob("_writing*")]


def test_one_dictionary_alone(spark, tmp_path):
    (tmp_path / "i").write_text("# note\nам\n ым \n")
    one, none = texts.dictionaries(spark, str(tmp_path / "i"))
    assert sorted(r[0] for r in one.collect()) == ["ам", "ым"] and none is None
    none, one = texts.dictionaries(spark, None, str(tmp_path / "i"))
    assert sorted(r[0] for r in one.collect()) == ["ам", "ым"] and none is None


def test_dictionaries_of_any_size(spark):
    """The joined dictionaries give what the listed ones give, and the plan does not grow with them."""
    rng = random.Random(3)
    words = [e for e, _ in fixtures.ENDINGS] + ["".join(rng.choice("аеиностькямч") for _ in range(rng.randint(0, 9))) + rng.choice(["", "ся", "сь"]) for _ in range(400)] + [None]
    endings = spark.createDataFrame([(w,) for w in words], "ending string")
    tables = [spark.createDataFrame([(w,) for w in d], "value string") for d in (default_inflexions(), default_suffixes())]
    want = {r["ending"]: r["s"] for r in endings.select("ending", segment_ending(F.col("ending")).alias("s")).collect()}
    assert sum(v is not None for v in want.values()) > 60
    for dictionaries in ((None, None), tables, (tables[0], None), (None, tables[1])):
        assert {r["ending"]: r["seg_ending"] for r in segment_endings(endings, *dictionaries).collect()} == want
    inflexions, suffixes = ["", "а", "ом"], ["ик", "ок", "н"]
    of = lambda n: [spark.range(n).select(F.concat(F.lit("ъ"), F.col("id").cast("string")).alias("value")).union(spark.createDataFrame([(w,) for w in d], "value string")) for d in (inflexions, suffixes)]
    forms = spark.createDataFrame([("t", "p", e) for e in ("ика", "окна", "ом", "икнома", "иком", None)], "template_name string, parameter string, ending string")
    plans = []
    for n in (200_000, 100):
        out = templates.segmented_forms(forms, *of(n))
        plans.append(len(out._jdf.queryExecution().optimizedPlan().toString()))
        if n > 100:
            assert {r["ending"]: r["seg_ending"] for r in out.collect()} == {r["ending"]: r["seg_ending"] for r in templates.segmented_forms(forms, inflexions, suffixes).collect()}
    assert abs(plans[0] - plans[1]) < 50


def stored_model(spark, tmp_path):
    rows = ["м-WORD|C\t\tкорень_начало\t1", "ш-WORD|C\t\tкорень_начало\t1", "у-WORD|C\t\tкорень\t1", "START-OF-суфф-TYPE-MORPHEME|CpC\t\tсуфф_начало\t5", "к-ш-PWORD-WORD|CpC\tсуфф_начало\tкорень_начало\t2"]
    (tmp_path / "weights.tsv").write_text("\n".join(rows) + "\n")
    (tmp_path / "suffixes").write_text("# note\nк\n")
    argv = ["model", str(tmp_path / "weights.tsv"), str(tmp_path / "model"), "--labels", "корень,корень_начало,суфф_начало", "--lexicon", f"суфф={tmp_path / 'suffixes'}"]
    assert cli.main(argv, spark) == 0
    return str(tmp_path / "model")


def test_command_line_segments_sentences_of_two_files(spark, tmp_path):
    model = stored_model(spark, tmp_path)
    line = lambda k, form, pos="N": f"{k}\t{form}\tl\tN\t{pos}\tf\t0\tr\tp\tq"
    (tmp_path / "a.conll").write_text(f"{line(1, 'му-шук')}\n{line(2, 'му', 'PR')}\n\n{line(1, 'мукшу')}")
    (tmp_path / "b").write_text(f"{line(1, 'м')}\nonly\tthree\tfields\n")
    argv = ["-O", str(tmp_path / "out"), "-R", str(tmp_path / "bad"), "segment", str(tmp_path / "a.conll"), str(tmp_path / "b"), "--model", model, "--partitions", "3"]
    assert cli.main(argv, spark) == 0
    got = files_in(tmp_path / "out")
    out = lambda k, form, pos, root, suff: f"{k}\t{form}\tl\tN\t{pos}\tf\t_\t{root}\t{suff}\t_\t\t0\tr\tp\tq\n"
    assert got["a.segmented.conll"] == out(1, "му-шук", "N", "му|шу", "к") + out(2, "му", "PR", "_", "_") + "\n" + out(1, "мукшу", "N", "му|шу", "к") + "\n"
    assert got["b.segmented"] == out(1, "м", "N", "_", "_") + "\n"
    assert [(r["stage"], r["code"], r["detail"]) for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [("conll", "bad_columns", "only\tthree\tfields")]
    with pytest.raises(Exception, match="expected 10 fields"):
        cli.main([*argv, "--strict"], spark)


def test_model_is_required(spark, tmp_path):
    with pytest.raises(ValueError, match="no model"):
        features.load_model(spark, " ")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        features.load_model(spark, str(tmp_path / "none"))


def letter_features(word, types):
    """Plain version: the features of both cliques for each letter."""
    n, out = len(word), []
    for k, c in enumerate(word):
        before, after = f"{word[k - 1] if k else ''}-{c}-PWORD-WORD", f"{c}-{word[k + 1] if k + 1 < n else ''}-WORD-NWORD"
        alone, pair = {before, f"{c}-WORD", after, f"{k}-POSITION", f"{n - k}-BACK-POSITION"}, {before, after}
        for side, found in (("START", [word[k:e] for e in range(k + 1, n + 1)]), ("END", [word[b:k] for b in range(k + 1)])):
            for m in found:
                if m in types:
                    pair |= {f"{side}-OF-{m}-MORPHEME", *(f"{side}-OF-{t}-TYPE-MORPHEME" for t in types[m])}
        out.append({f + "|C" for f in alone} | {f + "|CpC" for f in pair})
    return out


LEXICON = [("под", "прист"), ("ход", "корень"), ("ход", "слово"), ("хо", "корень"), ("ом", "оконч"), ("м", "оконч"), ("а", "оконч"), ("", "пусто"), ("", "оконч"), ("дом", "корень")]


@pytest.mark.parametrize("rows", [LEXICON, [r for r in LEXICON if r[0]], []])
def test_features_equal_the_plain_version(spark, monkeypatch, rows):
    spelled = ["подходом", "дом", "аа", "", "x😀", "а-б"]
    words = spark.createDataFrame([(w, w) for w in spelled], "word_id string, word string")
    lexicon = spark.createDataFrame(rows, "morpheme string, type string")
    types = {}
    for m, t in rows:
        types.setdefault(m, set()).add(t)
    want = sorted((w, k, f) for w in spelled for k, each in enumerate(letter_features(w, types)) for f in each)
    assert sorted(map(tuple, features.all_features(words, lexicon).collect())) == want
    letters_ = words.select("word_id", F.explode(features.split_letters(F.col("word"))).alias("l")).select("word_id", "l.pos", "l.letter")
    assert sorted(map(tuple, features.context_features(letters_).collect())) == sorted(x for x in want if x[2].endswith("|C"))
    monkeypatch.setattr(features, "LEXICON_ROWS", -1 if not rows else 1)  # as if it were too large for executors
    assert sorted(map(tuple, features.pair_features(words, lexicon).collect())) == sorted(x for x in want if x[2].endswith("|CpC"))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abç", min_size=1, max_size=5), max_size=15, unique=True), st.lists(st.text("abçx", max_size=12), max_size=12))
def test_automaton_finds_every_occurrence(strings, texts_):
    got = sorted(zip(*(x.tolist() for x in automaton(strings).matches(texts_)), strict=True))
    assert got == sorted((i, e, k) for i, t in enumerate(texts_) for k, s in enumerate(strings) for e in range(len(s), len(t) + 1) if t[e - len(s) : e] == s)


def test_a_model_of_any_size_gives_the_same_labels(spark, monkeypatch):
    rng = random.Random(8)
    labels, spelled = ["a", "b", "c"], ["подходом", "ход", "пох", "а", "", None, "ход"]
    names = {f for w in spelled if w for each in letter_features(w, {"ход": {"корень"}}) for f in each}
    rows = [(f, p, x, rng.random()) for f in sorted(names) for p in (None, *labels) for x in labels]
    words = spark.createDataFrame([(k, w) for k, w in enumerate(spelled)], "word_id long, word string")
    weights, lexicon = spark.createDataFrame(rows, features.WEIGHTS), spark.createDataFrame([("ход", "корень")], "morpheme string, type string")
    run = lambda **more: {r["word_id"]: [(x["letter"], x["label"]) for x in r["labelled"]] for r in features.decode(words, weights, labels, lexicon, **more).collect()}
    small = run()
    assert [len(small[k]) for k in range(7)] == [8, 3, 3, 1, 0, 0, 3]
    assert run(features=features.factory("lexiforge.operators.features:all_features")) == small
    monkeypatch.setattr(features, "MODEL_ROWS", 2)
    assert run() == small
    # and each is the best of all sequences
    weight = {(f, p, x): w for f, p, x, w in rows}
    for w, path in ((w, [x for _, x in small[k]]) for k, w in enumerate(spelled) if w and len(w) == 3):
        seen = letter_features(w, {"ход": {"корень"}})
        score = lambda path: sum(weight[f, p, path[k]] for k in range(len(w)) for f in seen[k] for p in ((None, path[k - 1]) if k else (None,)))  # noqa: B023, E731
        assert score(path) == pytest.approx(max(map(score, itertools.product(labels, repeat=len(w)))))


def one_letter_features(words, lexicon):
    """A feature factory of one's own."""
    return words.select("word_id", F.posexplode(F.split("word", "")).alias("pos", "feature"))


def test_a_feature_factory_by_name(spark, tmp_path):
    weights = spark.createDataFrame([("м", None, "корень_начало", 1.0), ("у", None, "корень", 1.0), ("к", None, "суфф_начало", 1.0)], features.WEIGHTS)
    features.save_model(weights, ["корень", "корень_начало", "суфф_начало"], str(tmp_path / "model"))
    (tmp_path / "a.conll").write_text("1\tмук\tl\tN\tN\tf\t0\tr\tp\tq\n")
    argv = ["-O", str(tmp_path / "out"), "segment", str(tmp_path / "a.conll"), "--model", str(tmp_path / "model")]
    assert cli.main([*argv, "--features", f"{__name__}:one_letter_features"], spark) == 0
    assert "\tf\t_\tму\tк\t_\t" in (tmp_path / "out" / "a.segmented.conll").read_text()


def test_lines_are_made_once(spark, tmp_path):
    (tmp_path / "a.conll").write_text("1\tму-ша\tl\tN\tN\tf\t0\tr\tp\tq\n")
    weights = spark.createDataFrame([("м-WORD|C", None, "корень_начало", 1.0)], features.WEIGHTS)
    out = api.segment_conll(spark, str(tmp_path / "a.conll"), weights, ["корень", "корень_начало"])
    out.write.format("noop").mode("overwrite").save()
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("FileScan text") == 1 and "ReusedExchange" in final


def test_decoder_is_the_best_of_all_label_sequences(spark):
    labels, word = ["a", "b", "c"], "xyxx"
    rng = random.Random(5)
    rows = [(f, p, x, rng.random()) for f in ("x-WORD|C", "y-WORD|C") for p in (None,) for x in labels] + [(f, p, x, rng.random()) for f in ("x-y-PWORD-WORD|CpC", "y-x-PWORD-WORD|CpC", "x-x-PWORD-WORD|CpC") for p in labels for x in labels]
    weight = {(f, p, x): w for f, p, x, w in rows}
    seen = letter_features(word, {})
    score = lambda path: sum(w for (f, p, x), w in weight.items() for k in range(len(word)) if f in seen[k] and x == path[k] and (p is None or k and p == path[k - 1]))
    best = max(itertools.product(labels, repeat=len(word)), key=score)
    words = spark.createDataFrame([(1, word), (2, None), (3, ""), (4, word)], "word_id long, word string")
    got = {r["word_id"]: tuple(x["label"] for x in r["labelled"]) for r in features.decode(words, spark.createDataFrame(rows, features.WEIGHTS), labels).collect()}
    assert got == {1: best, 2: (), 3: (), 4: best}


def test_sinks_and_sources_of_files(spark, tmp_path):
    pages = spark.createDataFrame([("a/b c", "text"), ("a-b_c", None)], "title string, text string")
    for _ in range(2):  # a rerun replaces the pages
        sinks.write_pages(pages, str(tmp_path / "pages"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "pages")).collect())) == [("a-b_c", "a-b_c", ""), ("a-b_c", "a/b c", "text")]
    sinks.write_tables(spark.createDataFrame([("сущ/1", "{{{1}}}а |\n")], "template_name string, value string"), str(tmp_path / "tables"))
    assert cli.read_tables(spark, str(tmp_path / "tables")).collect()[0]["template_name"] == "сущ/1"
    (tmp_path / "s.txt").write_text("корень_дом\nкорень_муш суфф_к\n")
    lines = api.to_letters(spark, str(tmp_path / "s.txt"))
    sinks.write_letters(lines, str(tmp_path / "letters"))
    assert files_in(tmp_path / "letters") == {"s.txt.conll": "д корень_начало\nо корень\nм корень\n\nм корень_начало\nу корень\nш корень\nк суфф_начало\n\n"}
    sinks.write_page_files(pages, str(tmp_path / "page-files"))
    assert files_in(tmp_path / "page-files") == {"a-b_c": "text"}
    assert sorted(r["value"] for r in texts.segmentations(spark, str(tmp_path / "s.txt")).collect()) == ["корень_дом", "корень_муш суфф_к"]
    (tmp_path / "m").write_text("# x\nом\nом\n")
    assert sorted(map(tuple, features.load_lexicon(spark, {"оконч": str(tmp_path / "m"), "суфф": str(tmp_path / "m")}).collect())) == [("ом", "оконч"), ("ом", "суфф")]
    df, seen = progress.observed(spark.range(7).withColumn("code", F.when(F.col("id") > 4, "big")), "n", ("big", "small"))
    df.collect()
    assert seen.get == {"rows": 7, "big": 2, "small": 0}


def dump_of(pages):
    """A dump of (title, timestamp, id, text)."""
    each = "".join(f"<page><title>{t}</title><ns>0</ns><revision><id>{k}</id><timestamp>{when}</timestamp><text>{x}</text></revision></page>" for t, when, k, x in pages)
    return f"<mediawiki>{each}</mediawiki>"


def call(stem):
    return f"{{{{-ru-}}}} {{{{сущ ru m a 1a|основа={stem}}}}} {{{{морфо||{stem}||}}}}"


FIRST = dump_of([("стол", "2024-01-02", 5, call("стол")), ("дом", "2024-01-01", 2, call("дом")), ("сад", "2024-01-01", 3, call("сад")), ("лес", "2024-03-01", 9, call("лес"))])
SECOND = dump_of([("стол", "2024-02-01", 7, call("стул")), ("дом", "2024-02-01", 8, "no longer a word"), ("лес", "2024-02-01", 6, call("лис")), ("мост", "2024-02-01", 1, call("мост"))])


@pytest.mark.parametrize("order", [(FIRST, SECOND), (SECOND, FIRST)])
def test_dumps_in_any_order_give_the_last_revisions(spark, tmp_path, order):
    folder = tmp_path / "in"
    folder.mkdir()
    seen = progress.StreamLog()
    spark.streams.addListener(seen)
    for k, text in enumerate(order):
        (folder / f"{k}.xml").write_text(text)
        for _ in range(2):  # a restart finds nothing new
            streams.stream_latest_metas(streams.stream_revisions(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    got = sorted(map(tuple, streams.current_metas(spark, str(tmp_path / "out")).collect()))
    want = wikitext.metas(streams.latest(dumps.read_revisions(spark, str(folder))))
    assert got == sorted(map(tuple, want.collect())) and sorted(r[0] for r in got) == [f"{{{{морфо||{w}||}}}}" for w in ("лес", "мост", "сад", "стул")]
    assert {r["title"]: r["err"] for r in streams.current_rows(spark, str(tmp_path / "out")).collect()}["дом"] == "no_ru_section"
    for _ in range(100):  # events come a little later
        if seen.rows >= 8:
            break
        time.sleep(0.1)
    spark.streams.removeListener(seen)
    assert seen.rows == 8 and len(list((tmp_path / "out").glob("batch=*"))) == 2


def test_every_command_counts_its_rejects(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO, "lexiforge")
    (tmp_path / "dump.xml").write_text(dump_of([("стол", "", 1, call("стол")), ("дом", "", 2, "no section"), ("сад", "", 3, "{{-ru-}} nothing"), ("лес", "", 4, "{{-ru-}}"), ("нос", "", 5, call("нос"))]))
    (tmp_path / "tables").mkdir()
    (tmp_path / "tables" / "сущ ru m a 1a.table").write_text("{{{основа}}}а |")
    (tmp_path / "seg").write_text("корень_дом\nbad token\n")
    (tmp_path / "metas").write_text("{{морфо||стол||}};сущ ru m a 1a;основа=стол\n{{морфо||дом||}};none;дом\n")
    base = ["-D", str(tmp_path / "dump.xml"), "-R", str(tmp_path / "bad"), "-T", str(tmp_path / "tables"), "-O", str(tmp_path / "out")]
    for argv, line in (
        (["metas"], "3 rejects: no_morfo 2, no_ru_section 1"), (["letters", str(tmp_path / "seg")], "1 rejects: bad_token 1"),
        (["-M", str(tmp_path / "metas")], "1 rejects: template_missing 1"), ([], "0 rejects: "),
    ):
        caplog.clear()
        assert cli.main([*base, *argv], spark) == 0
        assert line in caplog.messages, caplog.messages
        rejects = spark.read.parquet(str(tmp_path / "bad")).groupBy("code").count().orderBy("code").collect()
        assert line == f"{sum(r['count'] for r in rejects)} rejects: " + ", ".join(f"{r['code']} {r['count']}" for r in rejects)
        assert any(m.split()[-1] in ("metas", "words", "segmentations") for m in caplog.messages)


def test_running_stages_are_told(spark, caplog):
    caplog.set_level(logging.INFO, "lexiforge")
    with progress.told(spark, 0.05):
        spark.range(0, 40, 1, 8).select(F.expr("reflect('java.lang.Thread', 'sleep', 60L)")).write.format("noop").mode("overwrite").save()
    assert any("of 8 tasks done" in m for m in caplog.messages)


def test_few_templates_are_broadcast(spark, monkeypatch):
    known = templates.templates(fixtures.table_texts(spark))
    metas = spark.createDataFrame([(m[0], m[1], m[2]) for m in fixtures.METAS], "morfo string, template_name string, stems array<string>")
    plan = lambda: segmentation.rendered(metas, segmentation.sized(known))._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan()
    monkeypatch.setattr(segmentation, "BROADCAST_TEMPLATES", 1)
    assert "broadcast" not in plan()


def test_keys_of_one_row_group_are_dealt_out_to_all_tasks(spark):
    sf = "/root/testdata/sf0.001"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for rows in (fixtures.metas_by_key(spark, sf), fixtures.pages_by_key(spark, sf)):
        assert len({r[0] for r in rows.select(F.spark_partition_id()).collect()}) == n


ODD_CONLL = [
    "1\tму-ша\tl\tN\tN\tf\t0\tr\tp\tq\n\n1\ta b\tl\tN\tN\tf\t0\tr\tp\tq\n2\tx\tl\tN\tPR\tf\t0\tr\tp\tq", "", " \n\t\n", "bad\tline\n\n\n\n1\t\tмуам\tl\t\tN\tN\tf\t0\tr\tp\tq\n2\tмуам\tl\tN\tN\tf\t0\tr\tp\n\n",
    "1\tмук\tl\tN\tN\tf\t0\tr\tp\tq\r\n2\tкум\tl\tN\tN\tf\t0\tr\tp\tq\r\n\r\n \x0b\n3\tумк\tl\tN\tN\tf\t0\tr\tp\tq\r\n", " \n1\tкк-мм мум\tl\tN\tN\tf\t0\tr\tp\tq\n\u0085",
]


@pytest.fixture
def conll_documents(spark):
    """doc, values: each odd text by itself, two in one document, none."""
    return spark.createDataFrame([(k, [x]) for k, x in enumerate(ODD_CONLL)] + [(100, [ODD_CONLL[0], ODD_CONLL[3], ODD_CONLL[4]]), (101, []), (102, None)], "doc long, values array<string>").repartition(2).cache()


def test_conll_counts_of_whole_texts(spark, conll_documents):
    want = conllx.counts(conllx.sentences(conll_documents.select("doc", F.explode("values").alias("value"))))
    got = conll_arrays.counts(conll_documents)
    assert got.count() == 5 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("compatible", [False, True])
def test_documents_are_segmented_where_they_are(spark, conll_documents, compatible):
    """The rows of the joins, without one; a form has a part that is no morpheme, and one with a bad start."""
    weights = spark.createDataFrame([("м-WORD|C", None, "корень_начало", 1.0), ("у-WORD|C", None, "корень", 1.0), ("ш-WORD|C", None, "суфф_начало", 1.0), ("а-WORD|C", None, "суфф", 1.0), ("к-WORD|C", None, "корень_начало", 0.5)], features.WEIGHTS)
    args = (weights, ["корень", "корень_начало", "суфф", "суфф_начало"], "_начало", compatible)
    got = api.segment_documents(conll_documents, *args)
    lines = conllx.sentences(conll_documents.select("doc", F.explode("values").alias("value")))
    want = api.segment_lines(lines, *args).select("doc", "sent_id", "line_no", conllx.line().alias("line"), F.exists(F.array(*conllx.COLUMNS), lambda c: c != "_").alias("segmented"))
    rows = sorted(map(tuple, got.select("doc", F.explode("lines").alias("l")).select("doc", "l.*").collect()))
    assert rows == sorted(map(tuple, want.collect())) and len(rows) == 15
    assert all(r["lines"] == sorted(r["lines"]) for r in got.collect())
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    # features of one's own go by joins
    joined = api.segment_documents(conll_documents, *args, features_=features.all_features).collect()
    assert sorted(map(tuple, joined)) == sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("query", [queries.conll_columns, queries.segment_conll])
def test_conll_queries_shuffle_texts_alone(spark, query):
    plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan


def test_forms_of_a_template_are_distinct_over_its_texts(spark):
    tables = spark.createDataFrame([("t", "{{{a}}}а {{{a}}}а {{{b}}}"), ("t", "{{{a}}}а́ {{{a}}}ом"), ("u", None), (None, "{{{a}}}"), (None, "{{{a}}}")], "template_name string, value string")
    want = [(None, "{{{a}}}", ""), ("t", "{{{a}}}", "а"), ("t", "{{{a}}}", "ом"), ("t", "{{{b}}}", "")]
    assert sorted(map(tuple, templates.template_forms(tables).collect()), key=str) == sorted(want, key=str)
    # the groups of another pattern may be equal where its matches differ
    assert [tuple(r) for r in templates.template_forms(tables.where("template_name = 't'"), r"(\{\{\{)(.)(?=.\}\})?[^ ]*").select("template_name", "parameter", "ending").collect()].count(("t", "{{{", "a")) == 1


def test_documents_are_dealt_out_once_before_their_tables_are_made(spark):
    plan = queries.template_forms(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    shuffles = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert len(shuffles) == 2 and sum("REPARTITION" in x for x in shuffles) == 1
