"""The registered queries of the segmentation engine, and the same rows in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.base_form import base_form, format_parts, part_order
from ..functions.calls import template_call
from ..functions.endings import default_inflexions, default_suffixes, segment_ending
from ..functions.stems import align_stems, lookup, parameters, placeholder
from ..functions.text import computed
from ..operators import conll_arrays, conllx, features, fitting, letters, segmentation, templates, wikitext
from ..sources.html_tables import parse_tables, table_text
from ..sources.texts import dictionary
from . import api
from . import fixtures as X

#: Characters that XML does not allow.
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
BEFORE = '<p/><table style="float:left;"><tr><td>no</td></tr></table><table style="float : right; x">'
AFTER = '<tr><td><a>pl.</a></td><td> {{{s}}}i <br/>x</td><td><b/></td></tr></table><table style="float:right;"><tr><td>no</td></tr></table>'
URL_PATTERN = r"https?://(m|blog)\."
LATIN_INFLEXIONS = ["", "s", "e", "en", "er", "es", "ing", "ed"]
LATIN_SUFFIXES = ["tion", "able", "ment", "keit", "heit", "ion", "th", "er", "an", "in", "re"]
WORDS_SQL = r"(SELECT DISTINCT word FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM documents) WHERE word <> '')"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct words a-z of all documents."""
    words = read(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word"))
    return words.where(F.col("word") != "").distinct()


def title_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wikitext.pages_by_title(read(spark, sf_dir, "pages"), URL_PATTERN, "url").select("page_id", "url")


def dictionary_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document as a line of a dictionary, and those of X.DICTIONARY, which have signs and notes."""
    lines = read(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("value")).union(spark.createDataFrame([(x,) for x in X.DICTIONARY], "value string"))
    return dictionary(lines).withColumn("kind", F.lit("raw")).unionByName(dictionary(lines, True).withColumn("kind", F.lit("bare")))


def segment_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.by_key(spark, sf_dir, "part", "p_partkey", [(e,) for e, _ in X.ENDINGS], "ending string")
    return rows.select("k", "ending", segment_ending(F.col("ending")).alias("seg_ending"))


def suffix_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the rules run on distinct words: without computed() the filter would take them below the distinct
    return computed(document_words(spark, sf_dir), "seg", segment_ending(F.col("word"), LATIN_INFLEXIONS, LATIN_SUFFIXES)).where(F.col("seg").isNotNull())


def part_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.by_key(spark, sf_dir, "part", "p_partkey", [(n,) for n, _, _ in X.NAMES], "name string").withColumn("o", part_order(F.col("name")))
    return rows.select("k", "name", F.col("o.ord").alias("ord"), F.col("o.tag").alias("tag"))


def base_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.metas_by_key(spark, sf_dir).withColumn("b", base_form(F.col("morfo")))
    return rows.where(F.col("b.err").isNull()).select("k", "morfo", format_parts(F.col("b.parts")).alias("base"))


def yot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.by_key(spark, sf_dir, "part", "p_partkey", [(m,) for m, _, _ in X.YOTS], "morfo string")
    rows = rows.withColumn("a", base_form(F.col("morfo"))).withColumn("b", base_form(F.col("morfo"), compatible=True))
    show = lambda c: F.when(F.col(f"{c}.err").isNull(), format_parts(F.col(f"{c}.parts")))
    return rows.select("k", "morfo", show("a").alias("fixed"), show("b").alias("compatible"))


def align(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.metas_by_key(spark, sf_dir).withColumn("b", base_form(F.col("morfo"))).where(F.col("b.err").isNull())
    rows = rows.withColumn("s", align_stems(F.col("stems"), F.col("b.parts")))
    return rows.select("k", F.col("s.err").alias("err"), F.when(F.col("s.err").isNull(), F.array_join(F.transform("s.stems", lambda s: s["seg"]), ";")).alias("stems"))


def template_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forms of a table for each document, whose cells are placeholders named by its words with an ending by their length, and of the tables of X.TABLES."""
    endings = F.array(*map(F.lit, X.CELL_ENDINGS))
    cells = F.transform(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != ""), lambda w: F.concat(F.lit("{{{"), w, F.lit("}}}"), F.get(endings, F.length(w) % len(X.CELL_ENDINGS)), F.lit(" |")))
    docs = read(spark, sf_dir, "documents").select(F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("template_name"), "text")
    # dealt out by name before their tables are made: these are longer, and meet by name where they are
    tables = docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "template_name").select("template_name", F.array_join(cells, " ").alias("value"))
    # no document's table has a name of X.TABLES
    return templates.template_forms(tables).unionByName(templates.template_forms(X.table_texts(spark)))


def param_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.metas_by_key(spark, sf_dir).withColumn("b", base_form(F.col("morfo"))).where(F.col("b.err").isNull())
    rows = rows.withColumn("s", align_stems(F.col("stems"), F.col("b.parts"))).where(F.col("s.err").isNull()).withColumn("p", parameters(F.col("s.stems")))
    return rows.select("k", lookup(F.col("p"), F.lit("{{{1}}}")).alias("first"), lookup(F.col("p"), F.lit("{{{основа1}}}")).alias("stem1"), placeholder(F.col("p"), F.lit("{{{основа|{{{1}}}}}}")).alias("with_default"))


def known_templates(spark: SparkSession) -> DataFrame:
    return segmentation.sized(templates.templates(X.table_texts(spark)))


def segment_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.segmentations(X.metas_by_key(spark, sf_dir), known_templates(spark), keep=("k",))


def form_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.rejects(X.metas_by_key(spark, sf_dir), known_templates(spark)).groupBy("code").agg(F.count("*").alias("n"))


def template_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.template_misses(X.metas_by_key(spark, sf_dir), X.table_texts(spark)).select("k", "template_name")


def extract_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.pages_by_key(spark, sf_dir)
    return rows.select("k", template_call(F.col("text"), wikitext.MORFO).alias("morfo"), template_call(F.col("text"), wikitext.TABLE).alias("call"))


def metas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = wikitext.parsed_pages(X.pages_by_key(spark, sf_dir)).where(F.col("err").isNull())
    return rows.select("k", "morfo", "template_name", F.concat_ws(";", "stems").alias("stems"))


def page_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wikitext.page_rejects(X.pages_by_key(spark, sf_dir)).groupBy("code").agg(F.count("*").alias("n"))


def segmented_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word_id, value: every form of every meta, numbered by key and position."""
    done = segmentation.rendered(X.metas_by_key(spark, sf_dir), known_templates(spark)).select("k", F.posexplode(F.array_sort("forms")).alias("i", "value"))
    return done.select((F.col("k") * 100 + F.col("i")).alias("word_id"), "value")


def letter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return letters.letters(segmented_words(spark, sf_dir))


def letters_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = letters.words_from_letters(letters.letters(segmented_words(spark, sf_dir)))
    return back.select("word_id", F.array_join(F.transform("morphemes", lambda m: F.concat_ws("_", m["type"], m["part"])), " ").alias("value"))


def pivot_morphemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = letters.words_from_letters(letters.letters(segmented_words(spark, sf_dir)))
    return back.select("word_id", *(c.alias(n) for c, n in zip(conllx.morpheme_columns(F.col("morphemes")), ("prist", "koren", "suff", "okonch"), strict=True)))


def spelled_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word_id, word: the distinct words A-Z, a-z of all documents as they are spelled, each its own id. A word's features depend on nothing else."""
    words = read(spark, sf_dir, "documents").select(F.explode(F.split("text", "[^A-Za-z]+")).alias("word"))
    return words.where(F.col("word") != "").distinct().select(F.col("word").alias("word_id"), "word")


def ctx_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context features of every word of every text."""
    return features.clique_features(spelled_words(spark, sf_dir), None, "C")


def lexicon_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair features of every word of every text."""
    lexicon = [(m, "end") for m in LATIN_INFLEXIONS if m] + [(m, "mid") for m in LATIN_SUFFIXES]
    return features.clique_features(spelled_words(spark, sf_dir), spark.createDataFrame(lexicon, "morpheme string, type string"), "CpC")


def conll_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, values: CoNLL-X texts from whole texts, a row for each doc_id."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    # few bytes, but much work: a file of one row group would be one task. The texts of a doc_id meet here, and are not shuffled again.
    dealt = docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    return dealt.groupBy(F.col("doc_id").alias("doc")).agg(F.collect_list("text").alias("texts")).select("doc", X.conll_texts("texts").alias("values"))


def conll_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences, tokens, their parts and the malformed lines of every document."""
    return conll_arrays.counts(conll_documents(spark, sf_dir))


def segment_conll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segmenter from end to end over every text: the output lines of each document as one digest. In its model a, e, i, o and u go on with a root, all else begins one."""
    model = spark.createDataFrame([(f"{c}-WORD|C", None, "корень", 1.0) for c in "aeiou"], features.WEIGHTS)
    done = api.segment_documents(conll_documents(spark, sf_dir), model, ["корень" + letters.BEGIN, "корень"])
    found = F.size(F.filter("lines.segmented", lambda x: x)).cast("long")
    return done.select("doc", F.size("lines").cast("long").alias("tokens"), found.alias("segmented"), F.md5(F.array_join("lines.line", "\n")).alias("lines_md5"))


def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The address and the whole markup of every page as cells of a rendered table, read back; every fifth table is malformed."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), CONTROLS, ""), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cells = F.concat(F.lit("<tr><th>"), escaped(F.col("url")), F.lit("</th><td>"), escaped(F.col("html")), F.lit("</td></tr>"))
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("template_name"), F.concat(F.when(F.col("page_id") % 5 == 4, "</b>").otherwise(""), F.lit(BEFORE), cells, F.lit(AFTER)).alias("html"))
    return table_text(parse_tables(pages))


def crf_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model with one weight per letter class and per label pair, over all distinct words."""
    weights = [(f"{c}-WORD|C", None, "V" if c in "aeiou" else "C", 1.0) for c in "abcdefghijklmnopqrstuvwxyz"]
    model = spark.createDataFrame(weights, "feature string, label_prev string, label string, weight double")
    # few bytes, but much work: without a number of tasks the adaptive plan puts them into one
    words = document_words(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = features.decode(words, model, ["C", "V"])
    return out.select("word", F.array_join(F.transform("labelled", lambda x: x["label"]), "").alias("labels"))


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letter rows of the documents' words that the ending rules segment."""
    return letters.letters(suffix_words(spark, sf_dir).select(F.col("word").alias("word_id"), F.col("seg").alias("value")))


def labelled_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model is fitted to: words with their labels, counted."""
    return fitting.labelled_words(training_rows(spark, sf_dir)).select("word", F.array_join("labels", " ").alias("labels"), "n")


def fit_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model fitted in five rounds to the labelled words of all documents, and the labels that it gives them. No SQL: see tests/test_fitting.py."""
    weights, names, _ = fitting.fit(training_rows(spark, sf_dir), rounds=5)
    words = fitting.labelled_words(training_rows(spark, sf_dir)).select("word", F.array_join("labels", " ").alias("labels"))
    found = features.decode(words, weights, names)
    return found.select("word", "labels", F.array_join(F.transform("labelled", lambda x: x["label"]), " ").alias("found"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "title_filter": title_filter, "dictionary_load": dictionary_load, "segment_endings": segment_endings, "suffix_words": suffix_words, "part_order": part_orders, "base_form": base_forms, "yot": yot,
    "align_stems": align, "template_forms": template_forms, "param_lookup": param_lookup, "segment_forms": segment_forms, "form_rejects": form_rejects, "template_misses": template_misses, "extract_template": extract_template,
    "metas": metas, "page_rejects": page_rejects, "letters": letter_rows, "letters_roundtrip": letters_roundtrip, "pivot_morphemes": pivot_morphemes, "ctx_features": ctx_features, "lexicon_features": lexicon_features,
    "conll_columns": conll_columns, "segment_conll": segment_conll, "html_tables": html_tables, "crf_decode": crf_decode,
    "labelled_words": labelled_words, "fit_model": fit_model,
}

NM = len(X.METAS)


def _keyed(select: str, rows: list[tuple], names: str, table: str = "part", key: str = "p_partkey", n: int | None = None, where: str = "") -> str:
    """SQL over a table's keys and the entries of their numbers; rows begin with the number."""
    return f"SELECT {select} FROM (SELECT {key}::BIGINT AS k FROM {table}) JOIN {X.values(rows, 'i, ' + names)} ON k % {n or len(rows)} = i {where}"


def _ending_sql(words: str, inflexions: list[str], suffixes: list[str]) -> str:
    """word, seg of a relation with column word: the ending rules over dictionary tables."""
    return f"""
WITH inf AS (SELECT unnest({X.quoted(inflexions)}) AS m), suf AS (SELECT unnest({X.quoted(suffixes)}) AS m),
w AS (SELECT word, length(word) >= 2 AND right(word, 2) IN ('ся', 'сь') AS post FROM {words}),
h AS (SELECT word, post, CASE WHEN post THEN left(word, length(word) - 2) ELSE word END AS head FROM w),
c AS (SELECT h.*, (SELECT max(length(m)) FROM inf WHERE m <> '' AND length(m) <= 3 AND suffix(head, m)) AS cut, head IN (SELECT m FROM inf) AS whole FROM h),
b AS (SELECT *, left(head, length(head) - coalesce(cut, 0)) AS stem, replace(left(head, length(head) - coalesce(cut, 0)), 'ь', '') AS bare FROM c),
s AS (SELECT b.*, bare IN (SELECT m FROM suf) AS one FROM b),
two AS (SELECT DISTINCT s.bare, min(length(x.m)) AS first_cut FROM s JOIN suf x ON starts_with(s.bare, x.m) JOIN suf y ON s.bare = x.m || y.m GROUP BY s.bare),
r AS (SELECT s.*, first_cut, CASE WHEN stem = 'ь' THEN '' WHEN one THEN 'суфф_' || s.bare WHEN first_cut IS NOT NULL THEN 'суфф_' || left(s.bare, first_cut) || ' суфф_' || substr(s.bare, first_cut + 1) END AS suff FROM s LEFT JOIN two ON s.bare = two.bare)
SELECT word, CASE WHEN post AND length(word) = 2 THEN 'частица_' || word
  WHEN whole THEN 'оконч_' || head || CASE WHEN post THEN ' частица_' || right(word, 2) ELSE '' END
  WHEN suff IS NULL THEN NULL
  ELSE trim(suff || CASE WHEN cut IS NOT NULL THEN ' оконч_' || right(head, cut) ELSE '' END || CASE WHEN post THEN ' частица_' || right(word, 2) ELSE '' END) END AS seg FROM r"""


_FORMS = [(i, value) for i, value in X.expected_forms()]
_WORDS = [(i, n, value) for i in range(NM) for n, value in enumerate(sorted(v for j, v in _FORMS if j == i))]
_WORDS_SQL = f"SELECT k * 100 + n AS word_id, value FROM (SELECT p_partkey::BIGINT AS k FROM part) JOIN {X.values(_WORDS, 'i, n, value')} ON k % {NM} = i"
_LETTERS_SQL = f"""
WITH w AS ({_WORDS_SQL}), t AS (SELECT word_id, unnest(string_split(value, ' ')) AS tok, generate_subscripts(string_split(value, ' '), 1) AS tn FROM w),
l AS (SELECT word_id, tn, split_part(tok, '_', 1) AS type, unnest(string_split(split_part(tok, '_', 2), '')) AS letter, generate_subscripts(string_split(split_part(tok, '_', 2), ''), 1) AS ln FROM t WHERE split_part(tok, '_', 2) <> '')
SELECT word_id, (row_number() OVER (PARTITION BY word_id ORDER BY tn, ln) - 1)::INTEGER AS pos, letter, type || CASE WHEN ln = 1 THEN '_начало' ELSE '' END AS label, tn FROM l"""
_SPELLED = "(SELECT DISTINCT word AS word_id, word FROM (SELECT unnest(string_split_regex(text, '[^A-Za-z]+')) AS word FROM documents) WHERE word <> '')"
_AT = f"(SELECT word_id, word, length(word) AS n, unnest(range(length(word)))::INTEGER AS pos FROM {_SPELLED})"
_P, _C, _N = "CASE WHEN pos > 0 THEN substr(word, pos, 1) ELSE '' END", "substr(word, pos + 1, 1)", "substr(word, pos + 2, 1)"
_PAGE_CODES = [(i, code) for i, (_, _, code, _) in enumerate(X.PAGES) if code]
_CALLS = [
    (0, "{{морфо||муш|к|а}}", "{{сущ ru f ina 3*a|основа=му́шк|основа1=му́шек|слоги={{по-слогам№му́ш№ка}}}}"), (1, "{{морфо||муш|к|a}}", "{{сущ ru f ina 3*a |основа=мушк\n|основа1=мушек}}"),
    (2, "{{морфо||муш|к|а}}", None), (3, "{{морфо||стол||}}", "{{сущ ru m a 1a|основа=стол}}"), (4, None, "{{сущ ru m a 1a|основа=стол}}"), (5, "{{морфо||стол|{{а№б}}}}", "{{сущ ru m a 1a|основа=стол}}"),
    (6, "{{морфо||||}}", "{{сущ ru m a 1a|основа=стол}}"), (7, "{{морфо||стол||}}", None), (8, "{{морфо||стол||}}", "{{сущ ru m a 1a}}"), (9, "{{морфо||стол||}}", "{{сущ ru m a 1a|слоги=сто-л}}"),
    (10, "{{морфо||стол||}}", "{{сущ ru m a 1a|основа=стол}}"), (11, None, None),
    (12, "{{морфо|корень1=рыб|суфф1=ʲ|оконч=а}}", "{{сущ ru m a 1a|основа=рыб}}"),
]
_ALIGNED = [(i, m[3] if m[3] in ("misaligned", "suffix_gap", "no_base_stem") else None, s) for i, m, s in (
    (i, m, {0: "корень_муш суфф_к;корень_муш суфф_ек", 1: "корень_стол", 2: "корень_стол", 3: "корень_нов", 4: "корень_рыб суфф_", 6: "корень_стол", 7: "корень_стол", 12: "корень_да"}.get(i)) for i, m in enumerate(X.METAS)) if m[4]]
_LINES = r"(SELECT doc_id AS doc, unnest(string_split(text, E'\n')) AS line, generate_subscripts(string_split(text, E'\n'), 1) AS ln FROM documents)"
_TOKENS = rf"(SELECT doc, ln, unnest(w) AS w, unnest(range(len(w))) AS k FROM (SELECT doc, ln, list_filter(string_split_regex(line, '\s+'), lambda x: x <> '') AS w FROM {_LINES}))"

#: White space of any script.
_BLANK = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

ORACLE_SQL: dict[str, str] = {
    "title_filter": rf"SELECT page_id, url FROM pages WHERE regexp_matches(url, '^(?:{URL_PATTERN})')",
    "dictionary_load": rf"""
WITH l AS (SELECT unnest(string_split(text, E'\n')) AS v FROM documents UNION ALL SELECT v FROM {X.values([(x,) for x in X.DICTIONARY], 'v')}), t AS (SELECT regexp_replace(v, '^{_BLANK}+|{_BLANK}+$', '', 'g') AS v FROM l), f AS (SELECT DISTINCT v FROM t WHERE v <> '' AND NOT starts_with(v, '#'))
SELECT v AS value, 'raw' AS kind FROM f UNION ALL SELECT DISTINCT translate(v, 'ьъ', ''), 'bare' FROM f""",
    "segment_endings": f"WITH e AS ({_keyed('k, word', [(i, e) for i, (e, _) in enumerate(X.ENDINGS)], 'word')}), s AS ({_ending_sql('(SELECT DISTINCT word FROM e)', default_inflexions(), default_suffixes())}) SELECT k, e.word AS ending, s.seg AS seg_ending FROM e JOIN s ON e.word = s.word",
    "suffix_words": f"SELECT * FROM ({_ending_sql(WORDS_SQL, LATIN_INFLEXIONS, LATIN_SUFFIXES)}) WHERE seg IS NOT NULL",
    "part_order": _keyed("k, name, ord::INTEGER AS ord, tag", [(i, *r) for i, r in enumerate(X.NAMES)], "name, ord, tag"),
    "base_form": _keyed("k, morfo, base", [(i, m[0], m[4]) for i, m in enumerate(X.METAS) if m[4]], "morfo, base", n=NM),
    "yot": _keyed("k, morfo, fixed, compatible", [(i, *r) for i, r in enumerate(X.YOTS)], "morfo, fixed, compatible"),
    "align_stems": _keyed("k, err, stems", _ALIGNED, "err, stems", n=NM),
    "template_forms": rf"WITH f AS (SELECT DISTINCT template_name, unnest(regexp_extract_all(value, '\{{\{{\{{[^ ]+\}}\}}\}}[а-яёй]*')) AS f FROM {X.values(list(X.TABLES.items()), 'template_name, value')}) SELECT template_name, regexp_extract(f, '^(.*\}})([^}}]*)$', 1) AS parameter, regexp_extract(f, '^(.*\}})([^}}]*)$', 2) AS ending FROM f" + f""" UNION ALL SELECT DISTINCT 'doc ' || doc_id, '{{{{{{' || w || '}}}}}}', ({X.quoted(list(X.CELL_ENDINGS))})[length(w) % {len(X.CELL_ENDINGS)} + 1] FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM documents) WHERE w <> ''""",
    "param_lookup": f"""WITH s AS ({_keyed("k, stems, string_split(stems, ';') AS a, named", [(i, s, int("=" in X.METAS[i][2][0])) for i, e, s in _ALIGNED if s], "stems, named", n=NM)})
SELECT k, a[1] AS first, CASE WHEN named = 1 THEN coalesce(a[2], a[1]) END AS stem1, coalesce(CASE WHEN named = 1 THEN a[1] END, a[1]) AS with_default FROM s""",
    "segment_forms": _keyed("k, value", _FORMS, "value", n=NM),
    "form_rejects": f"SELECT code, count(*) AS n FROM ({_keyed('code', [(i, m[3]) for i, m in enumerate(X.METAS) if m[3]], 'code', n=NM)}) GROUP BY code",
    "template_misses": f"WITH m AS ({_keyed('k, template_name', [(i, m[1]) for i, m in enumerate(X.METAS)], 'template_name')}) SELECT k, template_name FROM m ANTI JOIN {X.values([(t,) for t in X.TABLES], 'template_name')} USING (template_name)",
    "extract_template": _keyed("k, morfo, call", _CALLS, "morfo, call", "customer", "c_custkey"),
    "metas": _keyed("k, morfo, template_name, array_to_string(stems, ';') AS stems", [(i, *X.METAS[m][:3]) for i, (_, _, _, m) in enumerate(X.PAGES) if m is not None], "morfo, template_name, stems", "customer", "c_custkey", len(X.PAGES)),
    "page_rejects": f"SELECT code, count(*) AS n FROM ({_keyed('code', _PAGE_CODES, 'code', 'customer', 'c_custkey', len(X.PAGES))}) GROUP BY code",
    "letters": f"SELECT word_id, pos, letter, label FROM ({_LETTERS_SQL})",
    "letters_roundtrip": f"SELECT word_id, string_agg(m, ' ' ORDER BY tn) AS value FROM (SELECT word_id, tn, replace(min(label), '_начало', '') || '_' || string_agg(letter, '' ORDER BY pos) AS m FROM ({_LETTERS_SQL}) GROUP BY word_id, tn) GROUP BY word_id",
    "pivot_morphemes": "SELECT word_id, " + ", ".join(f"coalesce(string_agg(part, '|' ORDER BY tn) FILTER (type = '{t}'), '_') AS {n}" for t, n in zip(conllx.COLUMNS, ("prist", "koren", "suff", "okonch"), strict=True)) + f" FROM (SELECT word_id, tn, replace(min(label), '_начало', '') AS type, string_agg(letter, '' ORDER BY pos) AS part FROM ({_LETTERS_SQL}) GROUP BY word_id, tn) GROUP BY word_id",
    "ctx_features": f"SELECT word_id, pos, unnest(list_distinct([{_P} || '-' || {_C} || '-PWORD-WORD', {_C} || '-WORD', {_C} || '-' || {_N} || '-WORD-NWORD', pos || '-POSITION', (n - pos) || '-BACK-POSITION'])) || '|C' AS feature FROM {_AT}",
    "lexicon_features": f"""
WITH lex AS (SELECT * FROM {X.values([(m, "end") for m in LATIN_INFLEXIONS if m] + [(m, "mid") for m in LATIN_SUFFIXES], "m, type")}), places AS (SELECT * FROM {_AT}),
hit AS (SELECT word_id, pos, 'START' AS side, m, type FROM places JOIN lex ON substr(word, pos + 1, length(m)) = m UNION SELECT word_id, pos, 'END', m, type FROM places JOIN lex ON pos >= length(m) AND substr(word, pos - length(m) + 1, length(m)) = m),
f AS (SELECT word_id, pos, {_P} || '-' || {_C} || '-PWORD-WORD' AS f FROM places UNION SELECT word_id, pos, {_C} || '-' || {_N} || '-WORD-NWORD' FROM places
  UNION SELECT word_id, pos, side || '-OF-' || m || '-MORPHEME' FROM hit UNION SELECT word_id, pos, side || '-OF-' || type || '-TYPE-MORPHEME' FROM hit)
SELECT word_id, pos, f || '|CpC' AS feature FROM f""",
    "conll_columns": f"""
WITH t AS {_TOKENS}, ok AS (SELECT * FROM t WHERE k % 11 <> 5), p AS (SELECT doc, count(*) AS parts FROM (SELECT doc, unnest(string_split_regex(w, '[ -]')) AS p FROM ok WHERE k % 7 <> 3) WHERE length(p) >= 2 GROUP BY doc)
SELECT g.doc, g.sentences, g.tokens, coalesce(p.parts, 0)::BIGINT AS parts, g.bad FROM (SELECT doc, count(DISTINCT ln) FILTER (k % 11 <> 5) AS sentences, count(*) FILTER (k % 11 <> 5) AS tokens, count(*) FILTER (k % 11 = 5) AS bad FROM t GROUP BY doc HAVING count(*) FILTER (k % 11 <> 5) > 0) g LEFT JOIN p ON g.doc = p.doc""",
    "segment_conll": rf"""
WITH t AS (SELECT *, CASE WHEN k % 7 = 3 THEN '' ELSE array_to_string(flatten(list_transform(list_filter(string_split_regex(w, '[ -]'), lambda p: length(p) >= 2 AND NOT regexp_matches(p, '^[aeiou]')), lambda p: regexp_extract_all(p, '[^aeiou][aeiou]*'))), '|') END AS m FROM {_TOKENS} WHERE k % 11 <> 5),
l AS (SELECT *, concat_ws(E'\t', k + 1, w, w, 'N', CASE WHEN k % 7 = 3 THEN 'PR' ELSE 'N' END, '_', '_', CASE WHEN m = '' THEN '_' ELSE m END, '_', '_', '', '0', 'root', '_', '_') AS line FROM t)
SELECT doc, count(*) AS tokens, count(*) FILTER (m <> '') AS segmented, md5(string_agg(line, E'\n' ORDER BY ln, k)) AS lines_md5 FROM l GROUP BY doc""",
    "html_tables": rf"""
WITH c AS (SELECT page_id, page_id::VARCHAR AS template_name, list_transform([url, html], lambda x: trim(replace(replace(regexp_replace(coalesce(x, ''), '{CONTROLS}', '', 'g'), E'\r\n', E'\n'), E'\r', E'\n'), E' \t\n')) AS cells FROM pages)
SELECT template_name, array_to_string(list_transform(list_filter(cells, lambda x: x <> ''), lambda x: x || ' |'), ' ') || E'\npl. | {{{{{{s}}}}}}i |\n' AS value FROM c WHERE page_id % 5 <> 4""",
    "labelled_words": f"""
WITH s AS (SELECT word AS id, string_split(seg, ' ') AS toks FROM ({_ending_sql(WORDS_SQL, LATIN_INFLEXIONS, LATIN_SUFFIXES)}) WHERE seg IS NOT NULL),
t AS (SELECT id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS tn FROM s), p AS (SELECT id, tn, split_part(tok, '_', 1) AS type, split_part(tok, '_', 2) AS part FROM t)
SELECT word, labels, count(*) AS n FROM (SELECT string_agg(part, '' ORDER BY tn) AS word, string_agg(type || '_начало' || repeat(' ' || type, length(part)::BIGINT - 1), ' ' ORDER BY tn) AS labels FROM p WHERE part <> '' GROUP BY id) GROUP BY word, labels""",
    "crf_decode": f"SELECT word, regexp_replace(regexp_replace(word, '[aeiou]', 'V', 'g'), '[a-z]', 'C', 'g') AS labels FROM {WORDS_SQL}",
}

def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_forms(spark, sf_dir)
