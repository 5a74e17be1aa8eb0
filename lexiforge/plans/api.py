"""The steps as whole plans: pages, tables, metas, segmentations, letters, morpheme columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import computed
from ..operators import conll_arrays, conllx, features, letters
from ..operators import segmentation as seg
from ..operators import wikitext
from ..operators.templates import Words, templates
from ..sources import dumps, html_tables, texts


def pages(spark: SparkSession, dump: str, pattern: str) -> DataFrame:
    return wikitext.pages_by_title(dumps.read_pages(spark, dump), pattern)


def table_answers(spark: SparkSession, dump: str, fetch: html_tables.Fetch, connections: int = 1) -> DataFrame:
    """html_tables.ANSWERS of every inflexion template of a dump. Its titles are few, and each is asked for whenever this is executed: keep it (sinks.write_answers()) before it is read twice."""
    return html_tables.answers(pages(spark, dump, wikitext.TEMPLATE_TITLE), fetch, connections)


def metas(spark: SparkSession, dump: str) -> DataFrame:
    return wikitext.metas(dumps.read_pages(spark, dump))


def rendered_forms(metas_: DataFrame, table_texts: DataFrame, inflexions: Words = None, suffixes: Words = None, compatible: bool = False) -> DataFrame:
    """segmentation.rendered() of metas and table texts. Both outputs of segment() come from it: keep it if both are read."""
    return seg.rendered(metas_, seg.sized(templates(table_texts, inflexions, suffixes)), compatible)


def segment(metas_: DataFrame, table_texts: DataFrame, inflexions: Words = None, suffixes: Words = None, compatible: bool = False) -> tuple[DataFrame, DataFrame]:
    """(segmentations, rejects)."""
    done = rendered_forms(metas_, table_texts, inflexions, suffixes, compatible)
    return seg.forms_of(done), seg.rejects_of(done)


def to_letters(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """doc, word_id, value: letter rows per word."""
    words = texts.segmentations(spark, path)
    # the file goes with the word's id, so that ids are made once
    named = words.withColumn("word_id", F.struct("doc", "word_id"))
    return letters.conll_text(letters.letters(named)).select("word_id.doc", "word_id.word_id", "value")


def segment_conll(spark: SparkSession, path: str | list[str], weights: DataFrame, labels: list[str], begin: str = letters.BEGIN, partitions: int | None = None, compatible: bool = False, lexicon: DataFrame | None = None, fail_fast: bool = False) -> DataFrame:
    """doc, sent_id, line_no and the fields of CoNLL-X files with morpheme columns."""
    lines = conllx.sentences(texts.whole_files(spark, path))
    return segment_lines(lines, weights, labels, begin, compatible, lexicon, fail_fast, partitions=partitions)


def segment_lines(lines: DataFrame, weights: DataFrame, labels: list[str], begin: str = letters.BEGIN, compatible: bool = False, lexicon: DataFrame | None = None, fail_fast: bool = False, features_: features.Factory | None = None, partitions: int | None = None) -> DataFrame:
    """segment_conll() for lines (doc, sent_id, line_no, line).

    A form whose labels do not begin a morpheme leaves its columns empty. Lines without ten fields raise an error, or are left out.
    The lines are made and dealt out once: the distinct forms and the tokens that get their columns read the same exchange. Each form is decoded once.
    """
    # few bytes, but much work: without a number of tasks the adaptive plan puts them into one
    tasks = partitions or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tokens = conllx.parse(lines.select("doc", "sent_id", "line_no", "line").repartition(tasks, "doc", "sent_id", "line_no"), fail_fast)
    forms = tokens.where(conllx.is_word()).select("form").distinct().repartition(tasks)
    parts = forms.select("form", F.posexplode(conllx.parts(F.col("form"))).alias("part_no", "word"))
    spelled = features.decode(parts, weights, labels, lexicon, features_)
    found = computed(spelled, "r", letters.reconstruct(F.col("labelled"), begin)).where(F.col("r.err").isNull())
    return conllx.with_form_morphemes(tokens, found.select("form", "part_no", "r.morphemes"), compatible)


def segment_documents(texts_: DataFrame, weights: DataFrame, labels: list[str], begin: str = letters.BEGIN, compatible: bool = False, lexicon: DataFrame | None = None, fail_fast: bool = False, features_: features.Factory | None = None) -> DataFrame:
    """doc, lines (conll_arrays.LINES, in order) of documents (doc, values: its texts), one row each; those without tokens are left out.

    A model and a lexicon that executors can hold segment each document where it is: nothing is shuffled. Larger ones, and features of one's own, go by segment_lines().
    """
    tables = features.tables_of(weights, labels, lexicon) if features_ is None else None
    if tables is not None:
        shared = texts_.sparkSession.sparkContext.broadcast(conll_arrays.Segmenter(*tables, begin, compatible))
        return computed(texts_.select("doc", "values"), "lines", conll_arrays.segmented(F.col("values"), shared, fail_fast)).where(F.size("lines") > 0).select("doc", "lines")
    lines = conllx.sentences(texts_.select("doc", F.explode("values").alias("value")))
    done = segment_lines(lines, weights, labels, begin, compatible, lexicon, fail_fast, features_)
    filled = F.exists(F.array(*conllx.COLUMNS), lambda c: c != "_")
    per = done.select("doc", F.struct("sent_id", "line_no", conllx.line().alias("line"), filled.alias("segmented")).alias("l")).groupBy("doc")
    return per.agg(F.array_sort(F.collect_list("l")).alias("lines"))
