"""Meta-segmentations of dictionary pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.calls import call_name, template_call

# What calls, titles, words and stems look like.
MORFO = r"\{\{морфо"
TABLE = r"\{\{(прич|сущ|гл|мест|прил|числ) ru "
TEMPLATE_TITLE = "Шаблон:(прич|сущ|гл|мест|прил|числ) ru"
WORD = "[А-ЯЁ]?[а-яё]+"
STRANGE = r"[^}{а-яёйj1-5|=-]"
EMPTY = r"^\{\{морфо(\|+[а-я-]+[1-5]?=)+\}\}|^\{\{морфо\|+\}\}"
STEM = r"^основа[1-5]?=[а-яёй-]+|^[а-яёй-]+$"


def pages_by_title(pages: DataFrame, pattern: str, title: str = "title") -> DataFrame:
    """Pages whose title begins with a match of the pattern."""
    return pages.where(T.matches_start(F.col(title), pattern))


def parsed_pages(pages: DataFrame) -> DataFrame:
    """pages (title, text) with morfo, template_name, stems and err (the first test that a page fails, null for a meta).

    Tests go from cheap to dear; later columns are null where an earlier test failed.
    """
    word = T.drop_stress(F.col("title"))
    fits = (F.coalesce(F.length("text"), F.lit(0)) > 0) & F.coalesce(T.matches_start(word, WORD), F.lit(False))
    step = T.computed(pages, "_section", F.when(fits, T.drop_stress(T.section(F.col("text")), grave=True)))
    call = F.when(F.col("_section").isNotNull(), template_call(F.col("_section"), MORFO))
    step = T.computed(step, "morfo", F.translate(T.cyrillic_letters(T.squeeze(F.lower(call))), "ʲ", "j"))
    bad = F.when(F.col("morfo").rlike(STRANGE), "strange_symbols").when(F.col("morfo").rlike(EMPTY), "empty_morfo")
    step = T.computed(step, "_bad", bad)
    step = T.computed(step, "_table", F.when(F.col("morfo").isNotNull() & F.col("_bad").isNull(), template_call(F.col("_section"), TABLE)))
    args = T.cyrillic_letters(T.squeeze(F.lower(F.expr("substring(_table, 3, length(_table) - 4)"))))
    stems = T.let(F.split(args, r"\|"), lambda p: F.filter(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda x: x.rlike(STEM)))
    step = T.computed(T.computed(step, "template_name", call_name(F.col("_table"))), "stems", stems)
    err = (
        F.when(~fits, "empty_or_not_russian").when(F.col("_section").isNull(), "no_ru_section").when(F.col("morfo").isNull(), "no_morfo").when(F.col("_bad").isNotNull(), F.col("_bad"))
        .when(F.col("_table").isNull(), "no_table_call").when(F.col("template_name").isNull(), "no_pipe").when(F.size("stems") == 0, "no_stems")
    )
    return step.select(*pages.columns, "morfo", "template_name", "stems", err.alias("err"))


def metas_of(parsed: DataFrame) -> DataFrame:
    """morfo, template_name, stems of parsed_pages() rows that give one."""
    return parsed.where(F.col("err").isNull()).select("morfo", "template_name", "stems")


def metas(pages: DataFrame) -> DataFrame:
    """morfo, template_name, stems of every page that gives one."""
    return metas_of(parsed_pages(pages))


#: What page_rejects() may say.
CODES = ("empty_or_not_russian", "no_ru_section", "no_morfo", "strange_symbols", "empty_morfo", "no_table_call", "no_pipe", "no_stems")


def rejects_of(parsed: DataFrame) -> DataFrame:
    """stage, code, detail, key of parsed_pages() rows that give no meta."""
    return parsed.where(F.col("err").isNotNull()).select(F.lit("page").alias("stage"), F.col("err").alias("code"), F.col("morfo").alias("detail"), F.col("title").alias("key"))


def page_rejects(pages: DataFrame) -> DataFrame:
    """stage, code, detail, key of every page that gives none."""
    return rejects_of(parsed_pages(pages))
