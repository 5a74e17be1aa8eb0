"""Inflexion templates: forms of table texts with segmented endings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.endings import segment_ending, segment_endings
from ..functions.text import drop_stress

# Fixed value: a placeholder and the ending that follows it.
FORM = r"(\{\{\{[^ ]+\}\}\})([а-яёй]*)"


def template_forms(tables: DataFrame, pattern: str = FORM) -> DataFrame:
    """template_name, parameter, ending: the distinct forms of (template_name, value)."""
    hits = F.array_distinct(F.regexp_extract_all(drop_stress(F.col("value")), F.lit(pattern), F.lit(0)))
    # a template's forms travel as one array: its name is not repeated with each, and mostly one text holds them all
    per = tables.select("template_name", hits.alias("hits")).groupBy("template_name").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    forms = per.select("template_name", F.explode(F.array_distinct("hits")).alias("form"))
    out = forms.select("template_name", F.regexp_extract("form", pattern, 1).alias("parameter"), F.regexp_extract("form", pattern, 2).alias("ending"))
    # FORM's two groups are the whole form, so they differ where forms do
    return out if pattern == FORM else out.dropDuplicates()


Words = Iterable[str] | DataFrame | None


def segmented_forms(forms: DataFrame, inflexions: Words = None, suffixes: Words = None) -> DataFrame:
    """forms with seg_ending, null where an ending cannot be segmented. Dictionaries are lists, which become part of the plan, or tables (value) of any size, which are joined."""
    if not (isinstance(inflexions, DataFrame) or isinstance(suffixes, DataFrame)):
        return forms.withColumn("seg_ending", segment_ending(F.col("ending"), inflexions, suffixes))
    table = lambda words: words if words is None or isinstance(words, DataFrame) else forms.sparkSession.createDataFrame([(w,) for w in words], "value string")
    return forms.join(segment_endings(forms, table(inflexions), table(suffixes)), "ending", "left").select(*forms.columns, "seg_ending")


def usable_templates(forms: DataFrame) -> DataFrame:
    """template_name, poisoned, forms (array of parameter and seg_ending): one unsegmented ending spoils its whole template."""
    per = forms.groupBy("template_name").agg(F.bool_or(F.col("seg_ending").isNull()).alias("poisoned"), F.array_sort(F.collect_set(F.struct("parameter", "seg_ending"))).alias("forms"))
    return per.withColumn("forms", F.when(~F.col("poisoned"), F.col("forms")))


def templates(tables: DataFrame, inflexions: Words = None, suffixes: Words = None) -> DataFrame:
    return usable_templates(segmented_forms(template_forms(tables), inflexions, suffixes))


def template_misses(metas: DataFrame, tables: DataFrame) -> DataFrame:
    """The rows of metas whose template has no table."""
    return metas.join(tables.select("template_name").distinct(), "template_name", "left_anti")
