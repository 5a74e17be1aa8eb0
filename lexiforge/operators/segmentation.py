"""Word forms: base form, stems and template put together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.base_form import base_form
from ..functions.stems import align_stems, parameters, placeholder
from ..functions.text import computed, let

#: Unicode classes are needed: plain \w knows no Cyrillic.
GRAMMAR = r"(?U)^\w+_[\w-]+( \w+_[\w-]*)* *$"
#: Up to so many templates, and rows of theirs in all, are broadcast: their names are few and hot.
BROADCAST_TEMPLATES, BROADCAST_FORMS = 20_000, 400_000


def sized(templates: DataFrame) -> DataFrame:
    """templates with a broadcast hint if they are few: a hot name then needs no shuffle of its words. One aggregation counts them and their forms."""
    n, forms = templates.agg(F.count(F.lit(1)), F.sum(F.coalesce(F.size("forms"), F.lit(0)))).first()
    return F.broadcast(templates) if n <= BROADCAST_TEMPLATES and (forms or 0) <= BROADCAST_FORMS else templates


def rendered(metas: DataFrame, templates: DataFrame, compatible: bool = False) -> DataFrame:
    """metas (morfo, template_name, stems, ...) with forms (array of segmentations) and err; one row per meta.

    templates: template_name, poisoned, forms. The join is an equality on the name; Spark broadcasts the templates where it knows
    them to be small. A word that lacks one placeholder's value gives no form at all.
    """
    step = metas.join(templates.select("template_name", "poisoned", F.col("forms").alias("_forms")), "template_name", "left")
    step = step.withColumn("_missing", F.when(F.col("poisoned").isNull(), "template_missing").when(F.col("poisoned"), "template_poisoned"))
    step = computed(step, "_base", F.when(F.col("_missing").isNull(), base_form(F.col("morfo"), compatible)))
    step = computed(step, "_stems", F.when(F.col("_missing").isNull() & F.col("_base.err").isNull(), align_stems(F.col("stems"), F.col("_base.parts"))))
    first = F.coalesce("_missing", F.col("_base.err"), F.col("_stems.err"))
    fill = lambda params: F.transform("_forms", lambda f: F.concat(placeholder(params, f["parameter"]), F.lit(" "), f["seg_ending"]))
    step = computed(step, "_filled", F.when(first.isNull(), let(parameters(F.col("_stems.stems")), fill)))
    unknown = F.when(F.exists("_filled", lambda f: f.isNull()), "unknown_placeholder")
    step = computed(step, "_done", F.struct(F.coalesce(first, unknown).alias("err"), F.when(unknown.isNull(), F.col("_filled")).alias("forms")))
    return step.select(*metas.columns, "_done.forms", "_done.err")


def forms_of(done: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep columns of rendered() rows, and value: a row for each segmented form that fits the output grammar."""
    out = done.select(*keep, F.explode("forms").alias("value"))
    return out.where(F.col("value").rlike(GRAMMAR))


def segmentations(metas: DataFrame, templates: DataFrame, compatible: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """forms_of() of metas and templates."""
    return forms_of(rendered(metas, templates, compatible), keep)


def rejects(metas: DataFrame, templates: DataFrame, compatible: bool = False) -> DataFrame:
    """rejects_of() of metas and templates."""
    return rejects_of(rendered(metas, templates, compatible))


#: What rejects_of() may say.
CODES = (
    "template_missing", "template_poisoned", "suffix_gap", "misaligned", "leftover", "no_base_stem", "bad_stem_param", "unknown_placeholder", "bad_grammar", "too_many_positional", "unknown_part_name", "bad_yot", "no_root", "bad_morpheme",
)


def rejects_of(done: DataFrame) -> DataFrame:
    """stage, code, detail, key of rendered() rows: words without forms, and forms outside the grammar."""
    stage = F.when(F.col("err").startswith("template"), "template").when(F.col("err").isin("suffix_gap", "misaligned", "leftover", "no_base_stem", "bad_stem_param"), "stems").when(F.col("err") == "unknown_placeholder", "render").otherwise("base form")
    words = done.where(F.col("err").isNotNull()).select(stage.alias("stage"), F.col("err").alias("code"), F.col("template_name").alias("detail"), F.col("morfo").alias("key"))
    forms = done.select("morfo", F.explode("forms").alias("value")).where(~F.col("value").rlike(GRAMMAR))
    return words.unionByName(forms.select(F.lit("render").alias("stage"), F.lit("bad_grammar").alias("code"), F.col("value").alias("detail"), F.col("morfo").alias("key")))
