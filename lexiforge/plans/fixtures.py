"""Synthetic wiki data for the registered queries: the driver's tables hold no wikitext, so each row of a table
stands for one of these entries, by its key modulo their number. Both sides of a comparison build the same rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.conll_arrays import blocks

TABLES = {
    "сущ ru f ina 3*a": "{{{основа}}}а | {{{основа}}}и |\n{{{основа}}}е | {{{основа}}}у |\n{{{основа}}}ой | {{{основа1}}} |\n{{{основа}}}ам | {{{основа}}}ами |\n{{{основа}}}ах |\n",
    "сущ ru m a 1a": "{{{основа}}} | {{{основа}}}а |\n{{{основа}}}у | {{{основа}}}ом |\n{{{основа}}}е | {{{основа}}}ы |\n{{{основа}}}ов | {{{основа}}}а |\n",
    "прил ru 1a": "{{{основа|{{{1}}}}}}ый | {{{основа|{{{1}}}}}}ого |\n{{{основа|{{{1}}}}}}ая | {{{основа|{{{1}}}}}}ое |\n",
    "гл ru 1a": "{{{основа}}}ть | {{{основа}}}ла |\n{{{основа}}}лась | {{{основа}}}ющий |\n",
    "гл ru bad": "{{{основа}}}пф | {{{основа}}}а |\n",
}
#: parameter, ending, segmented ending of each table (null: not to be segmented)
FORMS = [
    *(("сущ ru f ina 3*a", "{{{основа}}}", e, f"оконч_{e}") for e in ("а", "и", "е", "у", "ой", "ам", "ами", "ах")),
    ("сущ ru f ina 3*a", "{{{основа1}}}", "", "оконч_"),
    *(("сущ ru m a 1a", "{{{основа}}}", e, f"оконч_{e}") for e in ("", "а", "у", "ом", "е", "ы", "ов")),
    *(("прил ru 1a", "{{{основа|{{{1}}}}}}", e, f"оконч_{e}") for e in ("ый", "ого", "ая", "ое")),
    ("гл ru 1a", "{{{основа}}}", "ть", "оконч_ть"),
    ("гл ru 1a", "{{{основа}}}", "ла", "суфф_л оконч_а"),
    ("гл ru 1a", "{{{основа}}}", "лась", "суфф_л оконч_а частица_сь"),
    ("гл ru 1a", "{{{основа}}}", "ющий", "суфф_ющ оконч_ий"),
    ("гл ru bad", "{{{основа}}}", "пф", None),
    ("гл ru bad", "{{{основа}}}", "а", "оконч_а"),
]
#: morpheme call, template, stems, reject code (null: none), base form, stems of the segmented forms by placeholder
METAS = [
    ("{{морфо||муш|к|а}}", "сущ ru f ina 3*a", ["основа=мушк", "основа1=мушек"], None, "корень_муш суфф_к оконч_а", {"{{{основа}}}": "корень_муш суфф_к", "{{{основа1}}}": "корень_муш суфф_ек"}),
    ("{{морфо||стол||}}", "сущ ru m a 1a", ["основа=стол"], None, "корень_стол", {"{{{основа}}}": "корень_стол"}),
    ("{{морфо||стол||}}", "сущ ru m a 1a", ["стол"], "unknown_placeholder", "корень_стол", {}),
    ("{{морфо||нов||ый}}", "прил ru 1a", ["нов"], None, "корень_нов оконч_ый", {"{{{основа|{{{1}}}}}}": "корень_нов"}),
    ("{{морфо|корень1=рыб|суфф1=j|оконч=а}}", "сущ ru m a 1a", ["основа=рыб"], None, "корень_рыб суфф_ оконч_я", {"{{{основа}}}": "корень_рыб суфф_"}),
    ("{{морфо|при|||}}", "сущ ru m a 1a", ["основа=при"], "no_root", None, {}),
    ("{{морфо||стол||}}", "нет ru x", ["основа=стол"], "template_missing", "корень_стол", {}),
    ("{{морфо||стол||}}", "гл ru bad", ["основа=стол"], "template_poisoned", "корень_стол", {}),
    ("{{морфо||муш|к|а}}", "сущ ru f ina 3*a", ["основа=мушк", "основа1=топ"], "misaligned", "корень_муш суфф_к оконч_а", {}),
    ("{{морфо||муш|к|а}}", "сущ ru f ina 3*a", ["основа=мушабвг"], "suffix_gap", "корень_муш суфф_к оконч_а", {}),
    ("{{морфо||муш|к|а}}", "сущ ru f ina 3*a", ["мушек"], "no_base_stem", "корень_муш суфф_к оконч_а", {}),
    ("{{морфо||добр|ибелен|}}", "прил ru 1a", ["добр"], "bad_morpheme", None, {}),
    ("{{морфо||да||ть}}", "гл ru 1a", ["основа=да"], None, "корень_да оконч_т", {"{{{основа}}}": "корень_да"}),
]
#: title, text, code (null: the page gives the meta of this number)
PAGES = [
    ("му́шка", "= {{-ru-}} =\n{{сущ ru f ina 3*a|основа=му́шк|основа1=му́шек|слоги={{по-слогам|му́ш|ка}}}}\n{{морфо||муш|к|а}}\n{{-uk-}} {{морфо||не|то|}}", None, 0),
    ("мушка", "{{-ru-}} {{сущ ru f ina 3*a |основа=мушк\n|основа1=мушек}} {{Морфо||нет}} {{морфо||муш|к|a}}", None, 0),
    ("word", "{{-ru-}} {{морфо||муш|к|а}}", "empty_or_not_russian", None),
    ("стол", "{{морфо||стол||}} {{сущ ru m a 1a|основа=стол}}", "no_ru_section", None),
    ("стол", "{{-ru-}} {{сущ ru m a 1a|основа=стол}} {{морфо||стол", "no_morfo", None),
    ("стол", "{{-ru-}} {{морфо||стол|{{а|б}}}} {{сущ ru m a 1a|основа=стол}}", "strange_symbols", None),
    ("стол", "{{-ru-}} {{морфо||||}} {{сущ ru m a 1a|основа=стол}}", "empty_morfo", None),
    ("стол", "{{-ru-}} {{морфо||стол||}}", "no_table_call", None),
    ("стол", "{{-ru-}} {{морфо||стол||}} {{сущ ru m a 1a}}", "no_pipe", None),
    ("стол", "{{-ru-}} {{морфо||стол||}} {{сущ ru m a 1a|слоги=сто-л}}", "no_stems", None),
    ("Стол", "{{-en-}} x {{-ru-}} {{сущ ru m a 1a|основа=стол}} {{морфо||стол||}}", None, 1),
    ("стол", "", "empty_or_not_russian", None),
    ("рыба", "{{-ru-}} {{сущ ru m a 1a|основа=рыб}} {{морфо|корень1=рыб|суфф1=ʲ|оконч=а}}", None, 4),
]
#: lines of a dictionary
DICTIONARY = ("# note", "", "ам", "ам", " ым ", "подъ", "ь", "тель", "ель\t", "ъ", "\u00a0ом\u2003")
#: endings of the cells that queries make from words
CELL_ENDINGS = ("", "а", "ами", "ого", "ё")
#: ending, segmented ending
ENDINGS = [
    ("", "оконч_"), ("ом", "оконч_ом"), ("ся", "частица_ся"), ("тся", "суфф_т частица_ся"), ("лась", "суфф_л оконч_а частица_сь"), ("ющий", "суфф_ющ оконч_ий"), ("вшись", "суфф_вш оконч_и частица_сь"),
    ("ть", "оконч_ть"), ("ь", ""), ("ью", "оконч_ю"), ("ьми", "оконч_ми"), ("айте", "суфф_а оконч_йте"), ("ованный", "суфф_ова суфф_нн оконч_ый"), ("пф", None),
]
#: parts (type, part) before and after, in the fixed and the compatible mode (null: an error)
YOTS = [
    ("{{морфо||боj||}}", "корень_бой", "корень_бой"),
    ("{{морфо||змеj||а}}", "корень_зме оконч_я", "корень_зме оконч_я"),
    ("{{морфо||рыб|j|а}}", "корень_рыб суфф_ оконч_я", "корень_рыб суфф_ оконч_я"),
    ("{{морфо||дом||нj}}", "корень_дом оконч_нь", "корень_дом оконч_нь"),
    ("{{морфо||j||}}", None, None),
    ("{{морфо||jад||}}", "корень_яд", "корень_jад"),
    ("{{морфо||моёj||}}", "корень_моёй", "корень_моё"),
    ("{{морфо||jаjа||}}", None, None),
]
#: argument name, order, tag
NAMES = [
    ("префд7", 7, "префд"), ("префдx", None, None), ("прист2", 12, "прист"), ("прис1", 11, "прист"), ("прист", 10, "прист"), ("корень", 20, "корень"), ("корен", 20, "корень"), ("корень1", 20, "корень"), ("суфф-3", 33, "суфф"),
    ("оконч-1", 40, "оконч"), ("соед", 50, "соед"), ("прист22", 62, "прист"), ("корень2", 70, "корень"), ("суфф-24", 84, "суфф"), ("соед2", 90, "соед"), ("прист31", 101, "прист"), ("корень3", 110, "корень"), ("интер", 120, "интер"),
    ("суффд1", 130, "суффд"), ("суф1", 141, "суфф"), ("суфф5", 145, "суфф"), ("суфф", 140, "суфф"), ("окончание", 150, "оконч"), ("част", 160, "частица"), ("постфикс", 160, "частица"), ("корень4", None, None), ("прист4", None, None),
]


def quoted(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, (int, float)):
        return str(x)
    if isinstance(x, list):
        return "[" + ", ".join(map(quoted, x)) + "]"
    return "'" + str(x).replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    """A VALUES list in parentheses, for DuckDB."""
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + f") t({names}))"


def table_texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TABLES.items()), "template_name string, value string")


def by_key(spark: SparkSession, sf_dir: str, table: str, key: str, rows: list[tuple], schema: str) -> DataFrame:
    """Every row of a table by its key, with the entry of its number: k, then the columns of schema."""
    entries = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_i int, " + schema)
    # few bytes, but much work: a million keys are a row group or two, which would be as many tasks
    keys = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).cast("long").alias("k")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the entries are a literal list of this module
    return keys.join(F.broadcast(entries), F.pmod("k", F.lit(len(rows))) == F.col("_i")).drop("_i")


def metas_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_key(spark, sf_dir, "part", "p_partkey", [(m[0], m[1], m[2]) for m in METAS], "morfo string, template_name string, stems array<string>")


def pages_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_key(spark, sf_dir, "customer", "c_custkey", [(p[0], p[1]) for p in PAGES], "title string, text string")


def conll_text(texts: pa.Array) -> pa.Array:
    """CoNLL-X texts of texts: a sentence per line that is not blank, a token per word, one of the ten fields empty now and then."""
    rows = pc.split_pattern(texts, "\n")
    words = pc.split_pattern_regex(rows.flatten(), r"[ \t\x0b\f\r]+")
    word, line = words.flatten(), pc.list_parent_indices(words).to_numpy()
    full = pc.not_equal(word, "")
    word, line = word.filter(full), line[full.to_numpy(zero_copy_only=False)]
    ends = np.cumsum(np.bincount(line, minlength=len(words)))
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    k = np.arange(len(line)) - offsets[line]
    pos, head = (pa.array(names).take(pa.array(at.astype(np.int64))) for names, at in ((["N", "PR"], k % 7 == 3), (["root", ""], k % 11 == 5)))
    tokens = pc.binary_join_element_wise(pa.array(k + 1).cast(pa.string()), word, word, "N", pos, "_", "0", head, "_", "_", "\t")
    sentences = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), tokens), "\n")
    lengths = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), sentences), "\n\n")


def conll_texts(texts: str) -> Column:
    """conll_text() of each of a document's texts."""

    @F.arrow_udf("array<string>")
    def run(x: pa.Array) -> pa.Array:
        offsets = [np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(b), 0).to_numpy(zero_copy_only=False))]) for b in blocks(x)]
        return pa.concat_arrays([pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), conll_text(b.flatten())) for o, b in zip(offsets, blocks(x), strict=True)] or [x])

    return run(texts)


def expected_forms() -> list[tuple[int, str]]:
    """(number of the meta, segmentation)."""
    return [(i, f"{m[5][p]} {seg}") for i, m in enumerate(METAS) if m[3] is None for name, p, _, seg in FORMS if name == m[1]]
