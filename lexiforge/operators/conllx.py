"""Morpheme columns on CoNLL-X sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import computed

FIELDS = ("id", "form", "lemma", "cpostag", "postag", "feats", "head", "deprel", "phead", "pdeprel")
# Morpheme types that have a column, in order, and parts of speech that are not segmented.
COLUMNS = ("прист", "корень", "суфф", "оконч")
IGNORED_POS = ("PR", "COM", "CONJ", "PART", "P", "INTJ", "NID")


def sentences(texts: DataFrame) -> DataFrame:
    """doc, sent_id, line_no, line from whole texts (doc, value); blank lines end a sentence, the last one needs none."""
    blocks = texts.select("doc", F.posexplode(F.filter(F.split("value", r"\n\s*\n|\n\s*$"), lambda b: ~b.rlike(r"^\s*$"))).alias("sent_id", "block"))
    lines = F.posexplode(F.filter(F.split("block", r"\r?\n"), lambda line: ~line.rlike(r"^\s*$"))).alias("line_no", "line")
    return blocks.select("doc", F.col("sent_id").cast("long").alias("sent_id"), lines)


def parse(lines: DataFrame, fail_fast: bool = False) -> DataFrame:
    """lines with the ten fields; empty fields collapse. Lines without ten fields raise an error, or are left out (see rejects())."""
    fields = F.filter(F.split("line", "\t"), lambda x: x != "")
    if fail_fast:
        fields = F.when(F.size(fields) == 10, fields).otherwise(F.raise_error(F.concat(F.lit("expected 10 fields: "), F.col("line"))).cast("array<string>"))
    split = computed(lines, "_f", fields).where(F.size("_f") == 10)
    return split.select(*[c for c in lines.columns if c != "line"], *(F.col("_f")[k].alias(name) for k, name in enumerate(FIELDS)))


def rejects(lines: DataFrame) -> DataFrame:
    bad = lines.where(F.size(F.filter(F.split("line", "\t"), lambda x: x != "")) != 10)
    return bad.select(F.lit("conll").alias("stage"), F.lit("bad_columns").alias("code"), F.col("line").alias("detail"), F.col("sent_id").cast("string").alias("key"))


def is_word() -> Column:
    """The token's part of speech is segmented."""
    return ~F.col("postag").isin(*IGNORED_POS)


def parts(form: Column) -> Column:
    """array<string>: the parts of a form that can be segmented."""
    return F.filter(F.split(form, "[ -]"), lambda p: F.length(p) >= 2)


def words(tokens: DataFrame) -> DataFrame:
    """The parts of each form that are to be segmented: all columns of tokens, part_no, part."""
    return tokens.where(is_word()).select(*tokens.columns, F.posexplode(F.split("form", "[ -]")).alias("part_no", "part")).where(F.length("part") >= 2)


def counts(lines: DataFrame) -> DataFrame:
    """doc, sentences, tokens, parts, bad (lines without ten fields) of each doc that has tokens, in one pass over its lines."""
    f = F.filter(F.split("line", "\t"), lambda x: x != "")
    each = computed(lines.select("doc", "sent_id", "line"), "f", f)
    good = F.size("f") == 10
    found = F.when(good & ~F.col("f")[FIELDS.index("postag")].isin(*IGNORED_POS), F.size(parts(F.col("f")[FIELDS.index("form")]))).otherwise(0)
    per = each.select("doc", "sent_id", good.alias("good"), found.alias("parts")).groupBy("doc", "sent_id")
    sums = per.agg(F.count_if("good").alias("tokens"), F.sum("parts").alias("parts"), F.count_if(~F.col("good")).alias("bad"))
    out = sums.groupBy("doc").agg(F.count_if(F.col("tokens") > 0).alias("sentences"), *(F.sum(c).alias(c) for c in ("tokens", "parts", "bad")))
    return out.where("tokens > 0")


def morpheme_columns(morphemes: Column, compatible: bool = False) -> list[Column]:
    """A column per type in COLUMNS: its parts joined by bars, _ without one. compatible keeps the original's order of bars: |old new."""
    out = []
    for name in COLUMNS:
        parts = F.transform(F.filter(morphemes, lambda m: m["type"] == name), lambda m: m["part"])  # noqa: B023
        if compatible:
            joined = F.aggregate(parts, F.lit("_"), lambda s, p: F.when(s == "_", p).otherwise(F.concat(F.lit("|"), s, p)))
        else:
            joined = F.when(F.size(parts) > 0, F.array_join(parts, "|")).otherwise("_")
        out.append(F.coalesce(joined, F.lit("_")).alias(name))
    return out


def with_morphemes(tokens: DataFrame, found: DataFrame, key: tuple[str, ...], compatible: bool = False) -> DataFrame:
    """tokens with the morpheme columns of found (key columns, part_no, morphemes); parts of a form follow each other."""
    per = found.groupBy(*key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part_no", "morphemes"))), lambda x: x["morphemes"])).alias("morphemes"))
    return tokens.join(per, list(key), "left").select(*tokens.columns, *morpheme_columns(F.col("morphemes"), compatible))


def with_form_morphemes(tokens: DataFrame, found: DataFrame, compatible: bool = False) -> DataFrame:
    """tokens with the morpheme columns of found (form, part_no, morphemes); parts of a form follow each other. A frequent form is a hot key, whose other side has one row."""
    per = found.groupBy(F.col("form").alias("_form")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part_no", "morphemes"))), lambda x: x["morphemes"])).alias("morphemes"))
    columns = per.select("_form", *morpheme_columns(F.col("morphemes"), compatible))
    joined = tokens.join(columns, F.col("form") == F.col("_form"), "left")
    return joined.select(*tokens.columns, *(F.coalesce(F.when(is_word(), F.col(c)), F.lit("_")).alias(c) for c in COLUMNS))


def line(compatible: bool = True) -> Column:
    """The output line: morpheme columns after FEATS; compatible keeps the empty field that follows them."""
    return F.concat_ws("\t", *FIELDS[:6], *COLUMNS, *([F.lit("")] if compatible else []), *FIELDS[6:])
