"""Letter labels of segmentations, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN = "_начало"
#: The begin mark of the original decoder, which differs from its converter's.
DECODER_BEGIN = "_старт"
MORPHEMES = "array<struct<type: string, part: string>>"


def tokens(value: Column) -> Column:
    """Tokens of a segmentation, split at Unicode white space."""
    return F.filter(F.split(value, r"(?U)\s+"), lambda t: t != "")


def is_bad(value: Column) -> Column:
    """Some token is not exactly type_part."""
    return F.exists(tokens(value), lambda t: F.size(F.split(t, "_")) != 2)


def letters(words: DataFrame, begin: str = BEGIN) -> DataFrame:
    """word_id, pos, letter, label for each letter of (word_id, value); empty parts have none, words with a malformed token are left out."""
    each = F.flatten(F.transform(tokens(F.col("value")), lambda t: F.transform(
        F.filter(F.split(F.split(t, "_")[1], ""), lambda c: c != ""), lambda c, k: F.struct(c.alias("letter"), F.concat(F.split(t, "_")[0], F.when(k == 0, begin).otherwise("")).alias("label")))))
    return words.where(~is_bad(F.col("value"))).select("word_id", F.posexplode(each).alias("pos", "l")).select("word_id", "pos", "l.letter", "l.label")


def letter_rejects(words: DataFrame) -> DataFrame:
    return words.where(is_bad(F.col("value"))).select(F.lit("letters").alias("stage"), F.lit("bad_token").alias("code"), F.col("value").alias("detail"), F.col("word_id").cast("string").alias("key"))


def reconstruct(labelled: Column, begin: str = BEGIN) -> Column:
    """struct(morphemes, err) from an array<struct<letter, label>> in order: a begin label opens a morpheme, the bare type continues it."""
    start = F.struct(F.array().cast(MORPHEMES).alias("out"), F.lit(None).cast("string").alias("type"), F.lit("").alias("part"), F.lit(None).cast("string").alias("err"))

    def step(s: Column, x: Column) -> Column:
        opens = x["label"].endswith(begin)
        kind = F.left(x["label"], F.length(x["label"]) - len(begin))
        done = F.when(s["type"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(s["type"].alias("type"), s["part"].alias("part")))))
        to = lambda out, type_, part, err: F.struct(out.alias("out"), type_.alias("type"), part.alias("part"), err.alias("err"))
        none = F.lit(None).cast("string")
        return (
            F.when(s["err"].isNotNull(), s)
            .when(F.coalesce(s["type"] == x["label"], F.lit(False)), to(s["out"], s["type"], F.concat(s["part"], x["letter"]), none))
            .when(opens, to(done, kind, x["letter"], none))
            .otherwise(to(s["out"], s["type"], s["part"], F.lit("bad_start_tag")))
        )

    end = F.aggregate(labelled, start, step)
    last = F.when(end["type"].isNull(), end["out"]).otherwise(F.concat(end["out"], F.array(F.struct(end["type"].alias("type"), end["part"].alias("part")))))
    return F.struct(F.when(end["err"].isNull(), last).alias("morphemes"), end["err"].alias("err"))


def words_from_letters(rows: DataFrame, begin: str = BEGIN) -> DataFrame:
    """word_id, morphemes, err from letter rows (word_id, pos, letter, label)."""
    ordered = rows.groupBy("word_id").agg(F.array_sort(F.collect_list(F.struct("pos", "letter", "label"))).alias("l"))
    found = ordered.select("word_id", reconstruct(F.transform("l", lambda x: F.struct(x["letter"].alias("letter"), x["label"].alias("label"))), begin).alias("r"))
    return found.select("word_id", "r.morphemes", "r.err")


def conll_text(rows: DataFrame) -> DataFrame:
    """word_id, value: the letter rows of a word as lines, with the blank line that ends it."""
    lines = rows.groupBy("word_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(" ", "letter", "label").alias("line")))).alias("l"))
    return lines.select("word_id", F.concat(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("value"))


def letters_from_text(texts: DataFrame) -> DataFrame:
    """word_id (doc and number), pos, letter, label of whole texts (doc, value) as conll_text() makes them: a line per letter, a blank line after each word."""
    words = texts.select("doc", F.posexplode(F.split("value", r"\n\s*\n")).alias("word", "text"))
    lines = F.filter(F.transform(F.split("text", r"\r?\n"), lambda x: F.split(F.trim(x), r"\s+")), lambda f: F.size(f) == 2)
    rows = words.select(F.struct("doc", "word").alias("word_id"), F.posexplode(lines).alias("pos", "f"))
    return rows.select("word_id", "pos", F.col("f")[0].alias("letter"), F.col("f")[1].alias("label"))
