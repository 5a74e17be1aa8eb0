"""Stems of a table call: alignment to the base form, and the parameters that they give."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base_form import ENDING, ROOT, SUFFIX, format_parts, word_of
from .text import drop_signs, let

PAIR = "struct<type: string, part: string>"


def split_stem(stem: Column) -> Column:
    """struct(name, stem, bad): name is null for a positional stem; soft and hard signs go from named stems alone."""
    named = F.locate("=", stem) > 0
    bad = F.size(F.split(stem, "=")) > 2
    return F.struct(F.when(named, F.substring_index(stem, "=", 1)).alias("name"), F.when(named, drop_signs(F.substring_index(stem, "=", -1))).otherwise(stem).alias("stem"), bad.alias("bad"))


def align_stem(stem: Column, parts: Column) -> Column:
    """struct(parts array<PAIR>, err): the stem cut along the base form's parts."""
    start = F.struct(stem.alias("rest"), F.array().cast(f"array<{PAIR}>").alias("out"), F.lit(False).alias("done"), F.lit(None).cast("string").alias("err"))

    def step(s: Column, p: Column) -> Column:
        rest, text, kind = s["rest"], p["part"], p["type"]
        to = lambda rest_, add, done, err: F.struct(rest_.alias("rest"), (F.concat(s["out"], F.array(F.struct(kind.alias("type"), add.alias("part")))) if add is not None else s["out"]).alias("out"), F.lit(done).alias("done"), F.lit(err).cast("string").alias("err"))
        gap = (F.length(text) > 0) & (F.length(rest) > 0) & (F.abs(F.length(text) - F.length(rest)) >= 3)
        none = F.lit("")
        return (
            F.when(s["done"] | s["err"].isNotNull(), s)
            .when((rest == "") & (kind == ENDING), to(rest, None, True, None))
            .when(rest.startswith(text), to(F.substring(rest, F.length(text) + 1, F.length(rest)), text, False, None))
            .when((kind == SUFFIX) & gap, to(rest, None, False, "suffix_gap"))
            .when(kind == SUFFIX, to(none, rest, True, None))
            .when((kind == ROOT) & text.startswith(rest), to(none, rest, True, None))
            .otherwise(to(rest, None, False, "misaligned"))
        )

    return let(F.aggregate(parts, start, step), lambda end: F.struct(end["out"].alias("parts"), F.coalesce(end["err"], F.when(end["rest"] != "", "leftover")).alias("err")))


def align_stems(stems: Column, parts: Column) -> Column:
    """struct(stems array<struct<name, seg>>, err): every stem must align, and one must start the base form."""
    word = word_of(parts)
    start = F.transform(stems, lambda s: let(split_stem(s), lambda x: F.struct(x["name"].alias("name"), x["bad"].alias("bad"), F.startswith(word, x["stem"]).alias("base"), align_stem(x["stem"], parts).alias("a"))))

    def judge(aligned: Column) -> Column:
        first = F.get(F.filter(aligned, lambda a: a["a"]["err"].isNotNull()), F.lit(0))["a"]["err"]
        err = F.coalesce(F.when(F.exists(aligned, lambda a: a["bad"]), "bad_stem_param"), first, F.when(~F.exists(aligned, lambda a: a["base"]), "no_base_stem"))
        return F.struct(F.transform(aligned, lambda a: F.struct(a["name"].alias("name"), format_parts(a["a"]["parts"]).alias("seg"))).alias("stems"), err.alias("err"))

    return let(start, judge)


def parameters(stems: Column) -> Column:
    """array<struct<k, v>>: each stem under its number and its name in triple braces; a later entry wins (see lookup()).

    The plain stem and the first numbered one stand for each other where one is missing.
    """
    brace = lambda name: F.concat(F.lit("{{{"), name, F.lit("}}}"))
    entry = lambda k, v: F.struct(k.alias("k"), v.alias("v"))
    each = F.flatten(F.transform(stems, lambda s, i: F.when(s["name"].isNull(), F.array(entry(brace((i + 1).cast("string")), s["seg"]))).otherwise(F.array(entry(brace(s["name"]), s["seg"]), entry(brace((i + 1).cast("string")), s["seg"])))))
    none = F.array().cast("array<struct<k: string, v: string>>")

    def mirrored(each: Column) -> Column:
        plain, first = lookup(each, F.lit("{{{основа}}}")), lookup(each, F.lit("{{{основа1}}}"))
        return F.concat(each, F.when(plain.isNull() & first.isNotNull(), F.array(entry(F.lit("{{{основа}}}"), first))).when(plain.isNotNull() & first.isNull(), F.array(entry(F.lit("{{{основа1}}}"), plain))).otherwise(none))

    return let(each, mirrored)


def lookup(entries: Column, key: Column) -> Column:
    """The last value under the key, null without one."""
    return F.try_element_at(F.filter(entries, lambda e: e["k"] == key), F.lit(-1))["v"]


def placeholder(entries: Column, parameter: Column) -> Column:
    """The value of a placeholder: {{{a|{{{b}}}}}} falls back to b. Null where neither is known."""
    default = F.locate("|", parameter)
    first = F.concat(F.substring(parameter, F.lit(1), default - 1), F.lit("}}}"))
    rest = F.substring(parameter, default + 1, F.length(parameter))
    second = F.substring(rest, F.lit(1), F.locate("}", rest) + 2)
    return F.when(default > 0, F.coalesce(lookup(entries, first), lookup(entries, second))).otherwise(lookup(entries, parameter))
