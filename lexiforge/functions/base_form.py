"""The morpheme call of a word's base form: names, order, yot letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import drop_signs, let

PART = "struct<ord: int, pos: int, type: string, part: string>"
# Names of positional arguments, in order.
POSITIONAL = ("прист1", "корень1", "суфф1", "оконч", "частица")
# Parts that are known not to be single morphemes.
ERROR_PARTS = ("ибелен", "распре", "ёхонек", "ителен", "надцат", "привет", "исмент", "абелен", "глобус", "ирован")
ROOT, ENDING, SUFFIX = "корень", "оконч", "суфф"
# What a vowel becomes after a yot.
IOTATED = ("эуоа", "еюёя")
# Vowels after which a last yot is written as a letter. The first list lacks one on purpose (compatible mode).
YOT_AFTER_COMPATIBLE, YOT_AFTER = "уеыаоэяию", "уеёыаоэяию"


def part_order(name: Column) -> Column:
    """struct(ord, tag) of an argument's name; null, or with a null tag, for an unknown one. The first rule that fits holds."""
    digit = lambda at: F.substring(name, at, 1).cast("int")
    last = F.right(name, F.lit(1)).cast("int")
    # Name pattern, order, tag.
    rules = [
        (name.rlike(r"^префд\s*[+-]?\d+\s*$"), F.regexp_extract(name, r"([+-]?\d+)", 1).cast("int"), "префд"),
        (name.startswith("префд"), F.lit(None).cast("int"), None),
        (name.rlike("^прист?[1-3]$"), 10 + last, "прист"),
        (name == "прист", F.lit(10), "прист"),
        (name.rlike("^корень?1?$"), F.lit(20), "корень"),
        (name.rlike("^суфф-[1-4]$"), 30 + digit(6), "суфф"),
        (name == "оконч-1", F.lit(40), "оконч"),
        (name.rlike("^соед1?$"), F.lit(50), "соед"),
        (name.rlike("^прист2[1-2]$"), 60 + digit(7), "прист"),
        (name == "корень2", F.lit(70), "корень"),
        (name.rlike("^суфф-2[1-4]$"), 80 + digit(7), "суфф"),
        (name == "соед2", F.lit(90), "соед"),
        (name.rlike("^прист3[1-2]$"), 100 + digit(7), "прист"),
        (name == "корень3", F.lit(110), "корень"),
        (name == "интер", F.lit(120), "интер"),
        (name == "суффд1", F.lit(130), "суффд"),
        (name.rlike("^суфф?[1-5]$"), 140 + last, "суфф"),
        (name == "суфф", F.lit(140), "суфф"),
        (name.startswith("оконч"), F.lit(150), "оконч"),
        (F.lit("частица").startswith(name) | (name == "постфикс"), F.lit(160), "частица"),
    ]
    out = None
    for test, order, tag in rules:
        value = F.struct(order.cast("int").alias("ord"), F.lit(tag).cast("string").alias("tag"))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def parse_parts(morfo: Column) -> Column:
    """struct(parts array<PART> in argument order, err) of a normalised morpheme call.

    A blank positional argument advances the position, a blank named one and the source reference are skipped. The first fault found is err.
    """
    args = F.split(F.substring(morfo, 3, F.length(morfo) - 4), r"\|")
    args = F.slice(args, 2, F.greatest(F.size(args) - 1, F.lit(0)))
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("err"), F.array().cast(f"array<{PART}>").alias("parts"))

    def step(s: Column, arg: Column) -> Column:
        equals = F.locate("=", arg)
        named = equals > 0
        name = F.when(named, F.substring_index(arg, "=", 1)).otherwise(F.get(F.array(*map(F.lit, POSITIONAL)), s["i"]))
        value = drop_signs(F.when(named, F.substring(arg, equals + 1, F.length(arg))).otherwise(arg))
        to = lambda i, err_, parts: F.struct(i.alias("i"), (s["n"] + 1).alias("n"), err_.alias("err"), parts.alias("parts"))

        def add(x: Column) -> Column:
            name, value, tag = x["name"], x["value"], x["known"]["tag"]
            err = (
                F.when(~named & (s["i"] >= len(POSITIONAL)), "too_many_positional")
                .when((named & (name == "")) | tag.isNull(), "unknown_part_name")
                .when((tag != ROOT) & ((F.length(value) > 6) | value.isin(*ERROR_PARTS)), "bad_morpheme")
            )
            part = F.struct(x["known"]["ord"].alias("ord"), s["n"].alias("pos"), tag.alias("type"), value.alias("part"))
            return let(err, lambda e: to(F.when(named, s["i"]).otherwise(s["i"] + 1), e, F.when(e.isNull(), F.concat(s["parts"], F.array(part))).otherwise(s["parts"])))

        known = let(F.when(named & (name == "постфикс"), F.lit("частица")).otherwise(name), part_order)
        skip = (named & (equals == F.length(arg))) | (named & (name == "источник"))
        return (
            F.when(s["err"].isNotNull(), s)
            .when(arg == "", to(s["i"] + 1, s["err"], s["parts"]))
            .when(skip, to(s["i"], s["err"], s["parts"]))
            .otherwise(let(F.struct(name.alias("name"), value.alias("value"), known.alias("known")), add))
        )

    return let(F.aggregate(args, start, step), lambda end: F.struct(F.array_sort(end["parts"]).alias("parts"), end["err"].alias("err")))


def replace_yot(parts: Column, compatible: bool = False) -> Column:
    """struct(parts, err): yot letters of ordered parts written out.

    compatible keeps two slips of the original rules: a yot inside a part is checked but not replaced, and one letter is
    missing from the vowels after which a last yot is a letter.
    """
    n = F.size(parts)
    start = F.struct(F.lit(0).alias("k"), F.lit(False).alias("soft"), F.lit(None).cast("string").alias("err"), F.array().cast(f"array<{PART}>").alias("parts"))
    vowels = YOT_AFTER_COMPATIBLE if compatible else YOT_AFTER

    def step(s: Column, p: Column) -> Column:
        text = F.when(s["soft"], F.concat(F.translate(F.substring(p["part"], 1, 1), *IOTATED), F.substring(p["part"], 2, F.length(p["part"])))).otherwise(p["part"])

        def write(text: Column) -> Column:
            count = F.length(text) - F.length(F.translate(text, "j", ""))
            last = F.right(text, F.lit(1)) == "j"
            at_end = s["k"] == n - 1
            inner = text
            for a, b in zip(*IOTATED, strict=True):
                inner = F.replace(inner, F.lit(f"j{a}"), F.lit(b))
            err = F.when(count > 1, "bad_yot").when((count == 1) & ~last & F.contains(inner, F.lit("j")), "bad_yot").when((count == 1) & last & at_end & (F.length(text) < 2), "bad_yot")
            bare = F.translate(text, "j", "")
            final = F.when(F.position(F.right(bare, F.lit(1)), F.lit(vowels)) > 0, F.concat(bare, F.lit("й"))).when(p["type"] == ENDING, F.concat(bare, F.lit("ь"))).otherwise(bare)
            new = F.when(count == 0, text).when(~last, text if compatible else inner).when(at_end, final).otherwise(bare)
            part = F.struct(p["ord"].alias("ord"), p["pos"].alias("pos"), p["type"].alias("type"), new.alias("part"))
            return F.struct((s["k"] + 1).alias("k"), ((count == 1) & last & ~at_end).alias("soft"), err.alias("err"), F.concat(s["parts"], F.array(part)).alias("parts"))

        return F.when(s["err"].isNotNull(), s).otherwise(let(text, write))

    return let(F.aggregate(parts, start, step), lambda end: F.struct(end["parts"].alias("parts"), end["err"].alias("err")))


def base_form(morfo: Column, compatible: bool = False) -> Column:
    """struct(parts array<struct<ord, pos, type, part>>, err) of a word's base form."""
    def write(parsed: Column) -> Column:
        return let(replace_yot(parsed["parts"], compatible), lambda w: F.struct(w["parts"].alias("parts"), F.coalesce(parsed["err"], w["err"], F.when(~F.exists(w["parts"], lambda p: p["type"] == ROOT), "no_root")).alias("err")))

    return let(parse_parts(morfo), write)


def word_of(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: p["part"]), "")


def format_parts(parts: Column) -> Column:
    """type_part type_part ..."""
    return F.array_join(F.transform(parts, lambda p: F.concat(p["type"], F.lit("_"), p["part"])), " ")
