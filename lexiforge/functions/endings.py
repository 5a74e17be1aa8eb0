"""Segmentation of the endings in inflexion tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let
from .wordlists import INFLEXIONS, SUFFIXES

# Postfixes of verbs.
POSTFIXES = ("ся", "сь")


def default_inflexions() -> list[str]:
    return ["", *INFLEXIONS]


def default_suffixes() -> list[str]:
    return sorted({w.replace("ь", "").replace("ъ", "") for w in SUFFIXES})


def segment_ending(ending: Column, inflexions: Iterable[str] | None = None, suffixes: Iterable[str] | None = None) -> Column:
    """type_part type_part ... of an ending; null where the dictionaries do not explain it.

    A postfix is cut first. A rest that is an inflexion is an ending as a whole. Otherwise its longest inflexion of up to three letters is
    cut, and what stays must be a suffix or, with the shortest left one, two suffixes; soft signs in it do not count.
    """
    inflexions = list(default_inflexions() if inflexions is None else inflexions)
    suffixes = list(default_suffixes() if suffixes is None else suffixes)
    return segmented(ending, lambda c: c.isin(*inflexions), lambda c: c.isin(*suffixes))


def segmented(ending: Column, is_inflexion: Callable[[Column], Column], is_suffix: Callable[[Column], Column]) -> Column:
    """segment_ending() for any test of inflexions and suffixes."""
    none = F.array().cast("array<string>")
    mark = lambda kind, text: F.array(F.concat(F.lit(kind), text))

    def suffixes_of(stem: Column) -> Column:
        bare = F.translate(stem, "ь", "")
        places = F.when(F.length(bare) > 1, F.sequence(F.lit(1), F.length(bare) - 1)).otherwise(F.array().cast("array<int>"))
        split = F.filter(places, lambda i: is_suffix(F.substring(bare, F.lit(1), i)) & is_suffix(F.substring(bare, i + 1, F.length(bare))))
        two = let(F.get(split, F.lit(0)), lambda i: F.when(i.isNotNull(), F.concat(mark("суфф_", F.substring(bare, F.lit(1), i)), mark("суфф_", F.substring(bare, i + 1, F.length(bare))))))
        return F.when(stem == "ь", none).when(is_suffix(bare), mark("суфф_", bare)).otherwise(two)

    def without_postfix(x: Column) -> Column:
        head, m = x["head"], F.length(x["head"])
        cut = F.coalesce(*(F.when(is_inflexion(F.right(head, F.lit(k))), F.least(F.lit(k), m)) for k in (3, 2, 1)), F.lit(0))
        rest = let(cut, lambda k: F.concat(let(F.substring(head, F.lit(1), m - k), suffixes_of), F.when(k > 0, mark("оконч_", F.right(head, k))).otherwise(none)))
        return F.array_join(F.concat(F.when(is_inflexion(head), mark("оконч_", head)).otherwise(rest), x["post"]), " ")

    def start(word: Column) -> Column:
        n, tail = F.length(word), F.right(word, F.lit(2))
        post = (n >= 2) & tail.isin(*POSTFIXES)
        parts = F.struct(F.when(post, F.substring(word, F.lit(1), n - 2)).otherwise(word).alias("head"), F.when(post, mark("частица_", tail)).otherwise(none).alias("post"))
        return F.when(post & (n == 2), F.concat(F.lit("частица_"), tail)).otherwise(let(parts, without_postfix))

    return let(ending, start)


def possible_morphemes(ending: Column) -> tuple[Column, Column]:
    """(inflexions, suffixes) that segmented() may ask for, as arrays: the ends of an ending and of its part before a postfix; all substrings without soft signs."""
    n = F.length(ending)
    ends = lambda head: F.array(head, *(F.right(head, F.lit(k)) for k in (1, 2, 3)))
    before = F.substring(ending, F.lit(1), F.greatest(n - 2, F.lit(0)))
    places = lambda first, last: F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    pieces = lambda bare: F.flatten(F.transform(places(F.lit(1), F.length(bare)), lambda i: F.transform(places(F.lit(1), F.length(bare) - i + 1), lambda k: F.substring(bare, i, k))))
    return F.array_distinct(F.concat(ends(ending), ends(before))), F.array_distinct(F.concat(let(F.translate(ending, "ь", ""), pieces), F.array(F.lit(""))))


def segment_endings(endings: DataFrame, inflexions: DataFrame | None = None, suffixes: DataFrame | None = None) -> DataFrame:
    """Distinct `ending` values of endings with seg_ending, for dictionaries of any size (value; the empty inflexion is added, suffixes lose soft and hard signs): what an ending may ask for is joined with them, so no plan holds a dictionary.

    None takes the default dictionary.
    """
    spark = endings.sparkSession
    table = lambda words, default: spark.createDataFrame([(w,) for w in default], "value string") if words is None else words.select("value")
    signless = F.translate(F.col("value"), "ьъ", "")
    known = table(inflexions, default_inflexions()).union(spark.createDataFrame([("",)], "value string")).select(F.lit("inflexion").alias("kind"), "value")
    known = known.unionByName(table(suffixes, default_suffixes()).select(F.lit("suffix").alias("kind"), signless.alias("value"))).distinct()
    distinct = endings.select("ending").distinct()
    one, two = possible_morphemes(F.col("ending"))
    asked = distinct.select("ending", F.explode(F.array(F.struct(F.lit("inflexion").alias("kind"), one.alias("values")), F.struct(F.lit("suffix").alias("kind"), two.alias("values")))).alias("a"))
    asked = asked.select("ending", F.col("a.kind").alias("kind"), F.explode("a.values").alias("value"))
    found = asked.join(known, ["kind", "value"], "left_semi").groupBy("ending").agg(*(F.collect_list(F.when(F.col("kind") == kind, F.col("value"))).alias(kind) for kind in ("inflexion", "suffix")))
    each = distinct.join(found.withColumnRenamed("ending", "_ending"), F.col("ending").eqNullSafe(F.col("_ending")), "left")
    has = lambda kind: lambda c: F.coalesce(F.array_contains(kind, c), F.lit(False))
    return each.select("ending", segmented(F.col("ending"), has("inflexion"), has("suffix")).alias("seg_ending"))
