"""Normalisation of wikitext: small expressions shared by the parsers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Combining accents.
STRESS = "́"
GRAVE = "̀"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use mentions it.

    A Column is an expression tree, and every mention is a copy; inside higher-order functions nothing removes the copies again.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once per row: filters and projections above a generator do not copy its expression."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def strip_space(c: Column) -> Column:
    """Unicode-aware strip of both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def drop_stress(c: Column, grave: bool = False) -> Column:
    """Remove combining acute accents, and grave ones too."""
    return F.translate(c, STRESS + (GRAVE if grave else ""), "")


def squeeze(c: Column) -> Column:
    """Delete spaces, tabs and line feeds (carriage returns stay)."""
    return F.translate(c, " \t\n", "")


def cyrillic_letters(c: Column) -> Column:
    """Latin letters that look like Cyrillic ones become these."""
    return F.translate(c, "ceoxa", "сеоха")


def drop_signs(c: Column) -> Column:
    """Remove soft and hard signs."""
    return F.translate(c, "ьъ", "")


def matches_start(c: Column, pattern: str) -> Column:
    """The pattern matches at the start of the string; it need not reach the end."""
    return c.rlike(f"^(?:{pattern})")


def section(text: Column, begin: str = "{{-ru-}}", language: str = r"\{\{-[a-z]{2,3}-\}\}") -> Column:
    """What follows the first `begin`, up to the next language heading; null without it."""
    at = F.locate(begin, text)
    rest = F.substring(text, at + len(begin), F.length(text))
    return F.when(at > 0, F.split(rest, language, 2)[0])
