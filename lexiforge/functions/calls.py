"""Template calls in wikitext."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

NESTED_PIPE = "№"


def template_call(text: Column, start: str) -> Column:
    """The first call that begins with the pattern `start` (which matches from its opening braces on), up to the balancing brace.

    Pipes of calls nested in it become NESTED_PIPE. Null if there is no such call or its braces do not balance.
    Two folds over brace tokens: one finds the end, one rewrites the (short) call.
    """
    at = F.regexp_instr(text, F.lit(start))
    tokens = F.regexp_extract_all(F.substring(text, at, F.length(text)), F.lit(r"[{}]|[^{}]+"), F.lit(0))
    step = lambda t: F.when(t == "{", 1).when(t == "}", -1).otherwise(0)
    state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def cut(tokens: Column) -> Column:
        end = F.aggregate(
            tokens, state,
            lambda s, t: F.when(s["done"], s).otherwise(F.struct((s["depth"] + step(t)).alias("depth"), (s["n"] + 1).alias("n"), ((s["depth"] + step(t) == 0) & (t == "}")).alias("done"))),
        )
        return let(end, lambda e: F.when(e["done"], rewrite(F.slice(tokens, 1, e["n"]))))

    def rewrite(call: Column) -> Column:
        return F.aggregate(
            call, F.struct(F.lit(0).alias("depth"), F.lit("").alias("text")),
            lambda s, t: F.struct((s["depth"] + step(t)).alias("depth"), F.concat(s["text"], F.when(s["depth"] > 2, F.translate(t, "|", NESTED_PIPE)).otherwise(t)).alias("text")),
        )["text"]

    return F.when(at > 0, let(tokens, cut))


def call_name(call: Column) -> Column:
    """Between the braces and the first pipe, trimmed; null if there is no pipe."""
    return F.when(F.locate("|", call) > 0, F.regexp_replace(F.substring_index(F.substring(call, 3, F.length(call)), "|", 1), r"(?U)^\s+|\s+$", ""))


def call_arguments(call: Column) -> Column:
    """The arguments between the braces: split at pipes, without the name."""
    parts = F.split(F.substring(call, 3, F.length(call) - 4), r"\|")
    return F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
