"""Connected components of link tables by alternating large-star and small-star steps.

Each step is one aggregation by node (the least neighbour, with partial sums before the shuffle)
and one join of two stored tables, which the adaptive skew join can split at a node with
very many neighbours. The number of rounds grows with the logarithm of the component's size; they end as soon as
every component is a star around its least node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges: a > b, no repeats. Returns the same kind of table."""
    sides = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "cc-least")
    joined = sides.join(least, "a")
    if small:  # all smaller neighbours of a, and a itself, meet at the least
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    else:  # larger neighbours of a move to the least
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = materialize(out.where(F.col("a") > F.col("b")).distinct(), "cc-edges")
    discard(least)
    return out


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, and then no larger one: nothing is left to do."""
    ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    per = ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per.where(F.col("up") + F.col("down") > 1).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of edges (a, b) of longs; nodes linked with none but themselves are absent."""
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") > F.col("b")).distinct(), "cc-edges")
    while not _stars(now):
        large = _star(now, small=False)
        discard(now)
        now = _star(large, small=True)
        discard(large)
    # every edge now joins a node to the least of its component
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
