"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.session import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b); a component is named by its smallest node.

    Alternates large and small stars: every node hangs its larger neighbours,
    then its smaller ones, to the smallest node it sees, until nothing changes,
    in a number of rounds that grows with the logarithm of a component's size.
    An edge stays one row and minima are combined before the shuffle, so a round
    is two sums and two joins; it is written to the shared folder, and only a
    count and a checksum come to the driver.
    """
    stars = written(_oriented(edges.select("a", "b")), "stars")
    seen = _mark(stars)
    while True:
        up = stars.select(F.col("b").alias("x"), F.col("a").alias("y"))
        both = up.unionByName(stars.select(F.col("a").alias("x"), F.col("b").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("low")).select("x", F.least("x", "low").alias("low"))
        large = up.join(least, "x").select(F.col("y").alias("a"), F.col("low").alias("b"))
        lower = large.groupBy("a").agg(F.min("b").alias("low"))
        # the edge to the smallest stays, the others turn to it
        turned = F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b"))
        stars = written(large.join(lower, "a").select(turned.alias("a"), F.col("low").alias("b")), "stars")
        now = _mark(stars)
        if now == seen:
            break
        seen = now
    hung = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return hung.unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(2**31)))).first())
