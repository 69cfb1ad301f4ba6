"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compact, cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) to (node, component): the smallest node that each node reaches. Nodes without edges aren't in it.

    Each step joins edges with the smallest neighbour of one end, so a node with very many neighbours is an ordinary
    skewed join, and its minimum is taken with partial sums. The number of steps grows with the logarithm of the longest
    path. Self loops and repeated edges don't matter; null ends are dropped.
    """
    e = edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).filter(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))).distinct()
    e = compact(cut(e, "edges"))
    state = _state(e)
    while state[0]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        e = compact(cut(small.filter("a != b").distinct(), "edges"))
        new = _state(e)
        if new == state:
            break
        state = new
    children = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return children.union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
