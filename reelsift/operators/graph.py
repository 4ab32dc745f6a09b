"""Connected components by star contraction, as joins over written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelsift.session import materialise


def _towards_minimum(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Connect neighbours of each node ``a`` to the least of them and ``a``."""
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    if larger_only:
        edges = edges.filter(F.col("b") > F.col("a"))
    return edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"), F.col("a").alias("via"))


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of the edges ``a``, ``b``: the least node it reaches.

    Alternates large-star and small-star steps (Kiveris et al. 2014), each an aggregation that is
    combined before its shuffle and one join. A round is one written table; rounds grow with the
    logarithm of the longest path. No neighbour list is ever collected.
    """
    now = materialise(edges.select("a", "b").filter("a <> b"))
    mark = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _towards_minimum(both, larger_only=True).select("a", "b")
        down = large.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small = _towards_minimum(down.distinct(), larger_only=False)
        hooked = small.select("a", "b").union(small.select(F.col("via").alias("a"), "b"))
        now = materialise(hooked.filter("a <> b").distinct())
        was, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if was == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
