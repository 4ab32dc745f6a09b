"""Connected components of links between fingerprints, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelsift.session import materialise


def _least_neighbour(links: DataFrame) -> DataFrame:
    """``a``, ``b``, ``m`` for each link: the least of ``a`` and all its neighbours beside it."""
    least = links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return links.join(least, "a").select("a", "b", "m")


def _large_star(links: DataFrame) -> DataFrame:
    """Hang the larger neighbours of each node on its least one."""
    turned = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return _least_neighbour(links.union(turned)).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Hang each node and its smaller neighbours on the least of them. Links lead downwards."""
    met = _least_neighbour(links.distinct())
    hung = met.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return hung.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of the links ``a``, ``b``: the least node it reaches.

    Kiveris et al. 2014: each star step is one aggregation, combined before its shuffle, and one join,
    so no list of neighbours is collected, and rounds grow with the logarithm of the longest path.
    A round ends in a written table. Loops and repeated links change nothing; without links there
    are no rows.
    """
    now = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    before = None
    while True:
        now = materialise(_small_star(_large_star(now)))
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
        before = mark
