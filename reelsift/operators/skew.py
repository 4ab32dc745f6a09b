"""Exact ways around groups too large for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelsift.session import materialise

WINDOW_ROWS = 1_000_000  # rows of one group a single task may sort (it can spill)
SMALL_ROWS = 100_000  # rows of a narrow table that may be sent to every executor


def is_small(df: DataFrame, rows: int = SMALL_ROWS) -> bool:
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Mark a cheap-to-count table for broadcast when its counted size allows it.

    Beyond that Spark joins by shuffle, where adaptive execution splits skewed partitions.
    """
    return F.broadcast(df) if is_small(df, rows) else df


def split_large_groups(
    df: DataFrame, keys: Sequence[str], limit: int | None, sized_by: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Split ``df`` into rows of groups with at most ``limit`` rows and rows of larger ones.

    Sizes come from one pre-aggregated count over the key columns alone; only its maximum reaches
    the driver. The second part is None when no group is too large, the usual case, and then no
    join is added to the plan. With ``limit`` None the caller vouches for the group sizes.
    Sizes may be taken from ``sized_by`` instead, a table with all rows of ``df`` and maybe more
    that is cheaper to compute; materialise ``df`` first where there is none.
    """
    if limit is None:
        return df, None
    sizes = (df if sized_by is None else sized_by).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    largest = sizes.agg(F.max("_rows")).first()[0]
    if largest is None or largest <= limit:
        return df, None
    large = materialise(sizes.filter(F.col("_rows") > limit).select(*keys))
    large, keys = broadcast_if_small(large), list(keys)
    return df.join(large, keys, "left_anti"), df.join(large, keys, "left_semi")


def number_within(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str,
    limit: int | None = WINDOW_ROWS,
) -> DataFrame:
    """Add ``name``: 1, 2, 3 … within each group of ``keys``, by ``order``.

    Ordinary groups take one window. A large group is range-partitioned by the full order, so it
    spreads over many tasks whatever its size; each slice numbers its own rows and adds the row
    counts of the slices before it. Slices are written down, so that counts and rows agree even when
    tasks are repeated.
    """
    usual, large = split_large_groups(df, keys, limit)
    by_order = Window.partitionBy(*keys).orderBy(*order)
    numbered = usual.withColumn(name, F.row_number().over(by_order))
    if large is None:
        return numbered

    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_key = [F.col(k) for k in keys]
    tie = F.col("_tie")  # spreads rows that are equal throughout
    sliced = materialise(
        large.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(slices, *by_key, *order, tie)
        .withColumn("_slice", F.spark_partition_id())
    )
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .drop("_rows")
    )
    in_slice = Window.partitionBy(*keys, "_slice").orderBy(*order, tie)
    spread = (
        sliced.withColumn("_local", F.row_number().over(in_slice))
        .join(offsets, [*keys, "_slice"])
        .withColumn(name, (F.col("_before") + F.col("_local")).cast("int"))
        .select(*numbered.columns)
    )
    return numbered.unionByName(spread)
