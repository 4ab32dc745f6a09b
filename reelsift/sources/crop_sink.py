"""The crop manifest and its Parquet sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelsift.functions import naming
from reelsift.operators.crops import CROP_COLUMNS
from reelsift.operators.skew import broadcast_if_small
from reelsift.params import Params


def output_run_name(videos: DataFrame, params: Params = Params()) -> DataFrame:
    return videos.withColumn("run_name", naming.run_name(F.col("path"), params))


def crop_filename(crops: DataFrame) -> DataFrame:
    return crops.withColumn("file_name", naming.crop_file_name(F.col("frame_no"), F.col("quality")))


def crop_manifest(crops: DataFrame, videos: DataFrame, params: Params = Params()) -> DataFrame:
    """Where each accepted crop goes. ``video_id`` tells apart videos that share a file stem."""
    runs = broadcast_if_small(output_run_name(videos.select("video_id", "path"), params))
    return (
        crop_filename(crops)
        .join(runs, "video_id")
        .select(
            "run_name",
            naming.category_dir(F.col("category")).alias("category_dir"),
            "file_name",
            "video_id",
            "frame_no",
            *CROP_COLUMNS,
            "quality",
        )
    )


def write_crops(
    manifest: DataFrame, path: str, mode: str = "overwrite", keys: Sequence[str] = ("run_name", "category_dir")
) -> None:
    """Write by run and category; ``overwrite`` replaces the runs written and leaves other runs alone.

    The rebalance hint gathers the rows of a folder in few files and lets adaptive execution split
    a folder that is too large, so one long video does not end up in one task.
    """
    (
        manifest.hint("rebalance", F.col("run_name"), F.col("category_dir"))
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )
