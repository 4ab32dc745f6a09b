"""Video properties and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelsift import schemas
from reelsift.operators.skew import WINDOW_ROWS, broadcast_if_small, is_small, number_within
from reelsift.params import Params


def video_info(videos: DataFrame) -> DataFrame:
    """Add ``duration`` in seconds, 0 where the frame rate is unknown."""
    schemas.require(videos, schemas.VIDEOS, "videos")
    fps = F.col("fps")
    return videos.withColumn(
        "duration", F.when(fps > 0, F.col("total_frames") / fps).otherwise(F.lit(0.0))
    )


def frame_scan(positions: DataFrame, order: Column, limit: int | None = WINDOW_ROWS) -> DataFrame:
    """Number the frames of each video from 1 in ``order``, however long the video."""
    return number_within(positions, ["video_id"], [order], "frame_no", limit)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frame table from Parquet."""
    return schemas.require(spark.read.parquet(path), schemas.FRAMES, "frames")


def read_frame_images(spark: SparkSession, root: str) -> DataFrame:
    """Frames from image files ``video_id=<v>/frame_<number>.<ending>`` below ``root``."""
    number = F.regexp_extract("image.origin", r"frame_(\d+)\.[^/]*$", 1).cast("int")
    return (
        spark.read.format("image")
        .load(root)
        .withColumn("frame_no", number)
        .select(
            F.col("video_id").cast("int").alias("video_id"),
            "frame_no",
            (F.shiftleft(F.col("video_id").cast("bigint"), 32) + F.col("frame_no")).alias("frame_key"),
            F.col("image.width").alias("width"),
            F.col("image.height").alias("height"),
            "image",
        )
    )


def frame_sample(rows: DataFrame, params: Params = Params()) -> DataFrame:
    """Every ``interval``-th frame: the first one kept is number ``interval``.

    Works on any table with ``frame_no``, so it can be put ahead of joins and Python jobs.
    """
    return rows if params.interval == 1 else rows.filter(F.col("frame_no") % params.interval == 0)


def frame_lookup(frames: DataFrame, requests: DataFrame) -> DataFrame:
    """Frames by 0-based ``frame_index``; the frame's columns are null where there is none.

    ``requests`` has ``video_id, frame_index``; index k is the frame numbered k + 1. Few requests go to
    the frames, so these stay in place; only the frames found meet the requests again. For many, frames
    of videos that are asked for are read alone where the table is partitioned by video (``write_frames``),
    and Spark puts a Bloom filter of the requests before their shuffle if that is worth it.
    """
    key = ["video_id", "frame_no"]
    wanted = requests.withColumn("frame_no", F.col("frame_index") + 1)
    sought = wanted.filter(F.col("frame_index") >= 0).select(*key)
    keys = sought.distinct()
    if is_small(keys):
        keys = F.broadcast(keys)
    else:
        keys = sought  # a scan and a filter, from which Spark can make its own filter
        frames = frames.join(broadcast_if_small(sought.select("video_id").distinct()), "video_id", "left_semi")
    found = frames.join(keys, key, "left_semi")
    return wanted.join(found, key, "left")


def write_frames(frames: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a frame table partitioned by video."""
    frames.hint("rebalance", F.col("video_id")).write.mode(mode).partitionBy("video_id").parquet(path)


def frame_at(frames: DataFrame, video_id: int, frame_index: int) -> DataFrame:
    """One frame by 0-based index, as a filter the Parquet scan takes over; empty if absent."""
    return frames.filter((F.col("video_id") == video_id) & (F.col("frame_no") == frame_index + 1))


def progress_pct(frames: DataFrame, videos: DataFrame, params: Params = Params()) -> DataFrame:
    """Progress in percent at each sampled frame whose number is a multiple of 30."""
    reported = frame_sample(frames, params).filter(F.col("frame_no") % 30 == 0)
    total = F.col("total_frames")
    return (
        reported.select("video_id", "frame_no")
        .join(broadcast_if_small(videos.select("video_id", "total_frames")), "video_id")
        .withColumn("progress", F.when(total > 0, F.col("frame_no") / total * F.lit(100.0)))
    )
