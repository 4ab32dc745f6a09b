"""Counters per video and overall, from one outcome row per sampled frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelsift.functions.classes import CATEGORIES
from reelsift.functions.naming import base_name
from reelsift.params import Params

COUNTERS = (
    "processed_frames",
    "saved_frames",
    "skipped_text",
    "skipped_no_detection",
    "rejected_quality",
    "no_crop",
    "person_frames",
    "animal_frames",
    "object_frames",
)


def count_outcomes(outcomes: DataFrame, params: Params = Params()) -> DataFrame:
    """Counters per video that has sampled frames; also valid on a stream.

    A turbo run does not count frames skipped for text as processed, a standard run does.
    """
    outcome, saved = F.col("outcome"), F.col("outcome") == "saved"
    processed = outcome != "skipped_text" if params.turbo else F.lit(True)
    counted = ("skipped_text", "skipped_no_detection", "rejected_quality", "no_crop")
    return outcomes.groupBy("video_id").agg(
        F.count_if(processed).alias("processed_frames"),
        F.count_if(saved).alias("saved_frames"),
        *(F.count_if(outcome == name).alias(name) for name in counted),
        *(F.count_if(saved & (F.col("category") == c)).alias(f"{c}_frames") for c in CATEGORIES),
    )


def video_stats(
    outcomes: DataFrame,
    videos: DataFrame,
    params: Params = Params(),
    elapsed: DataFrame | None = None,
) -> DataFrame:
    """Counters of every video, zeros where nothing was sampled or the video could not be read.

    ``elapsed`` may bring measured ``video_id, processing_time``.
    """
    counts = count_outcomes(outcomes, params)
    stats = videos.select("video_id").join(counts, "video_id", "left").fillna(0, list(COUNTERS))
    if elapsed is not None:
        stats = stats.join(elapsed.select("video_id", "processing_time"), "video_id", "left")
    return stats


def overall_stats(stats: DataFrame, videos: DataFrame) -> DataFrame:
    """One row per video of ``stats`` and one total, whose ``video_id`` and ``video_name`` are null.

    ``total_videos`` counts the rows of ``videos``, ``processed_videos`` those of ``stats``, which are fewer
    after a run that was stopped. ``total_time`` adds up ``processing_time`` where ``stats`` has it.
    """
    named = videos.select("video_id", base_name(F.col("path")).alias("_name")).join(
        stats.withColumn("_done", F.lit(1)), "video_id", "left"
    )
    is_total, timed = F.grouping("video_id") == 1, "processing_time" in stats.columns
    return (
        named.rollup("video_id")
        .agg(
            F.when(~is_total, F.max("_name")).alias("video_name"),
            F.count(F.lit(1)).alias("total_videos"),
            F.count("_done").alias("processed_videos"),
            *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS),
            *([F.sum("processing_time").alias("total_time")] if timed else []),
        )
        .filter("video_name IS NULL OR processed_videos > 0")
    )


def processing_fps(stats: DataFrame) -> DataFrame:
    """Processed frames per second of ``processing_time``, 0 where no time was taken."""
    taken = F.col("processing_time")
    return stats.withColumn(
        "processing_fps", F.when(taken > 0, F.col("processed_frames") / taken).otherwise(F.lit(0.0))
    )
