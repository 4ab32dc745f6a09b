"""The primary subject of a frame, the ranking behind it, and the best crops of a video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelsift import schemas
from reelsift.functions import classes
from reelsift.functions.geometry import Box
from reelsift.operators.skew import WINDOW_ROWS, number_within


def with_score(det: DataFrame) -> DataFrame:
    """Add ``area`` and ``score`` = area times confidence."""
    return det.withColumn("area", Box.named().area).withColumn(
        "score", F.col("area") * F.col("confidence")
    )


def _categorised(det: DataFrame) -> DataFrame:
    if "category" not in det.columns:
        det = det.withColumn("category", classes.category(F.col("class_id")))
    return with_score(det)


def _position(det: DataFrame) -> Column:
    """Order of appearance: of the detection itself, or of the founder of its group."""
    return F.col("gid" if "gid" in det.columns else "det_seq")


def primary_subject(det: DataFrame) -> DataFrame:
    """Per frame the detection with the highest score; ties go to person, animal, object, then to
    the earlier detection. A partial ``max_by`` leaves one row per frame and task to shuffle.
    """
    scored = _categorised(det)
    kept = F.struct(*(c for c in scored.columns if c != "frame_key"))
    rank = F.struct("score", -classes.category_rank(F.col("category")), -_position(det))
    best = scored.groupBy("frame_key").agg(F.max_by(kept, rank).alias("_s"))
    return best.select("frame_key", "_s.*").select(*scored.columns)


def subject_rank(det: DataFrame, limit: int | None = WINDOW_ROWS) -> DataFrame:
    """All detections of a frame with their place in the ordering, 1 for the primary subject."""
    order = [F.desc("score"), F.asc("_category"), F.asc("_position")]
    scored = _categorised(det).withColumns(
        {"_category": classes.category_rank(F.col("category")), "_position": _position(det)}
    )
    return number_within(scored, ["frame_key"], order, "subject_rank", limit).drop(
        "_category", "_position"
    )


def union_bbox(frames: DataFrame, det: DataFrame) -> DataFrame:
    """Per frame the box around all its detections; null where there are none."""
    around = det.groupBy("frame_key").agg(
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")
    )
    return frames.select(*schemas.FRAME_COLUMNS).join(around, "frame_key", "left")


def best_crops(crops: DataFrame, k: int) -> DataFrame:
    """The ``k`` best crops per video and category. Spark keeps ``k`` per task before it shuffles."""
    best_first = Window.partitionBy("video_id", "category").orderBy(F.desc("quality"), "frame_no")
    return crops.withColumn("place", F.row_number().over(best_first)).filter(F.col("place") <= k)
