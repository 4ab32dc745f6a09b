"""The whole dataflow: frames, detections and text regions to crops and outcomes."""

from __future__ import annotations

from dataclasses import replace
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelsift import schemas
from reelsift.operators.crops import CROP_COLUMNS, crop_box, crop_quality, with_head_space
from reelsift.operators.detections import model_subset
from reelsift.operators.subjects import primary_subject
from reelsift.operators.text import text_frames
from reelsift.operators.voting import FOLD_ROWS, ensemble
from reelsift.params import Params
from reelsift.sources.frames import frame_sample

SUBJECT_COLUMNS = ("category", "class_id", "confidence", *schemas.BOX_COLUMNS)


class Curated(NamedTuple):
    outcomes: DataFrame  # one row per sampled frame
    crops: DataFrame  # the rows with outcome 'saved'


def curate(
    frames: DataFrame,
    detections: DataFrame,
    regions: DataFrame | None = None,
    params: Params = Params(),
    group_limit: int | None = FOLD_ROWS,
) -> Curated:
    """Sample, drop text frames, find each frame's subject, crop it and judge the crop.

    Every step is keyed by frame, so detections are shuffled once and no video is a hot key.
    """
    sampled = frame_sample(frames.select(*schemas.FRAME_COLUMNS), params)
    found = sampled_detections = frame_sample(detections, params)
    if regions is not None and params.text_gate_active:
        texts = text_frames(frame_sample(regions, params), params)
        sampled = (
            sampled.join(texts.withColumn("is_text", F.lit(True)), "frame_key", "left")
            .withColumn("is_text", F.coalesce("is_text", F.lit(False)))
        )
        if params.ensemble:  # spares the vote; for one model the join below is enough
            found = found.join(texts, "frame_key", "left_anti")
    else:
        sampled = sampled.withColumn("is_text", F.lit(False))
    subjects = crop_subjects(found, params, group_limit, sampled_detections)
    outcomes = _with_outcome(sampled, subjects, params)
    # the null check is implied, but lets Spark turn the outer join into an inner one
    saved = F.col("crop_x").isNotNull() & (F.col("outcome") == "saved")
    return Curated(outcomes, outcomes.filter(saved).drop("outcome"))


def crop_subjects(
    detections: DataFrame,
    params: Params = Params(),
    group_limit: int | None = FOLD_ROWS,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Primary subject of each frame with detections, its crop and the crop's quality."""
    if params.ensemble:
        candidates = ensemble(detections, params, group_limit, sized_by, names=False)
    else:
        candidates = model_subset(detections, params.active_models)
    return crop_quality(crop_box(with_head_space(primary_subject(candidates)), params))


def outcome(is_text: Column, params: Params) -> Column:
    """What became of a frame, as a column over ``category``, ``crop_x`` and ``quality``."""
    return (
        F.when(is_text, "skipped_text")
        .when(F.col("category").isNull(), "skipped_no_detection")
        .when(F.col("crop_x").isNull(), "no_crop")
        .when(F.col("quality") > F.lit(params.min_quality), "saved")
        .otherwise("rejected_quality")
    )


def _with_outcome(sampled: DataFrame, crops: DataFrame, params: Params) -> DataFrame:
    kept = crops.select(F.col("frame_key").alias("_key"), *SUBJECT_COLUMNS, *CROP_COLUMNS, "quality")
    same_frame = (F.col("frame_key") == F.col("_key")) & ~F.col("is_text")
    return (
        sampled.join(kept, same_frame, "left")
        .withColumn("outcome", outcome(F.col("is_text"), params))
        .drop("_key", "is_text")
    )


def two_pass(
    frames: DataFrame,
    detections: DataFrame,
    regions: DataFrame | None = None,
    params: Params = Params(ensemble=True),
    group_limit: int | None = FOLD_ROWS,
) -> DataFrame:
    """Quick look with one model, then consensus of all models on the frames it saved."""
    chosen = curate(frames, detections, regions, replace(params, ensemble=False)).crops
    found = frame_sample(detections, params)
    return ensemble(found.join(chosen.select("frame_key"), "frame_key", "left_semi"), params, group_limit, found)
