"""Crop boxes, their quality, and zoom. Chains of projections that fuse into one codegen stage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelsift.functions.geometry import (
    ASPECT_RATIOS,
    DEFAULT_RATIO,
    STRICT_RATIOS,
    Box,
    clamp,
    half,
    head_space,
    truncated,
)
from reelsift.params import Params

CROP_COLUMNS = ("crop_x", "crop_y", "crop_w", "crop_h")


def format_ratio(params: Params) -> float:
    known = ASPECT_RATIOS | (STRICT_RATIOS if params.strict_formats else {})
    return known.get(params.crop_format, DEFAULT_RATIO)


def with_head_space(subjects: DataFrame) -> DataFrame:
    """Share of the frame above a person; 0 for any other subject."""
    above = head_space(F.col("y1"), F.col("height"))
    return subjects.withColumn(
        "head_space", F.when(F.col("category") == "person", above).otherwise(F.lit(0.0))
    )


def crop_box(
    subjects: DataFrame, params: Params = Params(), ratio: Column | None = None
) -> DataFrame:
    """Add ``crop_x, crop_y, crop_w, crop_h`` for the subject box of each row.

    Pad the subject, widen or heighten to the ratio, shrink to fit the frame, shift for head space,
    centre, clamp. All four are null where padded height or crop side is zero. ``ratio`` may differ
    by row; by default it is that of the run's format.
    """
    if "head_space" not in subjects.columns:
        subjects = with_head_space(subjects)
    ratio = F.lit(format_ratio(params)) if ratio is None else ratio
    c, box = F.col, Box.named()
    padded = subjects.withColumns(
        {
            "_ratio": ratio,
            "_pw": box.x2 - box.x1 + 2 * params.padding,
            "_ph": box.y2 - box.y1 + 2 * params.padding,
        }
    ).withColumn("_wide", F.when(c("_ph") != 0, c("_pw") / c("_ph") > c("_ratio")))
    shaped = padded.withColumns(
        {
            "_cw": F.when(c("_wide"), c("_pw")).when(~c("_wide"), truncated(c("_ph") * c("_ratio"))),
            "_ch": F.when(c("_wide"), truncated(c("_pw") / c("_ratio"))).when(~c("_wide"), c("_ph")),
        }
    )
    fits = (c("_cw") <= c("width")) & (c("_ch") <= c("height"))
    shrink = F.least(c("width") / c("_cw"), c("height") / c("_ch"))
    fitted = shaped.withColumn(
        "_scale", F.when(fits, F.lit(1.0)).when((c("_cw") != 0) & (c("_ch") != 0), shrink)
    ).withColumns(
        {
            "crop_w": truncated(c("_cw") * c("_scale")),
            "crop_h": truncated(c("_ch") * c("_scale")),
        }
    )
    nudge = truncated(c("crop_h") * F.lit(0.1))
    shift = (
        F.when((c("category") != "person") | (c("head_space") <= 0), 0)
        .when(c("head_space") < F.lit(params.min_head_space), -nudge)
        .when(c("head_space") > F.lit(params.max_head_space), nudge)
        .otherwise(0)
    )
    placed = (
        fitted.withColumn("_shift", shift)
        .withColumns(
            {
                "_left": half(box.x1 + box.x2) - half(c("crop_w")),
                "_top": half(box.y1 + box.y2) + c("_shift") - half(c("crop_h")),
            }
        )
        .withColumns(
            {
                "crop_x": clamp(c("_left"), c("width") - c("crop_w")),
                "crop_y": clamp(c("_top"), c("height") - c("crop_h")),
            }
        )
    )
    return _computed_once(placed, subjects.columns, CROP_COLUMNS)


def _computed_once(df: DataFrame, keep: Sequence[str], computed: Sequence[str]) -> DataFrame:
    """Hand ``computed`` on through a one-row generator.

    Spark would rewrite a later filter on these columns in terms of the first inputs, where every
    shared step of the chain is spelled out again and again. It does not look behind a generator.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*computed))))


def crop_quality(crops: DataFrame) -> DataFrame:
    """Add ``quality``: nearness of the subject's share of the crop to 0.45, less edge penalties."""
    c = F.col
    crop_area = c("crop_w").cast("bigint") * c("crop_h")
    coverage = F.when(crop_area > 0, Box.named().area / crop_area).otherwise(F.lit(0.0))
    near_origin = (c("crop_x") <= 10) | (c("crop_y") <= 10)
    near_end = (c("crop_x") + c("crop_w") >= c("width") - 10) | (
        c("crop_y") + c("crop_h") >= c("height") - 10
    )
    edges = [F.when(edge, F.lit(0.1)).otherwise(F.lit(0.0)) for edge in (near_origin, near_end)]
    penalty = edges[0] + edges[1]
    score = F.lit(1.0) - F.abs(F.lit(0.45) - c("_coverage")) - c("_penalty")
    return (
        crops.withColumns({"_coverage": coverage, "_penalty": penalty})
        .withColumn("quality", F.when(c("crop_x").isNotNull(), F.greatest(F.lit(0.0), score)))
        .drop("_coverage", "_penalty")
    )


def quality_gate(crops: DataFrame, params: Params = Params()) -> DataFrame:
    return crops.filter(F.col("quality") > F.lit(params.min_quality))


def zoom_box(crops: DataFrame, factor: float = 1.2) -> DataFrame:
    """Add ``zoom_x, zoom_y, zoom_w, zoom_h``: the crop shrunk around its centre and clamped."""
    c = F.col
    return (
        crops.withColumns(
            {
                "zoom_w": truncated(c("crop_w") / F.lit(float(factor))),
                "zoom_h": truncated(c("crop_h") / F.lit(float(factor))),
            }
        )
        .withColumns(
            {
                "_left": c("crop_x") + half(c("crop_w")) - half(c("zoom_w")),
                "_top": c("crop_y") + half(c("crop_h")) - half(c("zoom_h")),
            }
        )
        .withColumns(
            {
                "zoom_x": clamp(c("_left"), c("width") - c("zoom_w")),
                "zoom_y": clamp(c("_top"), c("height") - c("zoom_h")),
            }
        )
        .drop("_left", "_top")
    )
