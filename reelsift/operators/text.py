"""Finding frames with subtitles, and dropping them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelsift import schemas
from reelsift.params import Params


def strip_rows(height: Column, params: Params = Params()) -> Column:
    """Height of the subtitle strip at the bottom of a frame."""
    return height - (height * F.lit(1 - params.strip_height)).cast("int")


def looks_like_text(
    ry: Column, rw: Column, rh: Column, width: Column, height: Column, params: Params = Params()
) -> Column:
    """Whether a region of the strip is wide, large enough and not at the strip's top."""
    elongation = F.when(rh > 0, rw / rh).otherwise(F.lit(0.0))
    return (
        (elongation > F.lit(2.5))
        & (rw > width * F.lit(0.08))
        & (rw.cast("bigint") * rh > 100)
        & (ry > strip_rows(height, params) * F.lit(0.3))
    )


def region_predicate(regions: DataFrame, params: Params = Params()) -> DataFrame:
    """The text-like regions."""
    columns = (F.col(c) for c in ("ry", "rw", "rh", "width", "height"))
    return regions.filter(looks_like_text(*columns, params))


def text_frames(regions: DataFrame, params: Params = Params()) -> DataFrame:
    """Keys of the frames with at least two text-like regions."""
    return (
        region_predicate(regions, params)
        .groupBy("frame_key")
        .agg(F.count(F.lit(1)).alias("_regions"))
        .filter(F.col("_regions") >= 2)
        .select("frame_key")
    )


def text_quick(frames: DataFrame, regions: DataFrame, params: Params = Params()) -> DataFrame:
    """Every frame with ``text_regions`` and the flag ``is_text``."""
    found = (
        region_predicate(regions, params)
        .groupBy("frame_key")
        .agg(F.count(F.lit(1)).alias("text_regions"))
    )
    return (
        frames.select(*schemas.FRAME_COLUMNS)
        .join(found, "frame_key", "left")
        .fillna(0, ["text_regions"])
        .withColumn("is_text", F.col("text_regions") >= 2)
    )


def text_ocr(
    frames: DataFrame,
    ocr: DataFrame | None,
    params: Params = Params(),
    strip_only: bool = True,
    regions: DataFrame | None = None,
) -> DataFrame:
    """Share of the strip (or frame) under OCR quads, and whether it is enough to call it text.

    Quads count by their axis-aligned area, overlaps twice. Without OCR the quick check of ``regions``
    decides, and shares are 0.
    """
    if ocr is None:
        if regions is None:
            raise ValueError("without OCR results, give regions for the quick check")
        quick = text_quick(frames, regions, params)
        return quick.select(*schemas.FRAME_COLUMNS, F.lit(0.0).alias("text_ratio"), F.col("is_text").alias("has_text"))

    def extent(axis: str) -> Column:
        values = F.transform("poly", lambda p: p[axis])
        return F.array_max(values) - F.array_min(values)

    covered = ocr.groupBy("frame_key").agg(F.sum(extent("x") * extent("y")).alias("_covered"))
    rows = strip_rows(F.col("height"), params) if strip_only else F.col("height")
    surface = rows.cast("bigint") * F.col("width")
    ratio = F.when(surface > 0, F.coalesce("_covered", F.lit(0.0)) / surface).otherwise(F.lit(0.0))
    return (
        frames.select(*schemas.FRAME_COLUMNS)
        .join(covered, "frame_key", "left")
        .withColumn("text_ratio", ratio)
        .withColumn("has_text", F.col("text_ratio") > F.lit(params.min_text_ratio))
        .drop("_covered")
    )


def text_gate(
    rows: DataFrame, regions: DataFrame | None, params: Params = Params()
) -> DataFrame:
    """Drop the rows of text frames. Nothing is dropped without regions or with a check turned off."""
    if regions is None or not params.text_gate_active:
        return rows
    return rows.join(text_frames(regions, params), "frame_key", "left_anti")
