"""Box arithmetic as column expressions; everything stays inside whole-stage codegen."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ratios a crop format stands for, and the one taken for any other name.
ASPECT_RATIOS = {"9:16": 9 / 16, "3:4": 3 / 4, "1:1": 1.0, "4:5": 4 / 5}
DEFAULT_RATIO = 9 / 16
STRICT_RATIOS = {"16:9": 16 / 9, "4:3": 4 / 3}


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def named(cls, prefix: str = "") -> Box:
        return cls(*(F.col(prefix + c) for c in ("x1", "y1", "x2", "y2")))

    @classmethod
    def field_of(cls, struct: Column) -> Box:
        return cls(*(struct[c] for c in ("x1", "y1", "x2", "y2")))

    @property
    def area(self) -> Column:
        return (self.x2 - self.x1).cast("bigint") * (self.y2 - self.y1)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 for disjoint, touching and empty boxes."""
    wide = F.greatest(F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1), F.lit(0))
    high = F.greatest(F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1), F.lit(0))
    shared = wide.cast("bigint") * high
    union = a.area + b.area - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def head_space(y1: Column, frame_height: Column) -> Column:
    return F.when(frame_height > 0, y1 / frame_height).otherwise(F.lit(0.0))


def aspect_ratio(fmt: Column, strict: bool = False) -> Column:
    known = ASPECT_RATIOS | (STRICT_RATIOS if strict else {})
    value = F.lit(DEFAULT_RATIO)
    for name, ratio in known.items():
        value = F.when(fmt == name, F.lit(ratio)).otherwise(value)
    return value


def clamp(value: Column, upper: Column) -> Column:
    """Into [0, upper]; 0 wins where upper is negative. Null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0), F.least(value, upper)))


def half(value: Column) -> Column:
    """Floor of value / 2, also below zero (an integer division would truncate)."""
    return F.shiftright(value, 1)


def truncated(value: Column) -> Column:
    return value.cast("int")
