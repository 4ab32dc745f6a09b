"""Explicit schemas of the tables the operators exchange, and a check at operator entry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

FRAME_COLUMNS = ("video_id", "frame_no", "frame_key", "width", "height")
BOX_COLUMNS = ("x1", "y1", "x2", "y2")

INT, LONG, DOUBLE, STRING = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_frame = {c: LONG if c == "frame_key" else INT for c in FRAME_COLUMNS}
_pixels = {c: DOUBLE for c in BOX_COLUMNS}
_boxes = {c: INT for c in BOX_COLUMNS}
_rect = {"rx": INT, "ry": INT, "rw": INT, "rh": INT}
_image = _struct(
    origin=STRING, height=INT, width=INT, nChannels=INT, mode=INT, data=T.BinaryType()
)

MANIFEST = _struct(path=STRING)
VIDEOS = _struct(
    video_id=INT, path=STRING, width=INT, height=INT, fps=DOUBLE, total_frames=INT
)
FRAMES = _struct(**_frame)
PIXELS = _struct(**_frame, image=_image)
RAW = _struct(**_frame, model_source=STRING, det_seq=INT, score=DOUBLE, label=INT, **_pixels)
DETECTIONS = _struct(
    **_frame, model_source=STRING, det_seq=INT, **_boxes, confidence=DOUBLE, class_id=INT
)
REGIONS = _struct(**_frame, line_no=INT, **_rect)
OCR = _struct(**_frame, poly=T.ArrayType(_struct(x=DOUBLE, y=DOUBLE)))
NESTED_DETECTION = _struct(
    det_seq=INT, model_source=STRING, class_id=INT, confidence=DOUBLE, **_boxes
)
NESTED = _struct(
    **_frame,
    detections=T.ArrayType(NESTED_DETECTION),
    regions=T.ArrayType(_struct(**_rect)),
)


def require(df: DataFrame, schema: T.StructType, what: str) -> DataFrame:
    """Fail early when ``df`` lacks a column of ``schema`` or has it with another type."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    wrong = [
        f"{f.name} {f.dataType.simpleString()} (got {have.get(f.name, 'nothing')})"
        for f in schema.fields
        if have.get(f.name) != f.dataType.simpleString()
    ]
    if wrong:
        raise ValueError(f"{what}: expected {', '.join(wrong)}")
    return df
