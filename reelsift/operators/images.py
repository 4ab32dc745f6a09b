"""Jobs on pixels: user-supplied detectors and text finders, and cutting crops.

Pixels travel as Spark's ``image`` struct (BGR rows of bytes). Python sees only what it needs, in
Arrow batches that Spark bounds by rows and bytes (``spark.sql.execution.arrow.maxRecordsPerBatch``
and ``maxBytesPerBatch``). Filter and select before these jobs: Catalyst moves nothing through them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelsift import schemas
from reelsift.operators.crops import CROP_COLUMNS
from reelsift.operators.text import strip_rows
from reelsift.params import Params

# A model maps a batch of H x W x C arrays to one list of result tuples per array.
Model = Callable[[Sequence[np.ndarray]], Sequence[Iterable[tuple]]]

_loaded: dict[str, Model] = {}  # per Python worker, which Spark reuses across tasks


def infer_detections(
    frames: DataFrame, name: str, make_model: Callable[[], Model], params: Params = Params()
) -> DataFrame:
    """Raw detections of one model on a pixel table.

    ``make_model`` is called once per Python worker, again where its code or settings differ. Results
    are tuples ``(label, score, x1, y1, x2, y2)``, in the model's order, which becomes ``det_seq``. A model
    that gives no list for one of its frames fails the job.
    """
    found = _job(
        frames, make_model, params,
        "label INT, score DOUBLE, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE",
    )
    return found.withColumn("model_source", F.lit(name)).select(*schemas.RAW.names)


def extract_regions(
    frames: DataFrame, name: str, make_model: Callable[[], Model], params: Params = Params()
) -> DataFrame:
    """Bounding rectangles ``(rx, ry, rw, rh)`` that a text finder sees in the subtitle strip.

    The strip is cut from the pixels in the JVM, so the rest of the frame never reaches Python.
    """
    rows = strip_rows(F.col("image.height"), params)
    line_bytes = F.col("image.width") * F.col("image.nChannels")
    skipped = (F.col("image.height") - rows) * line_bytes
    strip = F.struct(
        F.col("image.origin").alias("origin"),
        rows.alias("height"),
        F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("nChannels"),
        F.col("image.mode").alias("mode"),
        F.substring("image.data", skipped + 1, rows * line_bytes).alias("data"),
    )
    found = _job(
        frames.withColumn("image", strip), make_model, params,
        "rx INT, ry INT, rw INT, rh INT",
    )
    return found.withColumnRenamed("det_seq", "line_no").select(*schemas.REGIONS.names)


def _job(
    frames: DataFrame, make_model: Callable[[], Model], params: Params, result: str
) -> DataFrame:
    key = hashlib.sha256(cloudpickle.dumps((make_model, result))).hexdigest()
    frame = frames.select(*schemas.FRAME_COLUMNS).schema
    fields = T.StructType.fromDDL(result).fields
    output = T.StructType([*frame.fields, T.StructField("det_seq", T.IntegerType()), *fields])
    size = params.batch_size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(key, make_model)
        for batch in batches:
            arrays = _arrays(batch)
            columns = [batch[c].tolist() for c in schemas.FRAME_COLUMNS]
            keys = list(zip(*columns))
            rows = []
            for start in range(0, len(keys), size):
                part = slice(start, start + size)
                for frame_key, results in zip(keys[part], model(arrays[part]), strict=True):
                    rows.extend((*frame_key, i, *r) for i, r in enumerate(results, 1))
            yield pd.DataFrame(rows, columns=output.names)

    return _flat(frames).mapInPandas(run, output)


def _model(key: str, make_model: Callable[[], Model]) -> Model:
    if key not in _loaded:
        _loaded[key] = make_model()
    return _loaded[key]


def _flat(frames: DataFrame, *columns: str) -> DataFrame:
    return frames.select(
        *schemas.FRAME_COLUMNS,
        *columns,
        F.col("image.height").alias("_h"),
        F.col("image.width").alias("_w"),
        F.col("image.nChannels").alias("_c"),
        F.col("image.data").alias("_data"),
    )


def _arrays(batch: pd.DataFrame) -> list[np.ndarray]:
    return [
        np.frombuffer(data, np.uint8).reshape(h, w, c)
        for data, h, w, c in zip(batch["_data"], batch["_h"], batch["_w"], batch["_c"])
    ]


def crop_pixels(frames: DataFrame, crops: DataFrame) -> DataFrame:
    """The pixels inside each crop box, as an ``image`` column.

    Crops hold keys and boxes only and join back by ``(video_id, frame_no)``. Keep the pixel table
    bucketed by these (``write_pixels``), then only the crops are shuffled, never pixels.
    """
    boxes = crops.select("video_id", "frame_no", *CROP_COLUMNS, *(
        c for c in ("category", "quality") if c in crops.columns
    ))
    carried = [c for c in boxes.columns if c not in schemas.FRAME_COLUMNS]
    joined = frames.join(boxes, ["video_id", "frame_no"])
    flat = _flat(joined.withColumn("_mode", F.col("image.mode")), *carried, "_mode")
    output = T.StructType([f for f in flat.schema.fields if f.name not in ("_h", "_w")])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spots = zip(*(batch[c].tolist() for c in CROP_COLUMNS))
            batch["_data"] = [
                pixels[y : y + h, x : x + w].tobytes()
                for pixels, (x, y, w, h) in zip(_arrays(batch), spots)
            ]
            yield batch[output.names]

    image = F.struct(
        F.lit("").alias("origin"),
        F.col("crop_h").alias("height"),
        F.col("crop_w").alias("width"),
        F.col("_c").alias("nChannels"),
        F.col("_mode").alias("mode"),
        F.col("_data").alias("data"),
    )
    return flat.mapInPandas(cut, output).withColumn("image", image).drop("_c", "_mode", "_data")


def place_frames(frames: DataFrame, buckets: int) -> DataFrame:
    """``frames``, still without pixels, each in the task that writes its bucket, in order."""
    return frames.repartition(buckets, "video_id", "frame_no").sortWithinPartitions("video_id", "frame_no")


def write_pixels(frames: DataFrame, table: str, buckets: int, path: str | None = None, placed: bool = False) -> None:
    """Save a pixel table bucketed and sorted by frame, for joins that leave pixels in place.

    It lies at ``path``, or in the warehouse. Where ``place_frames`` came before pixels were read, say so by
    ``placed``: then keys have been shuffled and sorted, and pixels are only written.
    """
    if placed:
        writer = frames.write.mode("overwrite").bucketBy(buckets, "video_id", "frame_no")
    else:
        writer = (
            frames.repartition(buckets, "video_id", "frame_no")
            .write.mode("overwrite")
            .bucketBy(buckets, "video_id", "frame_no")
            .sortBy("video_id", "frame_no")
        )
    (writer.option("path", path) if path else writer).saveAsTable(table)
