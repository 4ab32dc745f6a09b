"""One query per operator, each over the whole of its tables."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contract import toys
from contract.tables import Tables, tables
from reelsift.functions.classes import CATEGORIES
from reelsift.functions.geometry import Box, aspect_ratio, iou
from reelsift.operators import crops, detections, images, stats, subjects, text, voting
from reelsift.params import MODELS, Params
from reelsift.plans.curate import crop_subjects, curate, two_pass
from reelsift.session import scratch_path
from reelsift.sources import crop_sink, frames, manifest
from reelsift.streaming import curate_stream, long_rows, rates, sinks

ONE = Params(interval=1)
ALL = replace(ONE, ensemble=True)
PAIR = replace(ALL, models=("yolo", "detr"), voting_threshold=3)
FORMATS = ("9:16", "3:4", "1:1", "4:5", "16:9", "4:3")
SMALL_CROP = Params(crop_format="1:1", padding=4)
CROPS = ["video_id", "frame_no", "frame_key", "category", *crops.CROP_COLUMNS, "quality"]
KEY = ["frame_key", "det_seq"]

_registry: dict[str, Callable[[Tables], DataFrame]] = {}
_shipped: set[str] = set()


def query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    _registry[build.__name__.rstrip("_")] = build
    return build


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            _ship(spark)
            return build(tables(spark, sf_dir))

        return run

    return {name: runner(build) for name, build in _registry.items()}


def _ship(spark: SparkSession) -> None:
    """Give the executors' Python workers these packages, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    bundle = os.path.join(tempfile.mkdtemp(prefix="spark-"), "reelsift_bundle.zip")
    with zipfile.ZipFile(bundle, "w") as z:
        for package in ("reelsift", "contract"):
            for source in sorted((root / package).rglob("*.py")):
                z.write(source, source.relative_to(root))
    spark.sparkContext.addPyFile(bundle)
    _shipped.add(app)


# --- sources and sinks -------------------------------------------------------------------------


@query
def video_manifest(t: Tables) -> DataFrame:
    return manifest.video_manifest(t.manifest)


@query
def video_info(t: Tables) -> DataFrame:
    return frames.video_info(t.videos)


@query
def frame_scan(t: Tables) -> DataFrame:
    return frames.frame_scan(t.positions(), F.col("frame_key"))


@query
def frame_sample(t: Tables) -> DataFrame:
    return frames.frame_sample(t.frames, Params())


@query
def frame_lookup(t: Tables) -> DataFrame:
    """Per video frame 29, the last one, and one past the end."""
    indexes = F.explode(F.array(F.lit(29), F.col("total_frames") - 1, F.col("total_frames")))
    requests = t.videos.select("video_id", indexes.alias("frame_index"))
    return frames.frame_lookup(t.frames.select("video_id", "frame_no", "frame_key"), requests)


@query
def output_run_name(t: Tables) -> DataFrame:
    paths = manifest.video_manifest(t.manifest)
    turbo = crop_sink.output_run_name(paths, Params())
    plain = crop_sink.output_run_name(paths, Params(crop_format="1:1", ensemble=True, turbo=False))
    return turbo.unionByName(plain)


@query
def crop_filename(t: Tables) -> DataFrame:
    return crop_sink.crop_filename(crop_subjects(t.det, ONE)).select("frame_key", "file_name")


@query
def crop_manifest(t: Tables) -> DataFrame:
    done = curate(t.frames, t.det, t.regions, ONE)
    return crop_sink.crop_manifest(done.crops, t.videos, ONE)


@query
def class_map(t: Tables) -> DataFrame:
    """By a table of ids: here the classes that occur, each mapped by the size of its id."""
    name = F.when(F.col("class_id") < 10, "person").otherwise("animal")
    mapping = t.det.filter("class_id <> 2").select("class_id", name.alias("category"))
    return detections.class_map(t.det, mapping).select(*KEY, "class_id", "category")


# --- detections --------------------------------------------------------------------------------


@query
def det_normalise(t: Tables) -> DataFrame:
    return detections.det_normalise(t.raw)


@query
def det_normalise_canonical(t: Tables) -> DataFrame:
    """Labels spread over the whole 91-entry list."""
    spread = t.raw.withColumn("label", ((F.col("frame_key") + F.col("label")) % 93).cast("int"))
    return detections.det_normalise(spread, Params(label_map="canonical"))


@query
def det_categorise(t: Tables) -> DataFrame:
    return detections.det_categorise(t.det).select(*KEY, "class_id", "category")


@query
def det_categorise_nested(t: Tables) -> DataFrame:
    return detections.categorise_nested(t.nested).select(
        "frame_key",
        *(F.coalesce(F.size(c), F.lit(0)).cast("bigint").alias(f"{c}s") for c in CATEGORIES),
    )


@query
def model_subset(t: Tables) -> DataFrame:
    return detections.model_subset(t.det, ("yolo", "fasterrcnn"))


@query
def all_detections(t: Tables) -> DataFrame:
    per_model = {m: detections.model_subset(t.det, [m]) for m in MODELS}
    return detections.all_detections(per_model).select(*KEY, "model_source", "x1", "y1", "confidence")


@query
def detection_stats(t: Tables) -> DataFrame:
    return detections.detection_stats(t.det, ALL)


# --- text --------------------------------------------------------------------------------------


@query
def region_predicate(t: Tables) -> DataFrame:
    return text.region_predicate(t.regions)


@query
def text_quick(t: Tables) -> DataFrame:
    return text.text_quick(t.frames, t.regions)


@query
def text_ocr(t: Tables) -> DataFrame:
    return text.text_ocr(t.frames, t.ocr)


@query
def text_ocr_frame(t: Tables) -> DataFrame:
    return text.text_ocr(t.frames, t.ocr, strip_only=False)


@query
def text_ocr_fallback(t: Tables) -> DataFrame:
    """No OCR at hand: the quick check decides."""
    return text.text_ocr(t.frames, None, regions=t.regions)


@query
def text_gate(t: Tables) -> DataFrame:
    return text.text_gate(t.frames, t.regions)


# --- matching and voting -----------------------------------------------------------------------


@query
def iou_(t: Tables) -> DataFrame:
    """IoU of each detection with the next one of its frame."""
    here = t.det.select(*KEY, "x1", "y1", "x2", "y2")
    ahead = here.select(
        "frame_key",
        (F.col("det_seq") - 1).alias("det_seq"),
        *(F.col(c).alias(f"o_{c}") for c in ("x1", "y1", "x2", "y2")),
    )
    pairs = here.join(ahead, KEY)
    return pairs.select(*KEY, iou(Box.named(), Box.named("o_")).alias("iou"))


@query
def iou_pairs(t: Tables) -> DataFrame:
    return voting.iou_pairs(t.det)


@query
def vote_groups(t: Tables) -> DataFrame:
    return voting.vote_groups(t.det, limit=t.group_limit).select(*KEY, "class_id", "model_source", "gid")


@query
def vote_groups_crowded(t: Tables) -> DataFrame:
    return voting.vote_groups(t.crowded).select(*KEY, "class_id", "gid")


@query
def consensus(t: Tables) -> DataFrame:
    return voting.ensemble(t.det, ALL, t.group_limit)


@query
def effective_threshold(t: Tables) -> DataFrame:
    """Three votes asked of two models: two are enough."""
    return voting.ensemble(t.det, PAIR, t.group_limit)


# --- subjects ----------------------------------------------------------------------------------


@query
def bbox_area_score(t: Tables) -> DataFrame:
    return subjects.with_score(t.det).select(*KEY, "area", "score")


@query
def primary_subject(t: Tables) -> DataFrame:
    return subjects.primary_subject(t.det).drop("model_source", "class_name")


@query
def primary_subject_ensemble(t: Tables) -> DataFrame:
    """Names, which are not asked for, are not carried through the votes."""
    return subjects.primary_subject(voting.ensemble(t.det, ALL, t.group_limit, names=False)).drop("class_name")


@query
def subject_rank(t: Tables) -> DataFrame:
    return subjects.subject_rank(t.det).select(*KEY, "category", "score", "subject_rank")


@query
def union_bbox(t: Tables) -> DataFrame:
    return subjects.union_bbox(t.frames, t.det)


@query
def best_crops(t: Tables) -> DataFrame:
    done = curate(t.frames, t.det, t.regions, ONE)
    return subjects.best_crops(done.crops, 5).select("video_id", "category", "place", "frame_no", "quality")


# --- crops -------------------------------------------------------------------------------------


def _subjects_by_format(t: Tables) -> DataFrame:
    found = subjects.primary_subject(t.det).drop("model_source", "class_name")
    return found.withColumn("format", F.explode(F.array(*(F.lit(f) for f in FORMATS))))


@query
def head_space(t: Tables) -> DataFrame:
    found = crops.with_head_space(subjects.primary_subject(t.det))
    return found.select("frame_key", "category", "head_space")


@query
def aspect_ratio_(t: Tables) -> DataFrame:
    formats = t.frames.select(
        "frame_key",
        F.get(F.array(*(F.lit(f) for f in FORMATS)), (F.col("frame_key") % 6).cast("int")).alias("format"),
    )
    return formats.select(
        "frame_key",
        "format",
        aspect_ratio(F.col("format")).alias("ratio"),
        aspect_ratio(F.col("format"), strict=True).alias("strict_ratio"),
    )


@query
def crop_box(t: Tables) -> DataFrame:
    cropped = crops.crop_box(_subjects_by_format(t), Params(), aspect_ratio(F.col("format")))
    return cropped.select("frame_key", "format", *crops.CROP_COLUMNS)


@query
def crop_box_strict(t: Tables) -> DataFrame:
    """True 16:9, little padding."""
    wide = Params(crop_format="16:9", strict_formats=True, padding=20)
    found = subjects.primary_subject(t.det)
    return crops.crop_box(found, wide).select("frame_key", *crops.CROP_COLUMNS)


@query
def crop_quality(t: Tables) -> DataFrame:
    cropped = crops.crop_box(_subjects_by_format(t), Params(padding=100), aspect_ratio(F.col("format")))
    return crops.crop_quality(cropped).select("frame_key", "format", "quality")


@query
def quality_gate(t: Tables) -> DataFrame:
    return crops.quality_gate(crop_subjects(t.det, ONE)).select(CROPS)


@query
def zoom_box(t: Tables) -> DataFrame:
    zoomed = crops.zoom_box(crop_subjects(t.det, ONE), 1.2)
    return zoomed.select("frame_key", "zoom_x", "zoom_y", "zoom_w", "zoom_h")


# --- whole runs and statistics -----------------------------------------------------------------


@query
def curate_single(t: Tables) -> DataFrame:
    return curate(t.frames, t.det, t.regions, ONE).crops.select(CROPS)


@query
def curate_ensemble(t: Tables) -> DataFrame:
    return curate(t.frames, t.det, t.regions, ALL, t.group_limit).crops.select(CROPS)


@query
def frame_outcomes(t: Tables) -> DataFrame:
    every = replace(ALL, crop_format="4:5", padding=100)
    return curate(t.frames, t.det, t.regions, every, t.group_limit).outcomes.select("video_id", "frame_no", "outcome")


@query
def two_pass_(t: Tables) -> DataFrame:
    return two_pass(t.frames, t.det, t.regions, ALL, t.group_limit)


@query
def video_stats(t: Tables) -> DataFrame:
    return stats.video_stats(curate(t.frames, t.det, t.regions, ONE).outcomes, t.videos, ONE)


@query
def video_stats_standard(t: Tables) -> DataFrame:
    plain = replace(ALL, turbo=False)
    return stats.video_stats(curate(t.frames, t.det, t.regions, plain, t.group_limit).outcomes, t.videos, plain)


@query
def overall_stats(t: Tables) -> DataFrame:
    """With the running time of each video standing in for the time its processing took."""
    elapsed = frames.video_info(t.videos).withColumnRenamed("duration", "processing_time")
    done = curate(t.frames, t.det, t.regions, ONE).outcomes
    processed = stats.video_stats(done, t.videos, ONE, elapsed)
    overall = stats.overall_stats(processed, t.videos)
    return overall.withColumn("total_time", F.round("total_time", 6))


@query
def processing_fps(t: Tables) -> DataFrame:
    """With the running time of each video standing in for the time its processing took."""
    elapsed = frames.video_info(t.videos).withColumnRenamed("duration", "processing_time")
    done = curate(t.frames, t.det, t.regions, ONE).outcomes
    timed = stats.video_stats(done, t.videos, ONE, elapsed)
    return stats.processing_fps(timed).select(
        "video_id", "processed_frames", "processing_time", "processing_fps"
    )


@query
def progress_pct(t: Tables) -> DataFrame:
    return frames.progress_pct(t.frames, t.videos, ONE)


# --- pixels ------------------------------------------------------------------------------------


@query
def infer_detections(t: Tables) -> DataFrame:
    return images.infer_detections(t.pixels, "yolo", toys.make_detector)


@query
def extract_regions(t: Tables) -> DataFrame:
    return images.extract_regions(t.pixels, "bright", toys.make_region_finder)


@query
def crop_pixels(t: Tables) -> DataFrame:
    """Size and sum of all bytes of each crop around the rectangle."""
    found = detections.det_normalise(images.infer_detections(t.pixels, "yolo", toys.make_detector))
    cut = images.crop_pixels(t.pixels, crop_subjects(found, SMALL_CROP))
    data = F.col("image.data")
    return cut.select(
        "frame_key",
        "image.width",
        "image.height",
        F.length(data).alias("bytes"),
        F.pandas_udf(toys.byte_sums, "bigint")(data).alias("total"),
    )


# --- streams -----------------------------------------------------------------------------------


@query
def stream_harvest(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "stream-crops")
    checkpoint = scratch_path(t.spark, "stream-crops-state")
    curate_stream.stream_crops(t.nested_stream(), path, checkpoint, ALL).awaitTermination()
    return t.spark.read.parquet(path).select(CROPS)


@query
def stream_stats(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "stream-stats")
    checkpoint = scratch_path(t.spark, "stream-stats-state")
    curate_stream.stream_stats(t.nested_stream(), path, checkpoint, ONE).awaitTermination()
    return curate_stream.read_stats(t.spark.read.parquet(path))


def _places(t: Tables, name: str) -> tuple[str, str, str]:
    """Fresh folders: input, output and checkpoint."""
    return tuple(scratch_path(t.spark, f"{name}-{part}") for part in ("in", "out", "state"))


def _stream(t: Tables, df: DataFrame, path: str, **options) -> DataFrame:
    return t.spark.readStream.schema(df.schema).options(**options).parquet(path)


LONG_AGO, FAR_AHEAD = "1000 days", 10**9  # delay and seconds: only a row far ahead ends the wait for a frame


@query
def stream_long_rows(t: Tables) -> DataFrame:
    """Single rows, one source after the other: frames are complete when the last source has come."""
    source, out, state = _places(t, "long-rows")
    rows = t.long_rows()
    for arriving in ("yolo", "detr", "regions", "fasterrcnn"):
        rows.filter(F.col("source") == arriving).write.mode("append").parquet(source)
        with long_rows.state_store(t.spark):
            whole = long_rows.gather_frames(_stream(t, rows, source), ALL, delay=LONG_AGO)
            kept = whole.filter(F.col("status") != long_rows.LATE).drop("status")
            curate_stream.stream_crops(kept, out, state, ALL).awaitTermination()
    return t.spark.read.parquet(out).select(CROPS)


@query
def stream_late_rows(t: Tables) -> DataFrame:
    """What becomes of frames and rows when every fifth frame lacks a model's rows until it is too late,
    and other rows come twice."""
    source, out, state = _places(t, "late-rows")
    rows = t.long_rows()
    withheld = (F.col("frame_key") % 5 == 0) & (F.col("source") == "fasterrcnn") & F.col("n_rows").isNull()
    again = (F.col("frame_key") % 5 == 1) & (F.col("source") == "yolo") & F.col("n_rows").isNull()
    ahead = rows.limit(1).withColumns({"event_time": F.timestamp_seconds(F.lit(FAR_AHEAD)), "frame_key": F.lit(-1).cast("long")})
    dropped = 0
    for arriving in (rows.filter(~withheld), rows.filter(again), ahead, rows.filter(withheld)):
        arriving.write.mode("append").parquet(source)
        with long_rows.state_store(t.spark):
            whole = long_rows.gather_frames(_stream(t, rows, source), ALL, delay=LONG_AGO)
            run = whole.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
            run = run.trigger(availableNow=True).start()
            run.awaitTermination()
        dropped += long_rows.late_rows(run)
    by_status = t.spark.read.parquet(out).groupBy("status").agg(
        F.count("*").alias("frames"), F.sum(F.size("detections")).alias("detections"), F.sum(F.size("regions")).alias("regions")
    )
    return by_status.unionByName(t.spark.createDataFrame([("dropped", 0, dropped, 0)], by_status.schema))


@query
def stream_two_pass(t: Tables) -> DataFrame:
    """The quick look comes first, all models' detections in a second run."""
    (quick_in, out, state), (full_in, _, _) = _places(t, "two-pass"), _places(t, "two-pass-full")
    full = t.nested.withColumn("event_time", t.event_time)
    quick = full.withColumn("detections", F.filter("detections", lambda d: d["model_source"] == MODELS[0]))
    full.limit(0).write.parquet(full_in)
    for df, path in ((quick, quick_in), (full, full_in)):
        df.write.mode("append").parquet(path)
        streams = _stream(t, quick, quick_in), _stream(t, full, full_in)
        sinks.stream_two_pass(*streams, out, state, ALL, delay=LONG_AGO).awaitTermination()
    return t.spark.read.parquet(out).drop("batch")


@query
def stream_manifest(t: Tables) -> DataFrame:
    _, out, state = _places(t, "manifest")
    sinks.stream_manifest(t.nested_stream(maxFilesPerTrigger=4), t.videos, out, state, ONE).awaitTermination()
    return sinks.read_manifest(t.spark, out)


@query
def stream_resume(t: Tables) -> DataFrame:
    """Two runs on one checkpoint, with frames added between them."""
    source, out, state = _places(t, "resume")
    for half in range(2):
        t.nested.filter(F.col("frame_key") % 2 == half).write.mode("append").parquet(source)
        curate_stream.stream_crops(_stream(t, t.nested, source), out, state, ALL).awaitTermination()
    return t.spark.read.parquet(out).select(CROPS)


@query
def stream_best_crops(t: Tables) -> DataFrame:
    _, out, state = _places(t, "best")
    sinks.stream_best_crops(t.nested_stream(maxFilesPerTrigger=3), out, state, 5, ONE).awaitTermination()
    return sinks.read_best_crops(t.spark, out).select("video_id", "category", "place", "frame_no", "quality")


@query
def stream_text_gate(t: Tables) -> DataFrame:
    (frames_in, out, state), (regions_in, _, _) = _places(t, "text-gate"), _places(t, "text-gate-regions")
    ahead = {"event_time": F.timestamp_seconds(F.lit(FAR_AHEAD)), "frame_key": F.lit(-1).cast("long")}
    streams = []
    for table, path in ((t.frames, frames_in), (t.regions, regions_in)):
        timed = table.withColumn("event_time", t.event_time)
        timed.unionByName(timed.limit(1).withColumns(ahead)).write.parquet(path)
        streams.append(_stream(t, timed, path))
    kept = sinks.stream_text_gate(*streams, delay="1 hour").select(*t.frames.columns)
    run = kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
    run.trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(out)


@query
def stream_frame_scan(t: Tables) -> DataFrame:
    """Frames in three loads, the earlier ones first."""
    source, out, state = _places(t, "scan")
    positions = t.positions()
    last = positions.agg(F.max("frame_key")).first()[0]
    for load in range(3):
        positions.filter(F.floor(F.col("frame_key") * 3 / (last + 1)) == load).write.mode("append").parquet(source)
        sinks.stream_frame_scan(_stream(t, positions, source), F.col("frame_key"), out, state).awaitTermination()
    return sinks.read_frames_scanned(t.spark, out)


@query
def stream_rates(t: Tables) -> DataFrame:
    """Frames that the batches of a run had, and whether each has its time and rate."""
    kept, out, state = _places(t, "rates")
    listener = rates.RateListener(t.spark, kept)
    t.spark.streams.addListener(listener)
    try:
        frames = rates.observed(t.nested_stream(maxFilesPerTrigger=3))
        listener.finish(curate_stream.stream_crops(frames, out, state, ONE))
    finally:
        t.spark.streams.removeListener(listener)
    right = (F.col("seconds") > 0) & (F.col("processing_fps") == F.col("processed_frames") / F.col("seconds"))
    return rates.read_rates(t.spark, kept).agg(F.sum("processed_frames").alias("processed_frames"), F.bool_and(right).alias("measured"))


@query
def stream_progress(t: Tables) -> DataFrame:
    _, out, state = _places(t, "progress")
    sinks.stream_progress(t.nested_stream(maxFilesPerTrigger=3), t.videos, out, state, params=ONE).awaitTermination()
    return sinks.read_progress(t.spark, out)
