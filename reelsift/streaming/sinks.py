"""What streams of frames keep: crops by run, the best crops, frame numbers, the second pass."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import replace as changed

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reelsift import schemas
from reelsift.operators.skew import broadcast_if_small
from reelsift.operators.subjects import best_crops
from reelsift.operators.text import looks_like_text
from reelsift.operators.voting import ensemble
from reelsift.params import Params
from reelsift.session import exists, remove
from reelsift.sources.crop_sink import crop_manifest, write_crops
from reelsift.sources.frames import frame_sample, frame_scan
from reelsift.streaming import store
from reelsift.streaming.curate_stream import curate_nested
from reelsift.streaming.long_rows import state_store

_RUN_BATCH = ["run_name", "batch"]
_JOIN_STATE = {"spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}  # changes are written, not copies


@contextmanager
def _held(batch: DataFrame) -> Iterator[DataFrame]:
    """The rows of a micro-batch, computed once: what it comes from may keep state."""
    batch.persist().count()
    try:
        yield batch
    finally:
        batch.unpersist()


def _crops(batch: DataFrame, params: Params, keep: Sequence[str] = ()) -> DataFrame:
    return curate_nested(batch, params, keep=keep).filter(F.col("outcome") == "saved").drop("outcome")


# --- crops by run and category ---------------------------------------------------------------


def stream_manifest(
    frames: DataFrame, videos: DataFrame, path: str, checkpoint: str, params: Params = Params(), **trigger
) -> StreamingQuery:
    """Write the crop manifest by run and category as nested frames arrive; ``read_manifest`` reads it.

    A batch writes folders of its own below each run and category, and then its commit list: the runs it
    wrote and their rows. Batches without a list, as one that failed half way, are not read, and one that
    comes again replaces its folders. Batches are told apart by their checkpoint, so several streams can
    write to one path and earlier runs stay. A checkpoint that starts anew leaves its old lists behind.
    """
    stream = "s" + hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, number: int) -> None:
        spark, done = batch.sparkSession, f"{_lists(path)}/stream={stream}/number={number}"
        if number == 0:
            remove(spark, f"{_lists(path)}/stream={stream}")
        elif exists(spark, f"{done}/_SUCCESS"):
            return
        with _held(batch):
            rows = crop_manifest(_crops(batch, params), videos, params).withColumn("batch", F.lit(f"{stream}-{number}"))
            write_crops(rows, path, keys=("run_name", "category_dir", "batch"))
            rows.groupBy(*_RUN_BATCH).agg(F.count("*").alias("rows")).write.mode("overwrite").parquet(done)

    return store.each_batch(frames, write, checkpoint, **trigger)


def _lists(path: str) -> str:
    return f"{path.rstrip('/')}-commits"


def committed(spark: SparkSession, path: str) -> DataFrame:
    """``run_name, batch, rows`` of the batches that were written in full."""
    return spark.read.parquet(_lists(path)).select(*_RUN_BATCH, "rows")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The crop manifest that streams have written to ``path``."""
    return spark.read.parquet(path).join(committed(spark, path).select(*_RUN_BATCH), _RUN_BATCH, "left_semi").drop("batch")


# --- the best crops --------------------------------------------------------------------------


def stream_best_crops(
    frames: DataFrame, path: str, checkpoint: str, k: int, params: Params = Params(), **trigger
) -> StreamingQuery:
    """Keep the ``k`` best crops of each video and category; ``read_best_crops`` reads them.

    Tasks keep ``k`` rows of a group before these meet the ``k`` rows kept so far, and only groups a batch
    has crops for are written. So what is kept grows with the groups, not with the stream.
    """
    keys = ["video_id", "category"]

    def keep(batch: DataFrame, number: int) -> None:
        with _held(batch):
            new = best_crops(_crops(batch, params), k)
            old = store.before(batch.sparkSession, path, number, keys)
            if old is not None:
                new = best_crops(new.drop("place").unionByName(old.drop("place").join(new.select(*keys).distinct(), keys, "left_semi")), k)
            store.replace(new, path, number, keys)

    return store.each_batch(frames, keep, checkpoint, **trigger)


def read_best_crops(spark: SparkSession, path: str) -> DataFrame:
    return store.latest(spark.read.parquet(path), ["video_id", "category"])


# --- frame numbers ---------------------------------------------------------------------------


def stream_frame_scan(
    positions: DataFrame, order: Sequence[Column] | Column, path: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Number the frames of each video as they arrive, going on where the last batch stopped.

    Within a batch frames come in ``order``, and batches come one after the other; so files that are added
    in order give the numbers of one load. ``read_frames_scanned`` reads the frames. What is kept is one
    count for each video.
    """

    def number_on(batch: DataFrame, number: int) -> None:
        spark, counts = batch.sparkSession, f"{path}/counts"
        known = store.before(spark, counts, number, ["video_id"])
        numbered = frame_scan(batch, order)
        if known is not None:
            numbered = numbered.join(known, "video_id", "left").withColumn(
                "frame_no", (F.col("frame_no") + F.coalesce("last_no", F.lit(0))).cast("int")
            ).drop("last_no")
        store.append(numbered, f"{path}/frames", number)
        written = spark.read.parquet(f"{path}/frames/batch={number}")
        store.replace(written.groupBy("video_id").agg(F.max("frame_no").alias("last_no")), counts, number, ["video_id"])

    return store.each_batch(positions, number_on, checkpoint, **trigger)


def read_frames_scanned(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/frames").drop("batch")


# --- progress --------------------------------------------------------------------------------


def stream_progress(
    frames: DataFrame,
    videos: DataFrame,
    path: str,
    checkpoint: str,
    report: Callable[[DataFrame, int], None] | None = None,
    params: Params = Params(),
    **trigger,
) -> StreamingQuery:
    """Keep how far each video has come: its furthest sampled frame, in percent of its frames.

    After each batch ``report`` gets the videos that have gone on, as a table, and the batch's number; every
    ``COMPACT``-th batch has all videos, and one that comes again is reported again. ``read_progress`` reads all videos. State is one row of each.
    """
    total = videos.select("video_id", "total_frames")
    furthest = frame_sample(frames.select("video_id", "frame_no"), params).groupBy("video_id").agg(F.max("frame_no").alias("frame_no"))

    def keep(batch: DataFrame, number: int) -> None:
        share = F.when(F.col("total_frames") > 0, F.col("frame_no") / F.col("total_frames") * F.lit(100.0))
        store.replace(batch.join(broadcast_if_small(total), "video_id").withColumn("progress", share), path, number, ["video_id"])
        if report is not None:
            report(batch.sparkSession.read.parquet(f"{path}/batch={number}"), number)

    return store.each_batch(furthest, keep, checkpoint, "update", **trigger)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    return store.latest(spark.read.parquet(path), ["video_id"])


# --- text and the second pass ----------------------------------------------------------------


def stream_text_gate(
    frames: DataFrame, regions: DataFrame, params: Params = Params(), time: str = "event_time", delay: str = "10 minutes"
) -> DataFrame:
    """Frames without text, from streams of frames and regions that both carry the frame's ``time``.

    Regions are counted for each frame until the watermark has passed it; an outer join then keeps the
    frames that met no text frame. State is what the last ``delay`` holds. A frame comes out once, when
    rows more than ``delay`` later than it have arrived on both streams.
    """
    if not params.text_gate_active:
        return frames
    frame = [time, "frame_key"]
    like = looks_like_text(*map(F.col, ("ry", "rw", "rh", "width", "height")), params)
    texts = (
        regions.withWatermark(time, delay)
        .groupBy(*frame)
        .agg(F.count_if(like).alias("_texts"))
        .filter("_texts >= 2")
        .select(*(F.col(c).alias(f"_{c}") for c in frame))
    )
    same = (F.col(f"_{time}") == F.col(time)) & (F.col("_frame_key") == F.col("frame_key"))
    joined = frames.withWatermark(time, delay).join(texts, same, "left_outer")
    return joined.filter(F.col("_frame_key").isNull()).select(*frames.columns)


def stream_two_pass(
    quick: DataFrame,
    full: DataFrame,
    path: str,
    checkpoint: str,
    params: Params = Params(ensemble=True),
    time: str = "event_time",
    delay: str = "10 minutes",
    **trigger,
) -> StreamingQuery:
    """Consensus of all models on the frames that a quick look with one model saves.

    ``quick`` has nested frames with the first model's detections, ``full`` has them again with those of
    all models, up to ``delay`` later; both carry the frame's ``time``. A frame waits on either side for
    the other until the watermark has passed it, so state is what the last ``delay`` holds: of ``full`` only
    the detections that vote. State lies outside the JVM's heap (``state_store``).
    """
    single = changed(params, ensemble=False)
    chosen = _crops(quick.withWatermark(time, delay), single, [time]).select(
        F.col(time).alias("_time"), F.col("frame_key").alias("_key")
    )
    used = F.filter("detections", lambda d: d["model_source"].isin(*params.active_models))
    waiting = full.withWatermark(time, delay).select(time, *schemas.FRAME_COLUMNS, used.alias("detections"))
    wanted = waiting.join(chosen, (F.col(time) == F.col("_time")) & (F.col("frame_key") == F.col("_key")))

    def vote(batch: DataFrame, number: int) -> None:
        with _held(batch.select(*schemas.FRAME_COLUMNS, F.inline("detections"))) as each:
            store.append(ensemble(each.select(*schemas.DETECTIONS.names), params), path, number)

    with state_store(full.sparkSession, _JOIN_STATE):
        return store.each_batch(wanted, vote, checkpoint, **trigger)
