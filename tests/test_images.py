import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from contract import toys
from reelsift import schemas
from reelsift.operators import detections, images
from reelsift.params import Params
from reelsift.plans.curate import crop_subjects, curate
from reelsift.sources.frames import read_frame_images

SIZES = [(64, 48), (48, 64)]


def write_png(path, rgb):
    height, width, _ = rgb.shape
    lines = b"".join(b"\0" + rgb[y].tobytes() for y in range(height))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    header = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    path.write_bytes(
        b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    )


def picture(width, height, number):
    """RGB gradient with a rectangle whose blue is bright."""
    y, x = np.indices((height, width))
    rgb = np.stack([x + number, y + number, (x + y) % 100], axis=2).astype(np.uint8)
    rgb[8 + number : 30, 10 : 20 + number, 2] = 202
    return rgb


@pytest.fixture(scope="module")
def frames(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("frames")
    for video, (width, height) in enumerate(SIZES, 1):
        folder = root / f"video_id={video}"
        folder.mkdir()
        for number in range(1, 7):
            write_png(folder / f"frame_{number:06d}.png", picture(width, height, number))
    return read_frame_images(spark, str(root))


def test_read_frame_images(frames):
    schemas.require(frames, schemas.PIXELS, "frames")
    rows = frames.drop("image").collect()
    assert {(r.video_id, r.frame_no, r.width, r.height) for r in rows} == {
        (v, n, *SIZES[v - 1]) for v in (1, 2) for n in range(1, 7)
    }
    assert len({r.frame_key for r in rows}) == 12


def test_from_files_to_cropped_bytes(frames):
    raw = images.infer_detections(frames, "yolo", toys.make_detector)
    schemas.require(raw, schemas.RAW, "raw")
    found = detections.det_normalise(raw)
    boxes = {(r.video_id, r.frame_no): (r.x1, r.y1, r.x2, r.y2, r.class_id) for r in found.collect()}
    assert boxes == {
        (v, n): (10, 8 + n, 20 + n, 30, 2) for v in (1, 2) for n in range(1, 7)
    }
    crops = crop_subjects(found, Params(crop_format="1:1", padding=3))
    cut = images.crop_pixels(frames, crops).collect()
    assert len(cut) == 12
    for r in cut:
        width, height = SIZES[r.video_id - 1]
        bgr = picture(width, height, r.frame_no)[:, :, ::-1]
        part = bgr[r.crop_y : r.crop_y + r.crop_h, r.crop_x : r.crop_x + r.crop_w]
        assert (r.image.width, r.image.height, r.image.nChannels) == (r.crop_w, r.crop_h, 3)
        assert bytes(r.image.data) == part.tobytes()


def test_only_sampled_frames_reach_the_model(frames):
    sampled = frames.filter(F.col("frame_no") % 3 == 0)
    raw = images.infer_detections(sampled, "yolo", toys.make_detector, Params(batch_size=5))
    done = curate(frames, detections.det_normalise(raw), None, Params(interval=3, padding=3))
    assert sorted((r.video_id, r.frame_no) for r in done.crops.collect()) == [(1, 3), (1, 6), (2, 3), (2, 6)]


def test_extract_regions_sees_the_strip_only(spark, frames):
    found = images.extract_regions(frames, "bright", toys.make_region_finder)
    schemas.require(found, schemas.REGIONS, "regions")
    # strip starts at row 36 of 48, the rectangle ends at row 30
    assert found.filter("height = 48").count() == 0
    low = frames.filter("video_id = 1").withColumn(
        "image", F.struct("image.origin", F.lit(32).alias("height"), "image.width", "image.nChannels",
                          "image.mode", F.substring("image.data", F.lit(1), F.lit(32 * 64 * 3)).alias("data"))
    )
    rows = images.extract_regions(low, "bright", toys.make_region_finder).collect()
    # now it starts at row 24
    assert {(r.frame_no, r.rx, r.ry, r.rw, r.rh) for r in rows} == {(n, 10, 0, 10 + n, 6) for n in range(1, 7)}


def test_bucketed_pixels_are_not_shuffled(spark, frames):
    images.write_pixels(frames, "pixels_test", 4)
    try:
        stored = spark.table("pixels_test")
        boxes = stored.selectExpr("video_id", "frame_no", "0 AS crop_x", "0 AS crop_y", "4 AS crop_w", "4 AS crop_h")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        cut = images.crop_pixels(stored, boxes.distinct())
        assert cut.count() == 12
        plan = cut._jdf.queryExecution().executedPlan().toString()
        exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert all("image" not in line for line in exchanges)
        assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE pixels_test")


def constant(label, short=False):
    def make():
        def model(batch):
            found = [[(label, 0.9, 1.0, 1.0, 9.0, 9.0)] for _ in batch]
            return found[1:] if short else found

        return model

    return make


def test_models_of_one_name_do_not_mix(frames):
    """Workers are reused, but never with the model of another factory."""
    for label in (1, 2, 3, 4):
        found = images.infer_detections(frames.coalesce(1), "yolo", constant(label))
        assert {r.label for r in found.collect()} == {label}


def test_a_model_that_leaves_out_frames_fails(frames):
    with pytest.raises(Exception, match="shorter"):
        images.infer_detections(frames, "yolo", constant(1, short=True)).collect()


def test_placed_frames_are_bucketed_without_moving_pixels(spark, tmp_path):
    frames = spark.range(60).selectExpr("int(id % 3) AS video_id", "int(id) AS frame_no", "id AS frame_key", "1 AS width", "1 AS height")
    drawn = images.place_frames(frames, 4).mapInPandas(lambda batches: batches, frames.schema)
    images.write_pixels(drawn, "placed_pixels", 4, str(tmp_path / "p"), placed=True)
    table = spark.table("placed_pixels")
    assert len(list((tmp_path / "p").glob("*.parquet"))) == 4
    assert sorted(r.frame_key for r in table.collect()) == list(range(60))
    plan = table.join(table.withColumnRenamed("width", "w"), ["video_id", "frame_no"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == 0 or "Broadcast" in plan
    spark.sql("DROP TABLE placed_pixels")
