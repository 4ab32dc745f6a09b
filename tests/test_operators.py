import random

import pytest
from pyspark.sql import functions as F
from samples import crowd, det

from reelsift import schemas
from reelsift.functions import naming
from reelsift.functions.geometry import half
from reelsift.operators import crops, detections, skew, stats, subjects, text, voting
from reelsift.params import Params
from reelsift.plans.curate import curate
from reelsift.sources import crop_sink, frames, manifest

SUBJECT = "width INT, height INT, x1 INT, y1 INT, x2 INT, y2 INT, category STRING"


def subject(spark, *rows):
    return spark.createDataFrame(list(rows), SUBJECT)


# --- numbering and skew ------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [None, 1_000_000, 50])
def test_number_within(spark, limit):
    rng = random.Random(1)
    rows = [(k, rng.randrange(40)) for k in [0] * 500 + list(range(1, 30)) * 4]
    df = spark.createDataFrame(rows, "k INT, v INT").repartition(6)
    numbered = skew.number_within(df, ["k"], [F.col("v")], "n", limit).collect()
    by_key = {}
    for r in numbered:
        by_key.setdefault(r.k, []).append((r.n, r.v))
    assert len(numbered) == len(rows)
    for pairs in by_key.values():
        pairs.sort()
        assert [n for n, _ in pairs] == list(range(1, len(pairs) + 1))
        assert [v for _, v in pairs] == sorted(v for _, v in pairs)


def test_number_within_spreads_equal_rows(spark):
    df = spark.createDataFrame([(1, 7)] * 400, "k INT, v INT")
    numbered = skew.number_within(df, ["k"], [F.desc("v")], "n", 10)
    assert sorted(r.n for r in numbered.collect()) == list(range(1, 401))


def test_split_large_groups(spark):
    df = spark.range(100).selectExpr("IF(id < 60, 0, id) AS k")
    usual, large = skew.split_large_groups(df, ["k"], 10)
    assert (usual.count(), large.count()) == (40, 60)
    assert skew.split_large_groups(df, ["k"], 60)[1] is None
    assert skew.split_large_groups(df.filter("k < 0"), ["k"], 1)[1] is None


@pytest.mark.parametrize("limit", [1_000_000, 5])
def test_subject_rank_starts_with_primary_subject(spark, limit):
    table = det(spark, crowd(1, 40), crowd(2, 3), crowd(3, 20))
    first = subjects.subject_rank(table, limit).filter("subject_rank = 1")
    primary = subjects.primary_subject(table)
    assert first.select("frame_key", "det_seq").exceptAll(primary.select("frame_key", "det_seq")).isEmpty()
    assert first.count() == primary.count() == 3


@pytest.mark.parametrize("limit", [1_000_000, 2])
def test_all_detections_keeps_model_order(spark, limit):
    table = det(spark, [(0, i, 0, i + 5, 5, m) for i, m in enumerate(["detr", "yolo", "detr", "yolo"])])
    per_model = {m: detections.model_subset(table, [m]) for m in ("detr", "yolo")}
    rows = detections.all_detections(per_model, limit).orderBy("det_seq").collect()
    assert [(r.det_seq, r.model_source, r.x1) for r in rows] == [
        (1, "yolo", 1), (2, "yolo", 3), (3, "detr", 0), (4, "detr", 2),
    ]


def test_steps_go_to_the_shared_folder(spark, monkeypatch):
    from reelsift import session

    step = session.materialise(spark.range(5))
    folder = session.shared_dir(spark)
    assert step.count() == 5
    assert all(f"{folder.removeprefix('file:')}/" in f for f in step.inputFiles())
    assert session.materialise(spark.range(0)).isEmpty()
    if not spark.conf.get("spark.checkpoint.dir", None):
        monkeypatch.setattr(type(spark.sparkContext), "master", "spark://somewhere:7077")
        with pytest.raises(RuntimeError):
            session.shared_dir(spark)


# --- detections --------------------------------------------------------------------------------


def raw(spark, *rows):
    frame = (1, 1, 1, 100, 100)
    full = [(*frame, m, i, s, lab, *b) for i, (m, s, lab, b) in enumerate(rows, 1)]
    return spark.createDataFrame(full, schemas.RAW)


def test_normalise(spark):
    box = (-3.7, 2.9, 10.2, 11.99)
    rows = raw(spark, ("yolo", 0.5, 0, box), ("detr", 0.49, 1, box), ("fasterrcnn", 0.9, 1, box))
    found = detections.det_normalise(rows).collect()
    assert [(r.x1, r.y1, r.x2, r.y2) for r in found] == [(-3, 2, 10, 11)] * 2  # towards zero
    assert [(r.class_id, r.class_name) for r in found] == [(0, "person"), (0, "class_0")]


def test_canonical_labels(spark):
    box = (0.0, 0.0, 1.0, 1.0)
    labels = [1, 11, 12, 13, 90, 91, 0, 17]
    rows = raw(spark, *(("detr", 0.9, lab, box) for lab in labels), ("yolo", 0.9, 79, box))
    found = detections.det_normalise(rows, Params(label_map="canonical")).orderBy("det_seq").collect()
    assert [r.class_id for r in found] == [0, 10, -1, 11, 79, -1, -1, 15, 79]


def test_categories(spark):
    table = det(spark, [(c, 0, 0, 1, 1) for c in (0, 1, 13, 14, 23, 24, -1)])
    got = [r.category for r in detections.det_categorise(table).orderBy("det_seq").collect()]
    assert got == ["person", "object", "object", "animal", "animal", "object", "object"]


def test_schema_check(spark):
    with pytest.raises(ValueError, match="score double"):
        detections.det_normalise(spark.range(1))


def test_params():
    with pytest.raises(ValueError):
        Params(interval=0)
    with pytest.raises(ValueError):
        Params(models=("other",))
    assert Params(models=("detr", "yolo"), ensemble=True).active_models == ("yolo", "detr")


# --- subjects ----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "boxes, best",
    [
        ([(2, 0, 0, 10, 10), (0, 0, 0, 10, 10)], 2),  # tie: person before object
        ([(2, 0, 0, 10, 10), (16, 0, 0, 10, 10)], 2),  # tie: animal before object
        ([(0, 0, 0, 10, 10), (0, 5, 5, 15, 15)], 1),  # tie within a category: the earlier one
        ([(0, 0, 0, 10, 10), (2, 0, 0, 50, 50)], 2),  # score counts first
    ],
)
def test_primary_subject(spark, boxes, best):
    assert subjects.primary_subject(det(spark, boxes)).first().det_seq == best


# --- crops -------------------------------------------------------------------------------------


def shift_of(spark, y1, category="person"):
    """How far the crop moved against one without head-space rule."""
    box = (480, y1, 520, y1 + 400)
    rows = subject(spark, (1000, 1000, *box, category), (1000, 1000, *box, "object"))
    got = crops.crop_box(rows, Params(padding=20)).collect()
    assert got[0].crop_h == got[1].crop_h
    return got[0].crop_y - got[1].crop_y, int(got[0].crop_h * 0.1)


@pytest.mark.parametrize(
    "y1, direction", [(0, 0), (40, -1), (50, 0), (150, 0), (250, 0), (260, 1)]
)
def test_head_space_shift(spark, y1, direction):
    moved, nudge = shift_of(spark, y1)
    if direction < 0:  # upwards, as far as the frame allows
        assert moved == -20 > -nudge
    else:
        assert moved == direction * nudge


def test_head_space_is_for_persons(spark):
    assert shift_of(spark, 260, "animal")[0] == 0


def test_floor_of_negative_centre(spark):
    assert spark.range(1).select(half(F.lit(-3)), half(F.lit(3))).first()[:] == (-2, 1)


def test_no_crop_for_flat_subject_without_padding(spark):
    rows = subject(spark, (100, 100, 10, 50, 30, 50, "object"), (100, 100, 10, 40, 30, 50, "object"))
    done = crops.crop_quality(crops.crop_box(rows, Params(padding=0))).collect()
    assert [done[0].crop_x, done[0].crop_w, done[0].quality] == [None, None, None]
    assert done[1].crop_w > 0


@pytest.mark.parametrize("name, ratio", [("1:1", 1.0), ("16:9", 9 / 16), ("4:3", 9 / 16), ("x", 9 / 16)])
def test_format_ratio(name, ratio):
    assert crops.format_ratio(Params(crop_format=name)) == ratio


def test_strict_format_ratio():
    assert crops.format_ratio(Params(crop_format="16:9", strict_formats=True)) == 16 / 9


@pytest.mark.parametrize("fmt", ["9:16", "3:4", "1:1", "4:5"])
@pytest.mark.parametrize("padding", [0, 30, 500])
def test_crop_inside_frame(spark, fmt, padding):
    rng = random.Random(padding)
    rows = []
    for _ in range(300):
        w, h = rng.choice([(1920, 1080), (1080, 1920), (64, 48)])
        x1, y1 = rng.randrange(w - 2), rng.randrange(h - 2)
        rows.append((w, h, x1, y1, rng.randint(x1 + 1, w), rng.randint(y1 + 1, h),
                     rng.choice(["person", "animal", "object"])))
    params = Params(crop_format=fmt, padding=padding)
    done = crops.crop_quality(crops.crop_box(subject(spark, *rows), params))
    outside = "crop_x < 0 OR crop_y < 0 OR crop_x + crop_w > width OR crop_y + crop_h > height"
    assert done.filter(f"{outside} OR NOT quality BETWEEN 0 AND 1").count() == 0
    zoomed = crops.zoom_box(done)
    assert zoomed.filter("zoom_x + zoom_w > width OR zoom_y + zoom_h > height OR zoom_x < 0").count() == 0


def test_quality_gate_is_strict(spark):
    df = spark.createDataFrame([(0.3,), (0.30000001,), (None,)], "quality DOUBLE")
    assert crops.quality_gate(df).count() == 1


def test_subject_beyond_its_crop_scores_low(spark):
    rows = subject(spark, (1000, 200, 0, 0, 1000, 200, "object"))
    done = crops.crop_quality(crops.crop_box(rows, Params(padding=0))).first()
    assert done.quality == 0.0


# --- text --------------------------------------------------------------------------------------


def region(key, y=60, w=500, h=40):
    return (1, key, key, 1920, 1000, 1, 0, y + 20, w, h)


def frames_of(spark, *keys):
    return spark.createDataFrame([(1, k, k, 1920, 1000) for k in keys], schemas.FRAMES)


def test_two_regions_make_a_text_frame(spark):
    regions = spark.createDataFrame([region(1), region(2), region(2)], schemas.REGIONS)
    flags = text.text_quick(frames_of(spark, 1, 2, 3), regions).orderBy("frame_key").collect()
    assert [(r.text_regions, r.is_text) for r in flags] == [(1, False), (2, True), (0, False)]
    kept = text.text_gate(frames_of(spark, 1, 2, 3), regions)
    assert sorted(r.frame_key for r in kept.collect()) == [1, 3]


@pytest.mark.parametrize("params", [Params(skip_text=False), Params(use_quick_text=False)])
def test_text_gate_turned_off(spark, params):
    regions = spark.createDataFrame([region(2), region(2)], schemas.REGIONS)
    assert text.text_gate(frames_of(spark, 1, 2), regions, params).count() == 2
    assert text.text_gate(frames_of(spark, 1, 2), None).count() == 2


def test_region_bounds_are_strict(spark):
    rows = [
        (1, 1, 1, 1000, 1000, 1, 0, 75, 100, 40),  # at 0.3 of the strip
        (1, 1, 1, 1000, 1000, 2, 0, 76, 100, 40),  # elongation 2.5
        (1, 1, 1, 1000, 1000, 3, 0, 76, 80, 20),  # 0.08 of the width
        (1, 1, 1, 1000, 1000, 4, 0, 76, 101, 0),  # no height
        (1, 1, 1, 1000, 1000, 5, 0, 76, 101, 40),
    ]
    found = text.region_predicate(spark.createDataFrame(rows, schemas.REGIONS)).collect()
    assert [r.line_no for r in found] == [5]


def quad(w, h):
    return [(0.0, 0.0), (float(w), 0.0), (float(w), float(h)), (0.0, float(h))]


def test_ocr_ratio(spark):
    # the strip of a 1000 x 400 frame has 100,000 pixels
    frame = [(1, k, k, 1000, 400) for k in (1, 2, 3, 4)]
    quads = [(*frame[0], quad(150, 10)), (*frame[1], quad(151, 10)), (*frame[2], quad(80, 10)),
             (*frame[2], quad(80, 10))]
    got = text.text_ocr(
        spark.createDataFrame(frame, schemas.FRAMES), spark.createDataFrame(quads, schemas.OCR)
    ).orderBy("frame_key").collect()
    assert [(r.text_ratio, r.has_text) for r in got] == [
        (0.015, False), (0.0151, True), (0.016, True), (0.0, False),
    ]


# --- sources, sink, statistics -----------------------------------------------------------------


def test_manifest(spark, tmp_path):
    paths = ["a.mp4", "b.MKV", "a.mp4", "c.txt", "d.mp4.bak", "e.webm"]
    df = spark.createDataFrame([(p,) for p in paths], "path STRING")
    assert sorted(r.path for r in manifest.video_manifest(df).collect()) == ["a.mp4", "b.MKV", "e.webm"]
    assert manifest.video_manifest(df, dedupe=False).count() == 4
    for name in ("one.mp4", "two.AVI", "three.txt"):
        (tmp_path / name).write_bytes(b"x" * 10)
    listed = manifest.list_videos(spark, [f"{tmp_path}/*", f"{tmp_path}/one.mp4", f"{tmp_path}/no*.mp4"])
    assert sorted(r.path.rsplit("/", 1)[1] for r in listed.collect()) == ["one.mp4", "two.AVI"]


def test_names(spark):
    paths = ["in/a.b.mp4", "clip.MP4", "/x/.mp4", "plain"]
    df = spark.createDataFrame([(p,) for p in paths], "path STRING")
    assert [r[0] for r in df.select(naming.stem(F.col("path"))).collect()] == ["a.b", "clip", ".mp4", "plain"]
    run = crop_sink.output_run_name(df, Params(ensemble=True, crop_format="4:5")).first().run_name
    assert run == "a.b_4x5_ensemble_turbo"
    one = spark.createDataFrame([(30, 0.856), (1234567, 0.31)], "frame_no INT, quality DOUBLE")
    assert [r.file_name for r in crop_sink.crop_filename(one).collect()] == [
        "frame_000030_q85.jpg", "frame_1234567_q31.jpg",
    ]


def test_video_info_without_rate(spark):
    df = spark.createDataFrame([(1, "a.mp4", 10, 10, 0.0, 50), (2, "b.mp4", 10, 10, 25.0, 50)], schemas.VIDEOS)
    assert [r.duration for r in frames.video_info(df).orderBy("video_id").collect()] == [0.0, 2.0]


def test_lookup_counts_from_zero(spark):
    table = frames_of(spark, 29, 30)
    requests = spark.createDataFrame([(1, 29), (1, 30)], "video_id INT, frame_index INT")
    got = {r.frame_index: r.frame_key for r in frames.frame_lookup(table, requests).collect()}
    assert got == {29: 30, 30: None}
    assert [r.frame_no for r in frames.frame_at(table, 1, 29).collect()] == [30]
    assert frames.frame_at(table, 1, 30).isEmpty()


def run(spark, params):
    videos = spark.createDataFrame(
        [(1, "in/a.mp4", 1920, 1000, 25.0, 6), (2, "in/b.mp4", 1920, 1000, 25.0, 0)], schemas.VIDEOS
    )
    table = frames_of(spark, *range(1, 7))
    boxes = [
        (*(1, k, k, 1920, 1000), "yolo", 1, *box, 0.9, cls)
        for k, cls, box in [
            (1, 0, (900, 300, 1000, 500)),  # person
            (2, 16, (900, 300, 1000, 500)),  # on a text frame
            (3, 2, (0, 0, 1920, 1000)),  # far beyond its crop
            (4, 16, (900, 300, 1000, 500)),
        ]
    ]
    found = spark.createDataFrame(boxes, schemas.DETECTIONS)
    regions = spark.createDataFrame([region(2), region(2)], schemas.REGIONS)
    return curate(table, found, regions, params), videos


@pytest.mark.parametrize("turbo, processed", [(True, 5), (False, 6)])
def test_statistics(spark, turbo, processed):
    params = Params(interval=1, turbo=turbo, padding=50)
    done, videos = run(spark, params)
    outcome = {r.frame_no: r.outcome for r in done.outcomes.collect()}
    assert outcome == {1: "saved", 2: "skipped_text", 3: "rejected_quality", 4: "saved",
                       5: "skipped_no_detection", 6: "skipped_no_detection"}
    per_video = stats.video_stats(done.outcomes, videos, params)
    rows = {r.video_id: r.asDict() for r in per_video.collect()}
    assert rows[1] == {
        "video_id": 1, "processed_frames": processed, "saved_frames": 2, "skipped_text": 1,
        "skipped_no_detection": 2, "rejected_quality": 1, "no_crop": 0,
        "person_frames": 1, "animal_frames": 1, "object_frames": 0,
    }
    assert all(v == 0 for k, v in rows[2].items() if k != "video_id")
    total = stats.overall_stats(per_video, videos).filter("video_id IS NULL").first()
    assert (total.total_videos, total.processed_videos, total.saved_frames, total.video_name) == (2, 2, 2, None)
    stopped = per_video.filter("video_id = 1").withColumn("processing_time", F.lit(1.5))
    rows = {r.video_id: r for r in stats.overall_stats(stopped, videos).collect()}
    assert set(rows) == {1, None} and rows[None].total_time == 1.5
    assert (rows[None].total_videos, rows[None].processed_videos) == (2, 1)


def test_interval(spark):
    done, _ = run(spark, Params(interval=3))
    assert sorted(r.frame_no for r in done.outcomes.collect()) == [3, 6]


def test_write_crops(spark, tmp_path):
    params = Params(interval=1, padding=50)
    done, videos = run(spark, params)
    path = f"{tmp_path}/crops"
    crop_sink.write_crops(crop_sink.crop_manifest(done.crops, videos, params), path)
    other = crop_sink.crop_manifest(done.crops, videos, Params(interval=1, padding=50, crop_format="1:1"))
    crop_sink.write_crops(other, path)  # a second run leaves the first one alone
    back = spark.read.parquet(path)
    assert back.select("run_name").distinct().count() == 2
    back = back.filter(F.col("run_name") == "a_9x16_yolo_turbo")
    assert {(r.run_name, r.category_dir, r.frame_no) for r in back.collect()} == {
        ("a_9x16_yolo_turbo", "persons", 1), ("a_9x16_yolo_turbo", "animals", 4),
    }



def test_silent_models(spark):
    one = det(spark, [(0, 1, 1, 9, 9), (0, 1, 1, 9, 9, "fasterrcnn")])
    row = detections.detection_stats(one).first()
    assert (row.total_models, row.loaded_models) == (3, "detr,fasterrcnn,yolo")
    assert (row.silent_models, row.voting_threshold) == ("detr", 2)
    none = detections.detection_stats(one.limit(0)).first()
    assert none.silent_models == none.loaded_models


def test_consensus_keeps_the_founders_name(spark):
    two = det(spark, [(0, 1, 1, 99, 99), (0, 1, 1, 99, 98, "detr")])
    named = two.withColumn("class_name", F.concat(F.lit("own "), "model_source"))
    assert [r.class_name for r in voting.ensemble(named).collect()] == ["own yolo"]
    assert [r.class_name for r in voting.ensemble(two).collect()] == ["person"]


def test_class_map_replaces_a_category(spark):
    one = detections.det_categorise(det(spark, [(0, 1, 1, 9, 9), (7, 1, 1, 9, 9)]))
    mapped = detections.class_map(one, spark.createDataFrame([(0, "animal")], "class_id int, category string"))
    assert mapped.columns.count("category") == 1
    assert sorted(r.category for r in mapped.collect()) == ["animal", "object"]
