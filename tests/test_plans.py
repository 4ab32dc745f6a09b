"""The physical plans keep the properties that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

from contract.tables import tables
from reelsift.operators import images, subjects, voting
from reelsift.params import Params
from reelsift.plans.curate import crop_subjects, curate
from reelsift.sources import frames

SF_DIR = "/root/testdata/sf0.001"
ALL = Params(interval=1, ensemble=True)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ensemble_shuffles_detections_once(spark, no_broadcast):
    t = tables(spark, SF_DIR)
    found = subjects.primary_subject(voting.ensemble(t.det, ALL, limit=None))
    assert plan(found).count("Exchange hashpartitioning") == 1


def test_plans_are_built_without_a_job(spark, no_broadcast):
    """Group sizes are counted once for a table, not once for a run."""
    t = tables(spark, SF_DIR)
    ready = t.frames, t.regions, t.group_limit
    spark.sparkContext.setJobGroup("building", "")
    try:
        found = subjects.primary_subject(voting.ensemble(t.det, ALL, ready[2]))
        crops = curate(ready[0], t.det, ready[1], ALL, ready[2]).crops
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert plan(found).count("Exchange hashpartitioning") == 1 and crops.columns


def test_small_sides_are_sent_and_large_ones_stay(spark, no_broadcast):
    t = tables(spark, SF_DIR)
    wanted = t.videos.selectExpr("video_id", "5 AS frame_index")
    found = plan(frames.frame_lookup(t.frames, wanted))
    assert "BroadcastHashJoin" in found and "LeftSemi" in found
    progress = plan(frames.progress_pct(t.frames, t.videos, ALL))
    assert "BroadcastHashJoin" in progress and "SortMergeJoin" not in progress


def test_many_requests_read_their_videos_and_filter_frames(spark, no_broadcast, tmp_path):
    t = tables(spark, SF_DIR)
    frames.write_frames(t.frames, str(tmp_path / "frames"))
    stored = spark.read.parquet(str(tmp_path / "frames"))
    wanted = spark.range(200_000).selectExpr("int(id % 3) AS video_id", "int(id - 5) AS frame_index")
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")
    try:
        found = frames.frame_lookup(stored, wanted)
        text = plan(found)
        assert "dynamicpruning" in text and "might_contain" in text
        got = {(r.video_id, r.frame_no): r.frame_key for r in found.filter("frame_key IS NOT NULL").collect()}
    finally:
        spark.conf.unset("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold")
    asked = {(i % 3, i - 4) for i in range(200_000)}
    assert got == {(r.video_id, r.frame_no): r.frame_key for r in t.frames.collect() if (r.video_id, r.frame_no) in asked}
    assert found.count() == 200_000


def test_pixels_stay_in_their_buckets(spark, no_broadcast):
    t = tables(spark, SF_DIR)
    subjects_of_frames = crop_subjects(t.det, Params(interval=1))
    text = plan(images.crop_pixels(t.pixels, subjects_of_frames))
    assert "Bucketed: true" in text
    assert len(re.findall(r"Exchange hashpartitioning\(video_id", text)) == 1


def test_detections_are_shuffled_by_frame_only(spark, no_broadcast):
    t = tables(spark, SF_DIR)
    exchanges = re.findall(r"Exchange hashpartitioning\((\w+)", plan(curate(t.frames, t.det, t.regions, ALL, None).outcomes))
    assert exchanges and set(exchanges) == {"frame_key"}


def test_subject_is_aggregated_before_the_shuffle(spark):
    text = plan(subjects.primary_subject(tables(spark, SF_DIR).det))
    assert text.index("partial_max_by") > text.index("Exchange hashpartitioning")


def test_lookup_and_sample_reach_the_scan(spark):
    t = tables(spark, SF_DIR)
    found = plan(frames.frame_at(t.frames, 7, 3))
    assert "EqualTo(video_id,7)" in found and "EqualTo(frame_no,4)" in found
    assert "Exchange" not in plan(frames.frame_sample(t.frames))


def test_only_needed_columns_are_read(spark):
    schema = re.search(r"ReadSchema: (\S+)", plan(subjects.union_bbox(tables(spark, SF_DIR).frames, tables(spark, SF_DIR).det).select("x1")))
    assert schema and "label" not in schema.group(1)


def test_best_crops_keeps_k_rows_per_task(spark):
    t = tables(spark, SF_DIR)
    text = plan(subjects.best_crops(curate(t.frames, t.det, None, Params(interval=1)).crops, 5))
    assert text.count("WindowGroupLimit") == 2


def test_filters_stay_above_the_crop_arithmetic(spark):
    t = tables(spark, SF_DIR)
    crops = curate(t.frames, t.det, None, Params(interval=1)).crops
    condition = max((line for line in plan(crops).splitlines() if "Filter" in line), key=len)
    assert len(condition) < 5_000


def test_no_python_outside_pixel_jobs(spark):
    t = tables(spark, SF_DIR)
    text = plan(curate(t.frames, t.det, t.regions, ALL).crops.select(F.sum("quality")))
    assert "Python" not in text and "MapInPandas" not in text
