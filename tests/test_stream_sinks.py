"""Streams that keep state or tables of their own: equal to batch, also when batches come again."""

import datetime
import pickle
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contract.tables import tables
from reelsift import schemas
from reelsift.operators.subjects import best_crops
from reelsift.params import Params
from reelsift.plans.curate import curate, two_pass
from reelsift.sources.crop_sink import crop_manifest
from reelsift.streaming import curate_stream as cs
from reelsift.streaming import long_rows as lr
from reelsift.streaming import rates, sinks, store

SF_DIR = "/root/testdata/sf0.001"
ALL = Params(interval=1, ensemble=True)
ONE = Params(interval=1)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Each partition of each state is a store of its own, which takes time to open."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)


def same(a, b):
    columns = sorted(b.columns)
    assert sorted(a.columns) == columns
    a, b = a.select(columns), b.select(columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def forget_last_batch(state):
    """As if the application had died before the batch was marked as done."""
    last = max((p for p in (state / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last.unlink()
    (state / "commits" / f".{last.name}.crc").unlink(missing_ok=True)


def arriving(spark, df, path):
    df.write.mode("append").parquet(str(path))
    return spark.readStream.schema(df.schema).parquet(str(path))


# --- plans -----------------------------------------------------------------------------------


def test_only_crowded_frames_pass_through_python(spark):
    nested = tables(spark, SF_DIR).nested
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan(cs.curate_nested(nested, ALL, crowded=False))
    text = plan(cs.curate_nested(nested, ALL))
    assert len(text.split("ArrowEvalPython")) == 2 and "> 512" in text.split("ArrowEvalPython")[1]


def test_no_python_in_streams_of_nested_rows(spark, tmp_path):
    t = tables(spark, SF_DIR)
    query = cs.stream_crops(t.nested_stream(), str(tmp_path / "out"), str(tmp_path / "state"), ALL)
    query.awaitTermination()
    plan = query._jsq.explainInternal(True)
    assert "aggregate(" in plan and "Python" not in plan


# --- single rows -----------------------------------------------------------------------------


def report(frame, source, n, at=0):
    return (at, 1, frame, frame, 100, 50, source, n, *[None] * 12)


def found(frame, source, seq, at=0):
    return (at, 1, frame, frame, 100, 50, source, None, seq, source, 0, 0.9, 1, 2, 30, 40, *[None] * 4)


def region(frame, at=0):
    return (at, 1, frame, frame, 100, 50, "regions", None, *[None] * 8, 1, 2, 3, 4)


class Gathered:
    """Runs of one stream of single rows on one checkpoint."""

    def __init__(self, spark, tmp_path, params):
        self.spark, self.dir, self.params, self.late = spark, tmp_path, params, 0
        fields = [("at", "long"), *((c, "long" if c == "frame_key" else "int") for c in schemas.FRAME_COLUMNS), ("source", "string"), ("n_rows", "int")]
        fields += [(f.name, f.dataType.simpleString()) for f in lr._MEMBERS[1:]]
        self.schema = ", ".join(f"{n} {t}" for n, t in fields)

    def run(self, rows):
        df = self.spark.createDataFrame(rows, self.schema).withColumn("event_time", F.timestamp_seconds(F.col("at") + 1_000_000)).drop("at")
        with lr.state_store(self.spark):
            frames = lr.gather_frames(arriving(self.spark, df, self.dir / "in"), self.params, delay="10 seconds")
            query = frames.writeStream.format("parquet").option("path", str(self.dir / "out"))
            query = query.option("checkpointLocation", str(self.dir / "state")).trigger(availableNow=True).start()
            query.awaitTermination()
        self.late += lr.late_rows(query)
        self.states = max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"])
        got = self.spark.read.parquet(str(self.dir / "out")).collect()
        return sorted((r["frame_key"], r["status"], sorted(d["det_seq"] for d in r["detections"]), len(r["regions"])) for r in got)


def test_frames_come_out_with_their_last_row(spark, tmp_path):
    params = Params(interval=1, ensemble=True, models=("yolo", "detr"))
    g = Gathered(spark, tmp_path, params)
    # frame 1 is whole but for a region, 2 lacks a row that was reported, 3 has nothing but reports
    rows = [report(f, s, n) for f in (1, 2, 3) for s, n in (("yolo", 2 * (f < 3)), ("detr", f < 3), ("regions", f == 1))]
    rows = [r[:7] + (int(r[7]),) + r[8:] for r in rows]
    rows += [found(1, "yolo", 1), found(1, "yolo", 2), found(1, "detr", 3), found(2, "yolo", 1), found(2, "detr", 3)]
    rows += [found(1, "fasterrcnn", 9)]  # a model that is not asked for
    assert g.run(rows) == [(3, "complete", [], 0)]
    assert g.run([region(1)]) == [(1, "complete", [1, 2, 3, 9], 1), (3, "complete", [], 0)]
    # a row more for a frame that is out; then time goes on and the unfinished frame expires
    assert (1, "late", [4], 0) in g.run([found(1, "yolo", 4)])
    done = g.run([report(9, "yolo", 0, at=1000)])
    assert [r for r in done if r[0] == 2] == [(2, "expired", [1, 3], 0)] and not [r for r in done if r[0] == 9]
    # later still, rows are left out and counted
    assert g.run([found(2, "yolo", 2), found(1, "yolo", 5)]) == done and g.late == 2


def test_gathering_goes_on_after_a_batch_is_repeated(spark, tmp_path):
    g = Gathered(spark, tmp_path, Params(interval=1, skip_text=False))
    g.run([report(1, "yolo", 2), found(1, "yolo", 1)])
    forget_last_batch(tmp_path / "state")
    assert g.run([found(1, "yolo", 2), report(2, "yolo", 0)]) == [(1, "complete", [1, 2], 0), (2, "complete", [], 0)]


def test_the_processor_needs_no_files_of_ours(tmp_path):
    """The driver starts it in a process that does not know where this package lies."""
    blob = cloudpickle.dumps(lr._Gathering(("yolo",)))
    code = "import sys, pickle; print(pickle.load(sys.stdin.buffer).sources, 'reelsift' in sys.modules)"
    done = subprocess.run([sys.executable, "-c", code], input=blob, cwd=tmp_path, capture_output=True, check=True)
    assert done.stdout.decode().split() == ["('yolo',)", "False"]


def test_nothing_is_asked_of_regions_without_a_text_gate(spark, tmp_path):
    g = Gathered(spark, tmp_path, Params(interval=1, use_quick_text=False))
    assert g.run([report(1, "yolo", 1), found(1, "yolo", 7)]) == [(1, "complete", [7], 0)]


def test_frames_of_a_slice_share_a_state_and_keep_what_is_null(spark, tmp_path):
    g = Gathered(spark, tmp_path, Params(interval=1, use_quick_text=False))
    frames = range(-3, 300)
    unnamed = [(*found(f, "yolo", 7)[:9], None, None, float("nan") if f == 5 else None, None, 2, 30, 40, *[None] * 4) for f in frames]
    assert g.run([report(f, "yolo", 2) for f in frames] + unnamed) == []
    assert g.run([found(f, "yolo", 8) for f in frames]) == [(f, "complete", [7, 8], 0) for f in frames]
    assert 1 <= g.states <= 3
    got = {r["frame_key"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    odd = {k: next(tuple(d) for d in r["detections"] if d["det_seq"] == 7) for k, r in got.items()}
    assert all(d[1:] == (None, None, None, None, 2, 30, 40) for k, d in odd.items() if k != 5)
    assert odd[5][3] != odd[5][3] and (got[5]["width"], got[-3]["frame_no"], got[299]["video_id"]) == (100, -3, 1)


# --- crops by run ----------------------------------------------------------------------------


@pytest.fixture
def halves(spark):
    t = tables(spark, SF_DIR)
    return t, [t.nested.filter(F.col("frame_key") % 2 == k).coalesce(1) for k in range(2)]


def test_manifest_of_repeated_and_half_written_batches(spark, tmp_path, halves):
    t, parts = halves
    out, state = str(tmp_path / "out"), tmp_path / "state"
    want = crop_manifest(curate(t.frames, t.det, t.regions, ONE).crops, t.videos, ONE)

    def run():
        stream = spark.readStream.schema(schemas.NESTED).parquet(str(tmp_path / "in"))
        sinks.stream_manifest(stream, t.videos, out, str(state), ONE).awaitTermination()

    for part in parts:
        part.write.mode("append").parquet(str(tmp_path / "in"))
        run()
    forget_last_batch(state)
    run()
    assert same(sinks.read_manifest(spark, out), want)
    # the second batch dies after its crops and before its list
    (lists,) = (tmp_path / "out-commits").glob("stream=*")
    half = sinks.committed(spark, out).agg(F.sum("rows")).first()[0]
    for f in (lists / "number=1").iterdir():
        f.unlink()
    (lists / "number=1").rmdir()
    assert sinks.read_manifest(spark, out).count() < half == want.count()
    forget_last_batch(state)
    run()
    assert same(sinks.read_manifest(spark, out), want)
    folders = {p.relative_to(out).parts[:2] for p in (tmp_path / "out").rglob("*.parquet")}
    assert all(a.startswith("run_name=") and b.startswith("category_dir=") for a, b in folders)


def test_manifests_of_other_streams_and_runs_stay(spark, tmp_path, halves):
    t, parts = halves
    other = Params(interval=1, crop_format="1:1")
    for k, params in enumerate((ONE, other)):
        stream = arriving(spark, parts[k], tmp_path / f"in{k}")
        sinks.stream_manifest(stream, t.videos, str(tmp_path / "out"), str(tmp_path / f"state{k}"), params).awaitTermination()
    got = sinks.read_manifest(spark, str(tmp_path / "out"))
    want = [crop_manifest(curate(p, t.det, t.regions, q).crops, t.videos, q) for p, q in zip(parts, (ONE, other), strict=True)]
    assert same(got, want[0].unionByName(want[1]))


# --- tables kept up to date ------------------------------------------------------------------


def test_best_crops_keep_k_rows(spark, tmp_path, halves):
    t, parts = halves
    out, state = str(tmp_path / "out"), tmp_path / "state"
    for part in parts:
        stream = arriving(spark, part, tmp_path / "in")
        sinks.stream_best_crops(stream, out, str(state), 2, ONE).awaitTermination()
        forget_last_batch(state)  # comes again with the next one
    stream = spark.readStream.schema(schemas.NESTED).parquet(str(tmp_path / "in"))
    sinks.stream_best_crops(stream, out, str(state), 2, ONE).awaitTermination()
    want = best_crops(curate(t.frames, t.det, t.regions, ONE).crops, 2)
    assert same(sinks.read_best_crops(spark, out), want)
    kept = spark.read.parquet(out).groupBy("batch", "video_id", "category").count()
    assert kept.agg(F.max("count")).first()[0] == 2


def test_frame_numbers_go_on_and_are_given_once(spark, tmp_path):
    t = tables(spark, SF_DIR)
    positions, state = t.positions(), tmp_path / "state"
    for load in range(4):
        part = positions.filter(F.floor(F.col("frame_key") * 4 / 6001) == load)
        stream = arriving(spark, part, tmp_path / "in")
        sinks.stream_frame_scan(stream, F.col("frame_key"), str(tmp_path / "out"), str(state)).awaitTermination()
        if load == 2:
            forget_last_batch(state)
    assert same(sinks.read_frames_scanned(spark, str(tmp_path / "out")), t.frames)


def test_progress_is_reported_batch_by_batch(spark, tmp_path, halves):
    t, _ = halves
    out, told = str(tmp_path / "out"), []
    report = lambda gone_on, number: told.append((number, {r["video_id"]: r["progress"] for r in gone_on.collect()}))
    early, late = (t.nested.filter(c) for c in ("frame_no <= 5", "frame_no > 5 AND video_id % 2 = 0"))
    for part in (early, late):
        stream = arriving(spark, part, tmp_path / "in")
        sinks.stream_progress(stream, t.videos, out, str(tmp_path / "state"), report, ONE).awaitTermination()
    totals = {r["video_id"]: r["total_frames"] for r in t.videos.collect()}
    assert [n for n, _ in told] == [0, 1]
    assert told[0][1] == {v: min(5, n) / n * 100 for v, n in totals.items()}
    assert told[1][1] == {v: 100.0 for v, n in totals.items() if v % 2 == 0 and n > 5}
    assert {r["video_id"]: r["progress"] for r in sinks.read_progress(spark, out).collect()} == told[0][1] | told[1][1]


def test_store_compacts_rows_by_key(spark, tmp_path):
    path = str(tmp_path / "kept")
    at = lambda *rows: spark.createDataFrame(rows, "k int, v int")
    store.replace(at((1, 10), (1, 11), (2, 20)), path, 0, ["k"], compact=2)
    store.replace(at((1, 12)), path, 1, ["k"], compact=2)
    assert {tuple(r) for r in store.before(spark, path, 1, ["k"]).select("k", "v").collect()} == {(1, 10), (1, 11), (2, 20)}
    store.replace(at((3, 30)), path, 2, ["k"], compact=2)
    assert [p.name for p in (tmp_path / "kept").iterdir() if p.name.startswith("batch")] == ["batch=2"]
    assert {tuple(r) for r in store.latest(spark.read.parquet(path), ["k"]).select("k", "v").collect()} == {(1, 12), (2, 20), (3, 30)}
    store.replace(at((7, 70)), path, 0, ["k"], compact=2)
    assert {tuple(r) for r in store.latest(spark.read.parquet(path), ["k"]).select("k", "v").collect()} == {(7, 70)}


def test_rates_go_on_after_a_restart(spark, tmp_path, halves):
    t, parts = halves
    kept, listener = str(tmp_path / "rates"), None
    for k, part in enumerate(parts):
        stream = rates.observed(arriving(spark, part, tmp_path / "in"))
        listener = rates.RateListener(spark, kept)
        spark.streams.addListener(listener)
        try:
            listener.finish(cs.stream_crops(stream, str(tmp_path / "out"), str(tmp_path / "state"), ONE))
        finally:
            spark.streams.removeListener(listener)
        got = {r["batch"]: r for r in rates.read_rates(spark, kept).collect()}
        assert sorted(got) == list(range(k + 1)) and got[k]["processed_frames"] == part.count()
        assert all(r["processing_fps"] == r["processed_frames"] / r["seconds"] > 0 for r in got.values())
    assert len({r["query"] for r in got.values()}) == 1


# --- two streams -----------------------------------------------------------------------------


def timed(df):
    return df.withColumn("event_time", F.timestamp_seconds("frame_no"))


def test_second_pass_in_either_order(spark, tmp_path, halves):
    t, parts = halves
    full = [timed(p) for p in parts]
    quick = [p.withColumn("detections", F.filter("detections", lambda d: d["model_source"] == "yolo")) for p in full]
    for q, f in ((quick[0], full[1]), (quick[1], full[0])):
        streams = arriving(spark, q, tmp_path / "quick"), arriving(spark, f, tmp_path / "full")
        sinks.stream_two_pass(*streams, str(tmp_path / "out"), str(tmp_path / "state"), ALL, delay="1000 days").awaitTermination()
    assert same(spark.read.parquet(str(tmp_path / "out")).drop("batch"), two_pass(t.frames, t.det, t.regions, ALL))


def test_second_pass_keeps_only_detections_that_vote(spark, tmp_path, halves):
    t, parts = halves
    full = timed(parts[0])
    quick = full.withColumn("detections", F.filter("detections", lambda d: d["model_source"] == "yolo"))
    streams = arriving(spark, quick, tmp_path / "quick"), arriving(spark, full, tmp_path / "full")
    sinks.stream_two_pass(*streams, str(tmp_path / "out"), str(tmp_path / "state"), ALL, delay="1000 days").awaitTermination()
    kept = [p.read_bytes() for p in (tmp_path / "state" / "state").rglob("schema*") if p.is_file()]
    assert any(b"detections" in k for k in kept) and not any(b"regions" in k for k in kept)


def test_second_pass_keeps_its_state_outside_the_heap(spark, tmp_path, halves):
    t, parts = halves
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    full = timed(parts[0]).limit(20)
    streams = arriving(spark, full, tmp_path / "quick"), arriving(spark, full, tmp_path / "full")
    sinks.stream_two_pass(*streams, str(tmp_path / "out"), str(tmp_path / "state"), ALL, delay="1000 days").awaitTermination()
    assert lr.STATE_STORE in (tmp_path / "state" / "offsets" / "0").read_text()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_state_of_single_rows_is_compressed():
    n = 5000
    rows = {c: np.arange(n, dtype=np.int64 if c == "frame_key" else np.int32) // 8 for c in lr._COLUMNS}
    rows["confidence"] = np.where(np.arange(n) % 3 == 0, np.nan, 0.5)
    rows["model_source"] = np.array([("yolo", None, "detr")[i % 3] for i in range(n)], object)
    plain = pickle.dumps(rows, protocol=5)
    stored = lr._stored(rows)
    for back in (lr._restored(stored), lr._restored(plain)):
        assert list(back) == list(rows)
        assert all(back[c].dtype == v.dtype and pd.Series(back[c]).equals(pd.Series(v)) for c, v in rows.items())
    assert 10 * len(stored) < len(plain)
    none = lr._restored(lr._stored({c: v[:0] for c, v in rows.items()}))
    assert all(len(none[c]) == 0 and none[c].dtype == v.dtype for c, v in rows.items())


def test_text_gate_waits_for_regions(spark, tmp_path):
    frame = T.StructType([*schemas.FRAMES.fields, T.StructField("event_time", T.TimestampType())])
    now = datetime.datetime(2026, 1, 1)
    at = lambda s: now + datetime.timedelta(seconds=s)
    frames = spark.createDataFrame([(1, k, k, 200, 100, at(k)) for k in range(4)] + [(1, 99, 99, 200, 100, at(999))], frame)
    rects = T.StructType([*schemas.REGIONS.fields, T.StructField("event_time", T.TimestampType())])
    text = lambda k, n: [(1, k, k, 200, 100, i, 1, 20, 90, 10, at(k)) for i in range(n)]

    def run(regions):
        streams = arriving(spark, frames.limit(0) if regions is None else frames, tmp_path / "f"), arriving(spark, spark.createDataFrame(regions or [], rects), tmp_path / "r")
        kept = sinks.stream_text_gate(*streams, delay="10 seconds").select(*schemas.FRAME_COLUMNS)
        query = kept.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c"))
        query.trigger(availableNow=True).start().awaitTermination()
        return sorted(r["frame_key"] for r in spark.read.parquet(str(tmp_path / "o")).collect())

    assert run(text(0, 1) + text(1, 2) + text(2, 3) + [(1, 99, 99, 200, 100, 0, 1, 20, 90, 10, at(999))]) == [0, 3]
    assert sinks.stream_text_gate(frames, None, Params(skip_text=False)) is frames
