from pyspark.sql import functions as F
from samples import crowd, det

from contract.tables import tables
from reelsift import schemas
from reelsift.operators import detections, stats
from reelsift.params import Params
from reelsift.plans.curate import curate
from reelsift.streaming import curate_stream as cs

SF_DIR = "/root/testdata/sf0.001"
ALL = Params(interval=1, ensemble=True)
ONE = Params(interval=2)


def same(a, b):
    columns = sorted(b.columns)
    assert sorted(a.columns) == columns
    a, b = a.select(columns), b.select(columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def nested_of(spark, table):
    members = [f.name for f in schemas.NESTED_DETECTION.fields]
    rows = table.groupBy(*schemas.FRAME_COLUMNS).agg(
        F.shuffle(F.collect_list(F.struct(*members))).alias("detections")
    )
    empty = F.array().cast(schemas.NESTED["regions"].dataType)
    return rows.withColumn("regions", empty).select(*schemas.NESTED.names)


def test_nested_rows_give_the_same_outcomes(spark):
    """Crowded frames, arrays in any order."""
    models = ["yolo", "detr", "fasterrcnn"]
    frames = [[(*b, models[i % 3], 0.5 + i / 100) for i, b in enumerate(crowd(s, 30, copies=0.3))] for s in range(12)]
    table = det(spark, *frames)
    nested = nested_of(spark, table)
    for params in (ALL, Params(interval=1), Params(interval=1, ensemble=True, models=("detr", "yolo"))):
        batch = curate(nested, table, None, params).outcomes
        assert same(cs.curate_nested(nested, params), batch)
        assert batch.filter("outcome = 'saved'").count() > 0


def test_large_frames_take_the_same_path(spark):
    """A frame of 10,000 detections and some small ones: nested rows give what tables give."""
    models = ["yolo", "detr", "fasterrcnn"]
    frames = [[(*b, models[i % 3], 0.5 + i % 50 / 100) for i, b in enumerate(crowd(3, 10_000, spread=1500, copies=0.5))]]
    frames += [[(*b, models[i % 3]) for i, b in enumerate(crowd(s, 20, copies=0.3))] for s in range(3)]
    table = det(spark, *frames)
    nested = nested_of(spark, table)
    batch = curate(nested, table, None, ALL).outcomes
    assert same(cs.curate_nested(nested, ALL), batch)
    split = detections.categorise_nested(nested).filter("frame_key = 1").first()
    assert len(split.person) + len(split.animal) + len(split.object) == 10_000


def test_categorise_nested(spark):
    table = det(spark, [(0, 0, 0, 1, 1), (16, 0, 0, 2, 2), (0, 0, 0, 3, 3), (5, 0, 0, 4, 4)])
    row = detections.categorise_nested(nested_of(spark, table)).first()
    assert sorted(d.x2 for d in row.person) == [1, 3]
    assert [d.x2 for d in row.animal] == [2]
    assert [d.x2 for d in row.object] == [4]


def parts_of(spark, tmp_path):
    """The frames of the given tables, arriving in three files."""
    t = tables(spark, SF_DIR)
    nested = t.nested.withColumn("part", F.col("frame_key") % 3).persist()
    source = str(tmp_path / "in")
    return t, source, [nested.filter(F.col("part") == i).drop("part").coalesce(1) for i in range(3)]


def test_crops_across_stop_and_restart(spark, tmp_path):
    t, source, parts = parts_of(spark, tmp_path)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def work():
        stream = spark.readStream.schema(schemas.NESTED).parquet(source)
        query = cs.stream_crops(stream, out, state, ALL)
        query.awaitTermination()
        query.stop()
        return query

    parts[0].write.mode("append").parquet(source)
    query = work()
    assert cs.stream_rate(query) >= 0.0
    first = spark.read.parquet(out).count()
    work()  # nothing new, nothing twice
    assert spark.read.parquet(out).count() == first
    parts[1].write.mode("append").parquet(source)
    parts[2].write.mode("append").parquet(source)
    work()
    assert same(spark.read.parquet(out), curate(t.frames, t.det, t.regions, ALL).crops)


def test_running_statistics(spark, tmp_path):
    t, source, parts = parts_of(spark, tmp_path)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for part in parts:
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(schemas.NESTED).parquet(source)
        cs.stream_stats(stream, out, state, ONE).awaitTermination()
    batch = stats.count_outcomes(curate(t.frames, t.det, t.regions, ONE).outcomes, ONE)
    assert same(cs.read_stats(spark.read.parquet(out)), batch)


def test_statistics_are_compacted_and_start_over(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cs, "COMPACT", 1)
    t, source, parts = parts_of(spark, tmp_path)
    out = tmp_path / "out"
    batch = stats.count_outcomes(curate(t.frames, t.det, t.regions, ONE).outcomes, ONE)
    for state in ("first", "second"):  # a new checkpoint counts from nothing
        for part in parts if state == "first" else [None]:
            if part is not None:
                part.write.mode("append").parquet(source)
            stream = spark.readStream.schema(schemas.NESTED).parquet(source)
            cs.stream_stats(stream, str(out), str(tmp_path / state), ONE).awaitTermination()
        assert len(list(out.glob("batch=*"))) == 1
        assert same(cs.read_stats(spark.read.parquet(str(out))), batch)


def test_single_rows_become_frames_and_late_ones_are_counted(spark, tmp_path):
    t = tables(spark, SF_DIR)
    kinds = {"frames": t.frames, "detections": t.det, "regions": t.regions}
    some = F.col("frame_key") % 4 == 0
    at = F.timestamp_seconds(F.col("frame_no"))
    streams = {}
    for name, table in kinds.items():
        rows = table.filter(some).withColumn("event_time", at).coalesce(1)
        rows.write.parquet(str(tmp_path / name))
        streams[name] = spark.readStream.schema(rows.schema).parquet(str(tmp_path / name))
    last = t.frames.limit(1).withColumns({"event_time": F.timestamp_seconds(F.lit(10**9)), "frame_key": F.lit(-1).cast("long")})

    def run():
        nested = cs.nest_rows(**streams, delay="1 minute").select(*schemas.NESTED.names)
        return cs.stream_crops(nested, str(tmp_path / "out"), str(tmp_path / "state"), ALL)

    run().awaitTermination()
    last.write.mode("append").parquet(str(tmp_path / "frames"))  # time goes on, so frames are complete
    run().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = curate(*(df.filter(some) for df in kinds.values()), ALL).crops
    assert same(got, want.select(got.columns)) and got.count() > 0
    late = t.det.filter(some).dropDuplicates(["frame_key"]).limit(3).withColumn("event_time", at)
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "detections"))
    query = run()
    query.awaitTermination()
    assert cs.late_frames(query) == 3 and same(spark.read.parquet(str(tmp_path / "out")), got)
