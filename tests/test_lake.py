"""The lake's own tests: listing, names, source options, the committed sink, ingest, deltas and levels."""

import json
import os
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from footage_spark import fixtures as fx
from footage_spark.operators import pixels as px
from footage_spark.operators import timing as tm
from footage_spark.plans import extract as ex
from footage_spark.plans import frame_files as ff
from footage_spark.sources import footage as ft
from footage_spark.sources import recordings as rc
from footage_spark.streaming import ingest as ing

W, H, N = 16, 12, 40
PIXELS = np.random.default_rng(7).integers(0, 256, (N, H, W), dtype=np.uint8)


def put(root, name, n=N, sidecar=True, stated=N):
    fx.write_recording(f"{root}/{name}", PIXELS[:n], range(1000, 1000 + 2000 * n, 2000), fx.sidecar_text(W, H, stated) if sidecar else None)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def lake(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("lake"))
    for name in ("a/one", "b/two", "c/three"):
        put(root, name)
    put(root, "d/bare", sidecar=False)
    put(root, "top")
    return root


# listing and names


def test_only_root_and_the_folders_below_it_are_opened(spark, lake, tmp_path):
    root = f"{tmp_path}/lake"
    put(root, "a/seen")
    put(root, "a/deep/unseen")
    put(root, ".hidden/unseen")
    put(root, "a/.unseen")
    os.symlink(root, f"{root}/a/round")  # a walk that went on would never end, or find all again
    os.makedirs(f"{root}/empty")
    got = rc.recordings(spark, root).collect()
    assert [(r["stem"], r["camera_dir"], r["status"]) for r in got] == [("seen", f"{root}/a", "ok")]
    assert rc.recordings(spark, f"{root}/empty").count() == 0
    with pytest.raises(FileNotFoundError):
        rc.recordings(spark, f"{root}/absent")


def test_names_stay_when_recordings_come(spark, tmp_path):
    root, register = f"{tmp_path}/lake", f"{tmp_path}/names"
    names = lambda: {os.path.relpath(r["recording"], root): r["out_name"] for r in rc.discover_recordings(spark, root, register).collect()}
    for x in ("m/good", "n/go.od"):
        put(root, x, 1)
    first = names()
    assert first == {"m/good.bin": "good", "n/go.od.bin": "go_od"}
    for x in ("a/good", "b/go_od", "c/good_2", "d/good"):  # all of them would come before by path
        put(root, x, 1)
    second = names()
    assert second.items() >= first.items() and len(set(second.values())) == 6
    assert names() == second and spark.read.parquet(register).count() == 6
    # the ingest gives the same names
    ing.ingest_new_recordings(spark, root, f"{tmp_path}/out", f"{tmp_path}/state", register=register).awaitTermination()
    assert {os.path.relpath(r["recording"], root): r["out_name"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == second


# the source


def test_source_options(spark, lake):
    ft.register_footage(spark)
    load = lambda **o: spark.read.format("footage").options(**o).load(lake)
    assert load().count() == 4 * N  # the bare one has no geometry
    assert load(width=W, height=H).count() == 5 * N
    some = load(start=10, count=5, recordings="a/*,two,nothing")
    assert sorted((os.path.basename(r["recording"]), r["frame_index"]) for r in some.select("recording", "frame_index").collect()) == [(x, i) for x in ("one.bin", "two.bin") for i in range(10, 15)]
    small = load(chunk_bytes=7 * (8 + W * H))
    assert small.rdd.getNumPartitions() == 4 * 6
    one = small.where((F.col("recording") == f"{lake}/a/one.bin") & (F.col("frame_index") >= 30) & (F.col("frame_index") < 38))
    assert one.rdd.getNumPartitions() == 2 and sorted(r["frame_index"] for r in one.collect()) == list(range(30, 38))
    assert all(bytes(r["pixels"]) == PIXELS[r["frame_index"]].tobytes() for r in one.collect())
    two = load().where(F.col("recording").isin(f"{lake}/b/two.bin", f"{lake}/top.bin") & (F.col("frame_index") == 3))
    assert two.rdd.getNumPartitions() == 2 and two.count() == 2
    heads = spark.read.format("footage").schema(ft.HEADERS).load(lake)
    assert heads.where("tick <> 1000 + 2000 * frame_index").count() == 0 and heads.count() == 4 * N
    for bad in ({"start": N}, {"start": -1}):
        with pytest.raises(Exception, match="start is below 0|no recording has frame"):
            load(**bad).count()


def test_source_in_sql(spark, lake):
    ft.register_footage(spark)
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW frames_of USING footage OPTIONS (root '{lake}', start '38', recordings 'o*')")
    assert spark.sql("SELECT count(*), min(frame_index) FROM frames_of").first() == (2, 38)
    spark.sql("CREATE TABLE frames_table USING footage")
    # tables keep no options for sources in Python, so they are given where the table is read
    assert spark.sql(f"SELECT count(*) FROM frames_table WITH (root = '{lake}', count = 3)").first()[0] == 12
    spark.sql("DROP TABLE frames_table")


def test_source_plans_as_the_catalogue_does(spark, lake):
    known = {r["recording"]: (r["frames_total"], r["frame_stride"]) for r in rc.recordings(spark, lake).where("status = 'ok'").collect()}
    assert {r["path"]: (r["n"], r["stride"]) for r in ft.plan_root(lake, [])} == known
    for xml in ("<broken", "", None, "<a><Footage><ResolutionX>256px</ResolutionX></Footage></a>", fx.sidecar_text(None, 3, 5)):
        assert ft.sidecar_numbers(xml)[0] is None
    assert ft.sidecar_numbers(fx.sidecar_text(4, 3, 5)) == (4, 3, 5)


# extraction


def test_reports_read_no_images(spark, lake, tmp_path):
    report = ex.batch_extract(spark, lake, f"{tmp_path}/out", start=5, count=30)
    rows = {os.path.basename(r["recording"]): (r["frames_written"], r["output_bytes"]) for r in report.collect()}
    images = spark.read.parquet(f"{tmp_path}/out/images")
    assert rows == {os.path.basename(r["recording"]): (r["n"], r["b"]) for r in images.groupBy("recording").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("image")).alias("b")).collect()}
    catalog = spark.read.parquet(f"{tmp_path}/out/catalog").where("status = 'ok'")
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(ex.extract_report(images, catalog)))
    assert schemas and all("bytes" in x or "frames_total" in x for x in schemas) and not any("image" in x for x in schemas)
    stamps = spark.read.csv(f"{tmp_path}/out/timestamps", header=True)
    assert stamps.count() == 4 * 30 and stamps.where("timestamp_raw <> 1000 + 2000 * frame_index").count() == 0
    # what is written again counts once
    ex.batch_extract(spark, lake, f"{tmp_path}/out", start=5, count=30)
    assert spark.read.parquet(f"{tmp_path}/out/report").agg(F.sum("frames_written")).first()[0] == 120


def files_under(root):
    return sorted(os.path.relpath(os.path.join(d, x), root) for d, _, names in os.walk(root) for x in names)


def test_no_file_has_its_name_if_a_task_fails(spark, lake, tmp_path):
    images = ex.extract_images(spark, rc.recordings(spark, lake).where("status = 'ok'"))

    def fail(batches):
        for batch in batches:
            if any("three" in x for x in batch.column("recording").to_pylist()):
                time.sleep(2)  # others have staged theirs
                raise ValueError("this task fails")
            yield batch

    with pytest.raises(Exception, match="this task fails"):
        ff.write_files(images.mapInArrow(fail, images.schema), f"{tmp_path}/out")
    assert files_under(f"{tmp_path}/out") == []
    manifest = ff.write_files(images, f"{tmp_path}/out")
    kept = files_under(f"{tmp_path}/out")
    assert len(kept) == 4 * N == manifest.count() and {f"{tmp_path}/out/{x}" for x in kept} == {r["path"] for r in manifest.collect()}
    assert manifest.where("bytes <= 0 or tick <> 1000 + 2000 * frame_index").count() == 0


def test_only_committed_attempts_count(spark, tmp_path, monkeypatch):
    root, attempts = f"{tmp_path}/out", iter(range(10))

    class Context:
        partitionId = staticmethod(lambda: 3)
        taskAttemptId = staticmethod(lambda: next(attempts))

    monkeypatch.setattr(ff.TaskContext, "get", classmethod(lambda cls: Context))
    writer = ff.FrameFileWriter({"path": root, "job": "j"})
    rows = lambda image: [pa.RecordBatch.from_pylist([{"recording": "r", "frame_index": i, "tick": i, "out_name": "r", "file_name": f"{i}.Png", "image": image} for i in range(3)])]
    writer.write(iter(rows(b"lost attempt")))
    kept = writer.write(iter(rows(b"kept")))
    assert not files_under(root) and len(files_under(ff.jobs(root))) == 8
    writer.commit([kept, None])
    record = json.load(open(ff.commit_path(root, "j")))
    assert (record["frames"], record["bytes"]) == (3, 12)
    # a promotion that stopped after one file goes on where it was
    os.makedirs(f"{root}/r")
    os.replace(f"{ff.jobs(root)}/staging/j/{kept.listing}/r/1.Png", f"{root}/r/1.Png")
    manifest = ff.promote(spark, root, "j")
    assert manifest.count() == 3 and all(open(r["path"], "rb").read() == b"kept" for r in manifest.collect())
    assert ff.promote(spark, root, "j").count() == 3 and not os.path.exists(f"{ff.jobs(root)}/staging/j")


def test_curves_beyond_the_limit_move_no_pixels(spark, lake, tmp_path):
    catalog = rc.recordings(spark, lake).where("status = 'ok'").withColumn("mode_b", F.length("stem").cast("double"))
    frames = ft.read_frames(spark, catalog)
    few, many = px.with_curve(frames, catalog), px.with_curve(frames, catalog.where("stem <> 'top'"), f"{tmp_path}/curves", most=0)
    lines = plan(many).split("\n")
    # only chunk rows are dealt, below the scan of frames
    assert not any("Exchange" in x or "Join" in x for x in lines[: max(i for i, x in enumerate(lines) if "MapInArrow" in x)])
    short = lambda df: df.select("recording", "frame_index", *px.CURVE)
    assert short(few.where("recording not like '%/top.bin'")).exceptAll(short(many)).count() == 0 and many.count() == 3 * N


# ingest


def test_ingest_keeps_only_what_waits(spark, tmp_path):
    def run(name, **options):
        root, out = f"{tmp_path}/{name}", f"{tmp_path}/{name}-out"
        ing.ingest_new_recordings(spark, root, out, f"{root}-state", **options).awaitTermination()
        return sorted((r["stem"], r["status"]) for r in spark.read.parquet(out).collect())

    def waiting(name):
        return spark.read.format("statestore").option("path", f"{tmp_path}/{name}-state").option("stateVarName", "seen").load().count()

    put(f"{tmp_path}/lake", "a/whole")
    assert run("lake") == [("whole", "ok")]
    put(f"{tmp_path}/lake", "a/whole")  # written again: it was taken
    put(f"{tmp_path}/elsewhere", "moved")
    os.makedirs(f"{tmp_path}/lake/d")
    for x in (".bin", ".footage"):  # moved here with an old time
        os.utime(f"{tmp_path}/elsewhere/moved{x}", (1, 1))
        os.replace(f"{tmp_path}/elsewhere/moved{x}", f"{tmp_path}/lake/d/moved{x}")
    time.sleep(0.2)
    assert run("lake") == [("moved", "ok"), ("whole", "ok")] and waiting("lake") == 0
    put(f"{tmp_path}/late", "b/short", 10)
    put(f"{tmp_path}/late", "c/lone", sidecar=False)
    assert run("late", wait_seconds=0.001) == [("short", "incomplete")] and waiting("late") == 2
    given_up = [("lone", "expired"), ("short", "expired"), ("short", "incomplete")]
    assert run("late", wait_seconds=0.001) == given_up and run("late", wait_seconds=0.001) == given_up and waiting("late") == 0


# deltas and levels


def test_deltas_across_runs(spark):
    rng = np.random.default_rng(2)
    numbers = [0, 1, 2, *np.flatnonzero(rng.random(3000) < 0.7).tolist()[5:], 9000, 20_000, 20_001]
    made = [("long", int(i), int(rng.integers(0, 2**40))) for i in sorted(set(numbers))] + [("one", 7, 5), ("unsigned", 999, 2**63 - 1), ("unsigned", 1000, -(2**63))]
    ticks = spark.createDataFrame(made, "recording string, frame_index long, tick long").repartition(4)
    exact = F.col("tick").cast("decimal(20,0)") + F.when(F.col("tick") < 0, F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(0)
    want = ticks.withColumn("delta", (exact - F.lag(exact).over(Window.partitionBy("recording").orderBy("frame_index"))).cast("long"))
    for frames in (1, 7, 1000, 1 << 18):
        got = tm.tick_delta(ticks, frames)
        assert got.exceptAll(want).count() == 0 and got.count() == len(made)


def test_one_long_recording_is_spread_over_tasks(spark):
    ticks = spark.range(400_000).select(F.lit("r").alias("recording"), F.col("id").alias("frame_index"), (F.col("id") * 2000).alias("tick"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = tm.tick_delta(ticks, 10_000).withColumn("task", F.spark_partition_id())
        sizes = [r["count"] for r in got.groupBy("task").count().collect()]
        assert max(sizes) <= 200_000 and got.where("delta <> 2000").count() == 0 and got.where("delta is null").count() == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_histograms_by_level(spark):
    made = [(f"r{k % 3}", k, "raw" if k % 2 else "reference", bytes(PIXELS[k % N].tobytes()) if k != 5 else None) for k in range(30)]
    got = px.grouped_histograms(spark.createDataFrame(made, "recording string, frame_index long, mode string, pixels binary").repartition(3)).collect()
    want = {}
    for r, i, m, p in made:
        for group in (("frame", r, i, m), ("recording", r, None, None), ("mode", None, None, m)):
            want[group] = want.get(group, 0) + np.bincount(np.frombuffer(p or b"", np.uint8), minlength=256)
    assert {(r["level"], r["recording"], r["frame_index"], r["mode"]): r["bins"] for r in got} == {k: v.tolist() for k, v in want.items()}


def test_batch_status(spark):
    made = [("cam1", "a", "ok", 5), ("cam1", "b", "no frames", None), ("cam2", "c", "ok", 7)]
    got = {(r["level"], r["camera_dir"], r["recording"]): (r["recordings"], r["ok"], r["failed"], r["frames"], r["status"]) for r in tm.batch_summary(spark.createDataFrame(made, "camera_dir string, recording string, status string, frames_total long")).collect()}
    assert got == {
        ("recording", "cam1", "a"): (1, 1, 0, 5, "ok"), ("recording", "cam1", "b"): (1, 0, 1, 0, "no frames"), ("recording", "cam2", "c"): (1, 1, 0, 7, "ok"),
        ("camera", "cam1", None): (2, 1, 1, 5, "failed"), ("camera", "cam2", None): (1, 1, 0, 7, "ok"), ("batch", None, None): (3, 2, 1, 12, "failed"),
    }


def test_timestamp_folders_without_a_listing_each(spark, tmp_path):
    """Names of any kind, nulls, a recording in several tasks; read the same by Spark, and by few tasks; written again, the old go."""
    from footage_spark.plans import stamp_files as sf

    rows = [(n, i, None if i == 2 else i * 10, None if i == 2 else f"0x{i:016X}") for n in ("a b", "x=1/y%", "z:[", "caf\u00e9", "plain") for i in range(5)]
    stamps = spark.createDataFrame(rows, "name string, frame_index long, timestamp_raw long, timestamp_hex string").repartition(3, "frame_index")
    path = str(tmp_path / "stamps")
    for _ in range(2):
        sf.write_stamp_files(stamps, path)
        back = sf.read_stamp_files(spark, path).select("name", "frame_index", "timestamp_raw", "timestamp_hex")
        plain = spark.read.schema("frame_index long, timestamp_raw long, timestamp_hex string, name string").csv(path, header=True)
        key = lambda r: tuple(map(str, r))
        assert sorted(map(tuple, back.collect()), key=key) == sorted(rows, key=key)
        assert sorted(map(tuple, plain.select(*back.columns).collect()), key=key) == sorted(rows, key=key)
    assert not os.listdir(f"{path}-jobs")
