"""The recordings' own tests: files written here, numpy as the independent expectation."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from footage_spark import fixtures as fx
from footage_spark.functions.display import display_level, lut
from footage_spark.operators import images as im
from footage_spark.operators import pixels as px
from footage_spark.operators import timing as tm
from footage_spark.operators import verify as vf
from footage_spark.plans import extract as ex
from footage_spark.sources import footage as ft
from footage_spark.sources import recordings as rc
from footage_spark.streaming import ingest as ing

W, H, N = 16, 12, 40


@pytest.fixture(scope="module")
def lake(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("lake"))
    pixels = np.random.default_rng(42).integers(0, 256, (N, H, W), dtype=np.uint8)
    ticks = [10_000_000 + 2000 * i for i in range(N)]
    fx.write_recording(f"{root}/a/good", pixels, ticks, fx.sidecar_text(W, H, N))
    fx.write_recording(f"{root}/b/good", pixels, [2**63 + 2000 * i for i in range(N)], fx.sidecar_text(W, H, N))
    fx.write_recording(f"{root}/c/cut", pixels[:3], ticks[:3], fx.sidecar_text(W, H, N))
    with open(f"{root}/c/cut.bin", "ab") as out:
        out.write(b"0123456789")
    fx.write_recording(f"{root}/d/bare", pixels, ticks, None)
    fx.write_recording(f"{root}/e/bad", pixels, ticks, "<broken")
    fx.write_recording(f"{root}/f/nosettings", pixels, ticks, fx.sidecar_text(W, H, N, settings=False))
    fx.write_recording(f"{root}/g/text", pixels, ticks, fx.sidecar_text("256px", H, N))
    fx.write_recording(f"{root}/h/too/deep", pixels, ticks, fx.sidecar_text(W, H, N))
    return root, pixels


def test_catalogue(spark, lake):
    rows = {(os.path.basename(r["camera_dir"]), r["stem"]): r for r in rc.recordings(spark, lake[0]).collect()}
    assert {k: v["status"] for k, v in rows.items()} == {
        ("a", "good"): "ok", ("b", "good"): "ok", ("c", "cut"): "ok", ("d", "bare"): "unknown geometry", ("e", "bad"): "unknown geometry", ("f", "nosettings"): "no processing settings", ("g", "text"): "unknown geometry",
    }
    assert rows["c", "cut"]["frames_total"] == 3 and rows["c", "cut"]["trailing_bytes"] == 10
    assert {rows["a", "good"]["out_name"], rows["b", "good"]["out_name"]} == {"good", "good_2"}
    bare = rc.recordings(spark, lake[0], mode="raw", width=W, height=H).where("stem = 'bare'").first()
    assert bare["status"] == "ok" and bare["frames_total"] == N
    total = tm.batch_summary(rc.recordings(spark, lake[0])).where("camera_dir is null").first()
    assert (total["recordings"], total["ok"], total["failed"]) == (7, 3, 4)


def test_scan_ranges_and_chunks(spark, lake):
    catalog = rc.recordings(spark, lake[0])
    whole = ft.read_frames(spark, catalog)
    assert whole.count() == 2 * N + 3 and whole.where("frame_index < 5").count() == 13 and whole.count() == 2 * N + 3
    part = ft.read_frames(spark, catalog, 10, 5).where("recording like '%/a/%'").orderBy("frame_index").collect()
    assert [r["frame_index"] for r in part] == [10, 11, 12, 13, 14]
    assert all(bytes(r["pixels"]) == lake[1][r["frame_index"]].tobytes() for r in part)
    small = ft.read_frames(spark, catalog, chunk_bytes=7 * (8 + W * H)).select("recording", "frame_index", "tick", F.md5("pixels").alias("m"))
    assert small.exceptAll(whole.select("recording", "frame_index", "tick", F.md5("pixels").alias("m"))).count() == 0 and small.count() == 2 * N + 3
    rows = catalog.where("status = 'ok'").collect()
    source = ft.load_footage(spark, [{"path": ft.local_path(r["recording"]), "first": 0, "n": r["frames_total"], "stride": r["frame_stride"], "width": W, "height": H} for r in rows])
    assert source.select("recording", "frame_index", "tick", F.md5("pixels").alias("m")).exceptAll(small).count() == 0 and source.count() == 2 * N + 3
    ordered = ft.read_frames(spark, catalog, 2, 30, carry=["out_name"], in_order=True, chunk_bytes=7 * (8 + W * H)).select("out_name", "recording", "frame_index").collect()
    assert [tuple(r)[1:] for r in ordered] == sorted(tuple(r)[1:] for r in ordered) and len(ordered) == 61 and {r[0] for r in ordered} == {"good", "good_2", "cut"}
    asked = catalog.where("status = 'ok'").select("recording", F.explode(F.expr("array(-3L, 2L, 77L)")).alias("frame_index"))
    at = sorted((os.path.basename(r["recording"]), r["frame_index"]) for r in ft.read_frames_at(spark, catalog, asked).collect())
    assert at == [("cut.bin", 0), ("cut.bin", 2), *[("good.bin", i) for i in (0, 0, 2, 2, N - 1, N - 1)]]
    with pytest.raises(ValueError):
        ft.read_frames(spark, catalog, N)
    name = catalog.where("stem = 'cut'").first()["recording"]
    assert ft.read_frame(spark, catalog, name, 99).first()["frame_index"] == 2


def test_headers_of_large_frames(spark, tmp_path):
    pixels = np.zeros((5, 80, 90), np.uint8)
    fx.write_recording(f"{tmp_path}/a/big", pixels, [7, 8, 9, 10, 2**64 - 1], fx.sidecar_text(90, 80, 5))
    got = ft.read_timestamps(spark, rc.recordings(spark, str(tmp_path)), 1, 9).orderBy("frame_index").collect()
    assert [(r["frame_index"], r["timestamp_raw"]) for r in got] == [(1, 8), (2, 9), (3, 10), (4, -1)]


def test_output_names_never_collide(spark, tmp_path):
    for x in ("a/good", "b/good", "c/good_2", "d/go.od", "e/go_od"):
        fx.write_recording(f"{tmp_path}/{x}", np.zeros((1, 2, 2), np.uint8), [1], fx.sidecar_text(2, 2, 1))
    names = [r["out_name"] for r in rc.recordings(spark, str(tmp_path)).select("out_name").collect()]
    assert len(set(names)) == 5 and {"good", "good_2", "go_od", "go_od_2"} < set(names)


def test_pixels_are_never_shuffled(spark, tmp_path):
    """Recordings of 3.84 GB (sparse files): every exchange of an extraction is of chunk rows, below the frame scan."""
    for k in range(4):
        os.makedirs(f"{tmp_path}/c{k}")
        with open(f"{tmp_path}/c{k}/r{k}.bin", "wb") as out:
            out.truncate(50_000 * 76_808)
        with open(f"{tmp_path}/c{k}/r{k}.footage", "w") as out:
            out.write(fx.sidecar_text(256, 300, 50_000))
    catalog = rc.recordings(spark, str(tmp_path))
    images = ex._named(ex.extract_images(spark, catalog), catalog)
    timeline = px.playback_timeline(ft.read_frames(spark, catalog, 100, 2000, carry=px.CURVE, in_order=True), 25.0, 100, in_order=True)
    for df in (images, timeline):
        lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
        scan = max(i for i, x in enumerate(lines) if "MapInArrow" in x)
        assert not any("Exchange" in x or "Join" in x for x in lines[:scan]) and any("Exchange" in x for x in lines[scan:])
    assert ex.extract_images(spark, catalog, 49_998, 9).count() == 8


def test_extraction(spark, lake, tmp_path):
    """Images are the same in every run and for every level; files, stamps, metadata and failures stand where they should."""
    root, pixels = lake
    want = [im.png(p.tobytes().translate(lut(49, 18, 1)), W, H) for p in pixels]
    one = ex.batch_extract(spark, root, f"{tmp_path}/one", files=True).collect()
    assert {os.path.basename(r["recording"]): (r["frames_written"], r["input_bytes"]) for r in one}["cut.bin"] == (3, 3 * (8 + W * H)) and len(one) == 3
    assert all(r["frames_a_second"] > 0 and r["mib_a_second"] > 0 for r in one)
    assert sorted(os.listdir(f"{tmp_path}/one/frames")) == ["cut", "good", "good_2"]
    for k in range(N):
        with open(f"{tmp_path}/one/frames/good/cam_{k:05d}.Png", "rb") as file:
            assert file.read() == want[k]
    assert spark.read.parquet(f"{tmp_path}/one/failed").count() == 4
    stamps = spark.read.csv(f"{tmp_path}/one/timestamps", header=True)
    assert stamps.where("name = 'good_timestamps'").count() == N and stamps.count() == 2 * N + 3
    assert spark.read.text(f"{tmp_path}/one/metadata").where("value like '%\"effective_fps_from_timestamps\":500.0%'").count() == 3
    ex.batch_extract(spark, root, f"{tmp_path}/two", start=10, count=5, recording=f"{root}/a/good.bin")
    two = spark.read.parquet(f"{tmp_path}/two/images").orderBy("frame_index").collect()
    assert [r["frame_index"] for r in two] == list(range(10, 15)) and [bytes(r["image"]) for r in two] == want[10:15]
    frames = ft.read_frames(spark, rc.recordings(spark, root), carry=px.CURVE).repartition(7)
    low, high = (im.encode_frames(px.apply_display_transform(frames), level=x) for x in (-5, 99))  # levels are clamped to 0..9
    assert vf.verify_images(low, high.where("frame_index >= 0"))[1].first()["mismatched"] == 0
    marks = [vf.frame_fingerprint(im.encode_frames(px.apply_display_transform(f)), "image") for f in (frames, frames.coalesce(1))]
    assert vf.fingerprint_set_equal(*marks, "image").first()["equal"]


def test_zlib_header():
    body = im.png(bytes(range(100)), 10, 10)
    kinds, at = [], 8
    while at < len(body):
        n = int.from_bytes(body[at : at + 4], "big")
        kinds.append(body[at + 4 : at + 8])
        if kinds[-1] == b"IDAT":
            assert body[at + 8 : at + 10] == b"\x78\x5e"
        at += 12 + n
    assert kinds == [b"IHDR", b"sRGB", b"gAMA", b"pHYs", b"IDAT", b"IEND"]


def test_ingest_takes_late_recordings_again(spark, tmp_path):
    root, pixels = f"{tmp_path}/lake", np.zeros((6, 4, 4), np.uint8)
    fx.write_recording(f"{root}/a/whole", pixels, range(6), fx.sidecar_text(4, 4, 6))
    fx.write_recording(f"{root}/b/short", pixels[:2], range(2), fx.sidecar_text(4, 4, 6))
    os.makedirs(f"{root}/c")
    with open(f"{root}/c/none.footage", "w") as car:
        car.write(fx.sidecar_text(4, 4, 6))
    taken = []

    def run():
        ing.ingest_new_recordings(spark, root, f"{tmp_path}/out", f"{tmp_path}/state", then=lambda df: taken.extend(r["stem"] for r in df.collect())).awaitTermination()
        return sorted((r["stem"], r["status"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    first = [("none", "incomplete"), ("short", "incomplete"), ("whole", "ok")]
    assert run() == first and run() == first and taken == ["whole"]
    fx.write_recording(f"{root}/b/short", pixels, range(6), fx.sidecar_text(4, 4, 6))
    fx.write_recording(f"{root}/d/new", pixels, range(6), fx.sidecar_text(4, 4, 6))
    assert run() == sorted([*first, ("short", "ok"), ("new", "ok")]) and run() == sorted([*first, ("short", "ok"), ("new", "ok")])
    assert sorted(taken) == ["new", "short", "whole"]


def test_unsigned_ticks(spark, lake):
    stamps = ft.read_timestamps(spark, rc.recordings(spark, lake[0])).where("recording like '%/b/%'")
    assert stamps.where("frame_index = 1").first()["timestamp_hex"] == f"0x{2**63 + 2000:016X}"
    deltas = tm.tick_delta(stamps.withColumnRenamed("timestamp_raw", "tick")).where("delta is not null").select("delta").distinct().collect()
    assert [r[0] for r in deltas] == [2000]
    assert tm.recording_timing(stamps.withColumnRenamed("timestamp_raw", "tick")).first()["effective_fps"] == 500.0


def test_curve_forms_agree(spark):
    for b, c, g in ((49, 18, 1), (10, 20, 1), (0, 0, 1), (-20, 40, 2.2), (5, -10, 0)):
        got = [r[0] for r in spark.range(256).orderBy("id").select(display_level(F.col("id"), float(b), float(c), float(g))).collect()]
        assert bytes(got) == lut(b, c, g)
    table = lut(49, 18, 1)
    assert (table[34], table[35], table[36], table[138], table[139]) == (113, 114, 116, 254, 255)


@pytest.mark.parametrize("layout", list(px.LAYOUTS))
def test_png_round_trip(layout):
    gray = bytes(range(192))
    width, height, depth, colour, samples = im.decode_png(im.png(gray, 16, 12, layout))
    assert (width, height) == (16, 12) and im.to_gray8(samples, depth, colour) == gray


@pytest.mark.parametrize("layout", list(px.LAYOUTS))
def test_png_of_every_level(layout):
    """Flat, noisy and repeating frames, one pixel wide ones too; noise packs smaller than as unfiltered rows."""
    rng = np.random.default_rng(3)
    noise = np.clip(60 + rng.normal(0, 3, (40, 64)), 0, 255).astype(np.uint8)
    for frame in (noise, np.full((30, 50), 7, np.uint8), np.tile(rng.integers(0, 256, (1, 16), dtype=np.uint8), (40, 4)), rng.integers(0, 256, (9, 1), dtype=np.uint8)):
        h, w = frame.shape
        for level in range(10):
            made = im.png(frame.tobytes(), w, h, layout, level)
            width, height, depth, colour, samples = im.decode_png(made)
            assert (width, height) == (w, h) and im.to_gray8(samples, depth, colour) == frame.tobytes()
            assert samples == px.expand(frame.tobytes(), layout)
    plain = np.zeros((40, 65), np.uint8)
    plain[:, 1:] = noise
    assert len(im.png(noise.tobytes(), 64, 40, "gray8", 6)) < len(im._zlib(plain.tobytes(), 6)) + 120


@pytest.mark.parametrize("kind", range(5))
def test_png_row_filters(kind):
    import struct
    import zlib

    rng = np.random.default_rng(kind)
    want = rng.integers(0, 256, (9, 7 * 4), dtype=np.uint8)
    rows = b""
    for y in range(9):
        line = []
        for x in range(28):
            a = int(want[y, x - 4]) if x >= 4 else 0
            b = int(want[y - 1, x]) if y else 0
            c = int(want[y - 1, x - 4]) if y and x >= 4 else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((int(want[y, x]) - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        rows += bytes([kind, *line])
    raw = im.SIGNATURE + im._chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 9, 8, 6, 0, 0, 0)) + im._chunk(b"IDAT", zlib.compress(rows)) + im._chunk(b"IEND", b"")
    assert im.decode_png(raw)[4] == want.tobytes()


def test_verify_finds_one_flipped_byte(spark, lake):
    frames = px.apply_display_transform(px.with_curve(*(lambda c: (ft.read_frames(spark, c), c.withColumn("recording", F.regexp_replace("recording", "^file:", ""))))(rc.recordings(spark, lake[0]).where("camera_dir like '%/a'"))))
    ref = im.encode_frames(frames)
    same = im.encode_frames(frames.where("frame_index between 10 and 29"), layout="rgba16")
    report = vf.verify_images(ref, same, subset=True)[1].first()
    assert report["passed"] and report["names"] == "SUBSET-OK" and report["compared"] == 20
    bad = same.withColumn("image", F.when(F.col("frame_index") == 17, F.concat(F.expr("substring(image, 1, 119)"), F.expr("unhex(lpad(hex(255 - conv(hex(substring(image, 120, 1)), 16, 10)), 2, '0'))"), F.expr("substring(image, 121)"))).otherwise(F.col("image")))
    report = vf.verify_images(ref, bad, subset=True)[1].first()
    assert not report["passed"] and report["mismatched"] == 1 and report["first_mismatch"] == "cam_00017.Png"


def test_queries_have_sql():
    from footage_spark import queries

    assert set(queries.queries()) == set(queries.oracle_sql())


def test_images_are_read_in_one_pass_and_in_pieces(spark, lake, tmp_path):
    """Small files of large frames do not make one large batch; reading and its gray form, mapping and encoding are one pass each."""
    import pyarrow as pa

    from footage_spark.queries import queries

    flat = im.png(bytes(1 << 20), 1024, 1024)
    batch = pa.record_batch([pa.array(range(20)), pa.array([flat] * 18 + [None, flat[:-1]], pa.binary())], ["id", "image"])
    got = list(im.decoded_batches(["id"])([batch]))
    assert max(x.nbytes for x in got) < px.BATCH_BYTES + (2 << 20) and len(got) > 2
    rows = [r for x in got for r in x.to_pylist()]
    assert [r["id"] for r in rows] == list(range(20)) and all(r["pixels"] == bytes(1 << 20) for r in rows[:18]) and [r["error"] for r in rows[17:]] == [None, "not a PNG", "incomplete PNG"]
    wide = list(px.column_batches(["id"], "samples", lambda b: (px.expand(bytes(1 << 20), "rgba16") for _ in range(b.num_rows)))([batch]))
    assert len(wide) == 20 and [x.column("id")[0].as_py() for x in wide] == list(range(20))
    frames = ft.read_frames(spark, rc.recordings(spark, lake[0]), carry=px.CURVE)
    for layout in px.LAYOUTS:
        made = im.encode_mapped(frames, layout=layout)
        apart = im.encode_frames(px.apply_display_transform(frames), layout=layout)
        assert made.columns == apart.columns and made.exceptAll(apart).count() == 0 and made.count() == apart.count() == 2 * N + 3
        broken = made.withColumn("image", F.when(F.col("frame_index") % 9 == 1, F.substring("image", 1, 40)).when(F.col("frame_index") % 9 == 2, F.lit(None)).otherwise(F.col("image")))
        read, apart = im.read_gray_images(broken), im.canonical(im.read_frame_images(broken))
        assert read.schema == apart.schema and read.exceptAll(apart).count() == 0 and read.count() == 2 * N + 3
    spark.range(20).selectExpr("id AS vec_id", "transform(sequence(1, 64), x -> CAST(0.01 * x - 0.3 AS FLOAT)) AS embedding", "CAST(id % 3 AS INT) AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    query = queries()["s11_read_frame_images"](spark, str(tmp_path))
    plan = query._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and query.where("error is null").count() == 20
