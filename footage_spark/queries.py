"""Queries over the given tables for every operator, and the SQL that checks them."""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .functions.display import display_level, effective_fps, frame_file_name, output_name, tick_hex
from .operators import images as im
from .operators import pixels as px
from .operators import timing as tm
from .operators import verify as vf
from .plans import extract as ex
from .sources import footage as ft
from .sources import recordings as rc
from .streaming import ingest as ing

B, C, G = fx.BRIGHTNESS, fx.CONTRAST, fx.GAMMA


def _lake(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """Recordings made from embeddings, written to a shared folder, and their catalogue."""
    root = px.shared_folder(spark)
    fx.write_lake(fx.frames(spark, sf_dir), root)
    return root, rc.recordings(spark, root)


def _short(df: DataFrame) -> DataFrame:
    return df.withColumn("recording", F.regexp_extract("recording", r"([^/]+)\.bin$", 1))


def _curved(spark, sf_dir):
    frames = fx.frames(spark, sf_dir)
    return px.with_curve(frames, fx.curves(frames))


# sources


def s1_discover_recordings(spark, sf_dir):
    root, _ = _lake(spark, sf_dir)
    return rc.discover_recordings(spark, root).select("stem", "out_name", "file_size")


def s2_parse_footage(spark, sf_dir):
    parsed = rc.parse_sidecars(fx.sidecar_rows(spark, sf_dir))
    return parsed.select("p_partkey", "xml_width", "xml_height", "num_images", "framerate", "brightness", "contrast", "gamma", "camera_name", "has_processing")


def _catalog(spark, sf_dir):
    parsed = rc.parse_sidecars(fx.sidecar_rows(spark, sf_dir)).withColumn("file_size", F.col("p_partkey") * 1000 + 10)
    return rc.with_status(rc.resolve_mode(rc.resolve_frame_count(rc.resolve_geometry(parsed))))


def s3_recordings(spark, sf_dir):
    root, catalog = _lake(spark, sf_dir)
    return catalog.select("stem", "width", "height", "num_images", "frame_stride", "capacity_frames", "frames_total", "trailing_bytes", "verified_operating_point", "status")


def s4_resolve_geometry(spark, sf_dir):
    return _catalog(spark, sf_dir).select("p_partkey", "width", "height", "frame_stride", "capacity_frames", "trailing_bytes")


def s5_resolve_frame_count(spark, sf_dir):
    return _catalog(spark, sf_dir).select("p_partkey", "frames_total", "status")


def s6_footage(spark, sf_dir):
    _, catalog = _lake(spark, sf_dir)
    return _short(ft.read_frames(spark, catalog)).select("recording", "frame_index", "tick", "width", "height", F.md5("pixels").alias("md5"))


def s7_frame_range(spark, sf_dir):
    _, catalog = _lake(spark, sf_dir)
    return _short(ft.read_frames(spark, catalog, 10, 15)).select("recording", "frame_index", F.md5("pixels").alias("md5"))


def s7_source_options(spark, sf_dir):
    """SQL over the source: frames 10 to 24 of the recordings with one-digit names below 5, and a filter on the frame number."""
    root, _ = _lake(spark, sf_dir)
    ft.register_footage(spark)
    name = f"footage_{os.path.basename(root).replace('-', '_')}"
    spark.sql(f"CREATE TEMPORARY VIEW {name} USING footage OPTIONS (root '{root}', start '10', count '15', recordings 'cam_[0-4],cam_9/cam_9')")
    return _short(spark.sql(f"SELECT recording, frame_index, tick, width, height, md5(pixels) AS md5 FROM {name} WHERE frame_index < 20"))


def s8_read_timestamps(spark, sf_dir):
    _, catalog = _lake(spark, sf_dir)
    return _short(ft.read_timestamps(spark, catalog))


def s9_frame_lookup(spark, sf_dir):
    """The middle frame of every recording, display-mapped; no other frame is read."""
    _, catalog = _lake(spark, sf_dir)
    asked = catalog.select("recording", F.expr("frames_total div 2").alias("frame_index"))
    frames = ft.read_frames_at(spark, catalog, asked, carry=px.CURVE)
    return _short(px.apply_display_transform(frames)).select("recording", "frame_index", F.md5("mapped").alias("md5"))


def s10_list_frame_images(spark, sf_dir):
    names = fx.table(spark, sf_dir, "orders").select(frame_file_name("shot_", F.col("o_orderkey"), F.when(F.col("o_orderkey") % 5 == 0, F.lit("a.Png")).otherwise(F.lit(".Png"))).alias("file_name"))
    return im.named_frames(names, "shot_", ".Png")


def s11_read_frame_images(spark, sf_dir):
    read = im.read_gray_images(im.encode_mapped(_curved(spark, sf_dir), layout="rgba16"))
    return read.select("recording", "frame_index", "width", "height", "bit_depth", "color_type", "error", F.md5("gray").alias("md5"))


# transforms


def t1_build_lut(spark, sf_dir):
    """The curve of every size of part as brightness, with gamma 2.2 for even sizes."""
    points = fx.table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("b")).distinct()
    grid = points.withColumn("raw", F.explode(F.sequence(F.lit(0), F.lit(255))))
    g = F.when(F.col("b") % 2 == 0, 2.2).otherwise(1.0)
    return grid.select(F.col("b").cast("int").alias("b"), "raw", display_level(F.col("raw"), F.col("b"), F.lit(18.0), g).alias("level"))


def t2_apply_display_transform(spark, sf_dir):
    mapped = px.apply_display_transform(_curved(spark, sf_dir))
    return mapped.select("recording", "frame_index", F.md5("mapped").alias("md5"))


def t3_resolve_mode(spark, sf_dir):
    return _catalog(spark, sf_dir).select("p_partkey", "mode", "mode_b", "mode_c", "mode_g", "status")


def t4_expand_layout(spark, sf_dir):
    mapped = px.apply_display_transform(_curved(spark, sf_dir))
    wide = px.expand_layout(mapped, "rgba16")
    return wide.select("recording", "frame_index", F.octet_length("samples").alias("n_bytes"), F.md5("samples").alias("md5"))


def t5_explode_pixels(spark, sf_dir):
    pixels = px.explode_pixels(fx.frames(spark, sf_dir))
    return px.map_pixels(px.with_curve(pixels, fx.curves(pixels))).select("recording", "frame_index", "x", "y", "raw", "mapped")


def t6_frame_names(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", frame_file_name("shot_", F.col("o_orderkey"), ".Png").alias("file_name"), output_name(F.concat(F.lit("cam_"), (F.col("o_orderkey") / 10).cast("decimal(20,1)").cast("string"))).alias("out_name"))


def t6_name_register(spark, sf_dir):
    """part as recordings that arrive in two runs, even keys first: names given once stay."""
    register = f"{px.shared_folder(spark)}/names"
    stem = F.replace("p_brand", F.lit("#"), F.when(F.col("p_partkey") % 3 == 0, F.lit(".")).otherwise(F.lit("_")))
    found = fx.table(spark, sf_dir, "part").select("p_partkey", F.format_string("/lake/%07d/x.bin", "p_partkey").alias("recording"), stem.alias("stem"))
    rc.with_names(found.where("p_partkey % 2 = 0"), register)
    return rc.with_names(found, register).select("p_partkey", "out_name")


def t7_playback_timeline(spark, sf_dir):
    """Frames 5 to 24 of every recording in order; the order is that of the chunks."""
    _, catalog = _lake(spark, sf_dir)
    frames = ft.read_frames(spark, catalog, 5, 20, carry=px.CURVE, in_order=True)
    return _short(px.playback_timeline(frames, 25.0, 5, in_order=True)).select("recording", "frame_index", "pts", F.md5("mapped").alias("md5"))


# joins


def j1_sidecar_pairing(spark, sf_dir):
    """part as files, those with p_partkey % 3 > 0 have a sidecar: which are paired."""
    bins = fx.table(spark, sf_dir, "part").select(F.concat(F.lit("cam_"), "p_partkey").alias("stem"), "p_partkey")
    cars = rc.parse_sidecars(fx.sidecar_rows(spark, sf_dir).where("p_partkey % 3 > 0")).select(F.concat(F.lit("cam_"), "p_partkey").alias("car"), "xml_width", "has_processing")
    return rc.pair_sidecars(bins, cars, "stem", "car").select("p_partkey", F.col("xml_width").isNotNull().alias("paired"), "xml_width")


def _fx4(spark, sf_dir):
    ref = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = ref.where("doc_id % 5 <> 0").withColumn("text", F.when(F.col("doc_id") % 97 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    return ref, out


def v1_verify_frames(spark, sf_dir):
    ref, out = _fx4(spark, sf_dir)
    return vf.compare_content(ref, out, "doc_id", "text").select(F.col("key").alias("doc_id"), "outcome")


def v1_verify_images(spark, sf_dir):
    """Images of every layout against gray ones; of each fifth frame one byte of the file is flipped, of each seventh a pixel differs."""
    curved = _curved(spark, sf_dir)
    mapped, name = px.apply_display_transform(curved), F.concat_ws("/", "recording", "file_name")
    ref = im.encode_mapped(curved).withColumn("file_name", name)
    flipped = F.concat(F.expr("substring(image, 1, 119)"), F.expr("unhex(lpad(hex(255 - conv(hex(substring(image, 120, 1)), 16, 10)), 2, '0'))"), F.expr("substring(image, 121)"))
    other = mapped.withColumn("mapped", F.when(F.col("frame_index") % 7 == 3, F.concat(F.expr("unhex(lpad(hex((conv(hex(substring(mapped, 1, 1)), 16, 10) + 1) % 256), 2, '0'))"), F.expr("substring(mapped, 2)"))).otherwise(F.col("mapped")))
    out = None
    for layout in px.LAYOUTS:
        made = im.encode_frames(other, layout=layout).withColumn("file_name", name)
        made = made.withColumn("image", F.when(F.col("frame_index") % 5 == 1, flipped).otherwise(F.col("image")))
        detail = vf.verify_images(ref, made)[0].select(F.lit(layout).alias("layout"), F.col("key").alias("file_name"), F.col("order_value").alias("frame_index"), "outcome")
        out = detail if out is None else out.unionByName(detail)
    return out


def j2_verify_pairing(spark, sf_dir):
    """Frames against their files, paired by name: images of every other frame in another layout."""
    curved = _curved(spark, sf_dir)
    ref = im.encode_mapped(curved).withColumn("file_name", F.concat_ws("/", "recording", "file_name"))
    out = im.encode_mapped(curved.where("frame_index % 2 = 0"), layout="rgba8").withColumn("file_name", F.concat_ws("/", "recording", "file_name"))
    detail, _ = vf.verify_images(ref, out, subset=True)
    return detail.select(F.col("key").alias("file_name"), F.col("order_value").alias("frame_index"), "outcome")


def j3_params_to_frames(spark, sf_dir):
    """Each frame's own curve: brightness is 10 times the recording's number."""
    frames = fx.frames(spark, sf_dir)
    own = fx.curves(frames).withColumn("mode_b", 10.0 * F.regexp_extract("recording", r"(\d+)$", 1).cast("double"))
    return px.apply_display_transform(px.with_curve(frames, own)).select("recording", "frame_index", "mode_b", F.md5("mapped").alias("md5"))


def j3_curve_table(spark, sf_dir):
    """The same curves where there are more than are sent to every task: looked up in a table, pixels stay where they are."""
    frames = fx.frames(spark, sf_dir)
    own = fx.curves(frames).withColumn("mode_b", 10.0 * F.regexp_extract("recording", r"(\d+)$", 1).cast("double"))
    return px.apply_display_transform(px.with_curve(frames, own, most=0)).select("recording", "frame_index", "mode_b", F.md5("mapped").alias("md5"))


# aggregates


def a1_recording_metadata(spark, sf_dir):
    return tm.recording_timing(fx.ticks(spark, sf_dir))


def a2_effective_fps(spark, sf_dir):
    got = fx.ticks(spark, sf_dir).groupBy("recording").agg(F.count(F.lit(1)).alias("n"), F.min_by("tick", "frame_index").alias("a"), F.max_by("tick", "frame_index").alias("b"))
    return got.select("recording", effective_fps(F.col("n"), F.col("a"), F.col("b")).alias("effective_fps"))


def a3_extract_report(spark, sf_dir):
    """BMP images written, and reported by the sizes beside them."""
    root, catalog = _lake(spark, sf_dir)
    catalog = catalog.where("status = 'ok'")
    ex.write_images(ex.extract_images(spark, catalog, fmt="bmp"), catalog, f"{root}-images")
    return _short(ex.extract_report(spark.read.parquet(f"{root}-images").drop("image"), catalog))


def a4_pixel_histogram(spark, sf_dir):
    return px.pixel_histogram(fx.frames(spark, sf_dir))


def a4_grouped_histograms(spark, sf_dir):
    """By frame, recording and mode: recordings of even number are raw."""
    frames = fx.frames(spark, sf_dir)
    mode = F.when(F.regexp_extract("recording", r"(\d+)$", 1).cast("int") % 2 == 0, "raw").otherwise("reference")
    return px.histogram_rows(px.grouped_histograms(frames.withColumn("mode", mode)))


def a5_saturation_report(spark, sf_dir):
    frames = fx.frames(spark, sf_dir)
    return px.saturation_report(px.pixel_histogram(frames), fx.curves(frames))


def a6_verify_report(spark, sf_dir):
    ref, out = _fx4(spark, sf_dir)
    return vf.verify_report(vf.compare_content(ref, out, "doc_id", "text"))


def _summary(spark, sf_dir):
    return tm.batch_summary(_catalog(spark, sf_dir).withColumn("camera_dir", F.col("camera_name")), "p_partkey")


def a7_batch_summary(spark, sf_dir):
    return _summary(spark, sf_dir).where("level <> 'recording'").select("camera_dir", "recordings", "ok", "failed", "frames")


def a7_batch_status(spark, sf_dir):
    """Every level with its status."""
    return _summary(spark, sf_dir).withColumnRenamed("recording", "p_partkey")


# windows, order, sets


def w1_tick_delta(spark, sf_dir):
    ticks = fx.ticks(spark, sf_dir)
    rates = ticks.select("recording").distinct().withColumn("framerate", F.lit(0.001))
    return tm.timing_qa(ticks, rates)


def w3_time_marker_check(spark, sf_dir):
    ticks = fx.ticks(spark, sf_dir)
    marks = ticks.where("frame_index = 0").select("recording", (F.col("tick") + F.when(F.col("recording") % 3 == 0, 1).otherwise(0)).alias("time_marker_reference"))
    return tm.time_marker_check(ticks, marks)


def o1_first_mismatch(spark, sf_dir):
    ref, out = _fx4(spark, sf_dir)
    return vf.first_mismatches(vf.compare_content(ref, out, "doc_id", "text"), 5).select(F.col("key").alias("doc_id"), "outcome")


def v2_name_set_compare(spark, sf_dir):
    ref, out = _fx4(spark, sf_dir)
    return vf.name_set_compare(ref, out, "doc_id")


def v3_fingerprint_set_equal(spark, sf_dir):
    ref, out = _fx4(spark, sf_dir)
    return vf.fingerprint_set_equal(ref, out, "text")


# sinks


def x1_write_timestamps(spark, sf_dir):
    """Written as CSV and read again."""
    path = f"{px.shared_folder(spark)}/stamps"
    stamps = fx.ticks(spark, sf_dir).select(F.col("recording").cast("string").alias("recording"), "frame_index", F.col("tick").alias("timestamp_raw"), tick_hex(F.col("tick")).alias("timestamp_hex"))
    ex.write_timestamps(stamps, stamps.select("recording", F.concat(F.lit("cam_"), "recording").alias("out_name")).distinct(), path)
    return ex.read_timestamps_csv(spark, path).select("name", "frame_index", "timestamp_raw", "timestamp_hex")


def x2_encode_frames(spark, sf_dir):
    """PNG in all four layouts, decoded again."""
    curved = _curved(spark, sf_dir)
    parts = [im.read_gray_images(im.encode_mapped(curved, layout=x)).select("recording", "frame_index", F.lit(x).alias("layout"), F.md5("gray").alias("md5"), "error") for x in px.LAYOUTS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def x3_bmp_tiff(spark, sf_dir):
    """Sizes of the files, and all pixels of the 8 x 8 frames found in them by their offsets (BMP has the last row first)."""
    curved = _curved(spark, sf_dir)
    rows = F.concat(*[F.expr(f"substring(image, {1079 + 8 * k}, 8)") for k in range(7, -1, -1)])
    bmp = im.encode_mapped(curved, "bmp").select("recording", "frame_index", "format", F.octet_length("image").alias("n_bytes"), F.md5(rows).alias("md5"))
    tiff = im.encode_mapped(curved, "tiff").select("recording", "frame_index", "format", F.octet_length("image").alias("n_bytes"), F.md5(F.expr("substring(image, octet_length(image) - 63, 64)")).alias("md5"))
    return bmp.unionByName(tiff)


def x4_write_frame_files(spark, sf_dir):
    root, catalog = _lake(spark, sf_dir)
    images = ex.extract_images(spark, catalog, fmt="tiff")
    written = ex.write_frame_files(images, catalog, f"{root}/out")
    return _short(written).select("recording", "frame_index", "bytes")


def x5_write_metadata(spark, sf_dir):
    root, catalog = _lake(spark, sf_dir)
    catalog = catalog.withColumn("recording", F.regexp_replace("recording", "^file:", ""))
    ex.write_metadata(ft.read_timestamps(spark, catalog).withColumnRenamed("timestamp_raw", "tick"), catalog, f"{root}/meta")
    back = spark.read.text(f"{root}/meta")
    get = lambda p: F.get_json_object("value", f"$.{p}")
    return back.select("out_name", get("width").cast("int").alias("width"), get("frames").cast("long").alias("frames"), get("timestamp_last").cast("long").alias("last_tick"), get("effective_fps_from_timestamps").cast("double").alias("effective_fps"), get("camera").alias("camera"))


def x6_extract(spark, sf_dir):
    """One recording: cam_3."""
    root, _ = _lake(spark, sf_dir)
    return _short(ex.batch_extract(spark, root, f"{root}-out", recording=f"{root}/cam_3/cam_3.bin")).select("recording", "frames_written", "frames_total", "input_bytes")


def x7_batch_extract(spark, sf_dir):
    root, _ = _lake(spark, sf_dir)
    return _short(ex.batch_extract(spark, root, f"{root}-out", layout="rgba8", level=1)).select("recording", "frames_written", "frames_total", "input_bytes")


def f1_frame_fingerprint(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    return vf.frame_fingerprint(docs, "text").select("doc_id", "md5", "sha256")


def st1_ingest_new_recordings(spark, sf_dir):
    """Ingested in two runs: the second finds nothing new."""
    root, _ = _lake(spark, sf_dir)
    for _ in range(2):
        ing.ingest_new_recordings(spark, root, f"{root}-catalog", f"{root}-state").awaitTermination()
    got = spark.read.parquet(f"{root}-catalog")
    return got.groupBy("stem").agg(F.count(F.lit(1)).alias("times"), F.max("frames_total").alias("frames_total"), F.max("status").alias("status"))


def st1_late_recordings(spark, sf_dir):
    """Three runs: cam_3 is cut short in the first and whole in the second, cam_5 stays short and is given up in the third."""
    root, _ = _lake(spark, sf_dir)
    held = {}
    for k in (3, 5):
        with open(f"{root}/cam_{k}/cam_{k}.bin", "r+b") as file:
            held[k] = file.read()
            file.truncate(len(held[k]) - 10)

    def run(seconds):
        ing.ingest_new_recordings(spark, root, f"{root}-catalog", f"{root}-state", wait_seconds=seconds).awaitTermination()

    run(5)
    with open(f"{root}/cam_3/cam_3.bin", "wb") as file:
        file.write(held[3])
    time.sleep(0.2)
    run(5)
    time.sleep(5)
    run(5)
    return spark.read.parquet(f"{root}-catalog").groupBy("stem", "status").agg(F.count(F.lit(1)).alias("times"))


def flagship(spark, sf_dir):
    """Recordings written and read by the source, mapped, and their clipping reported."""
    _, catalog = _lake(spark, sf_dir)
    return px.saturation_report(_short(px.pixel_histogram(ft.read_frames(spark, catalog))), _short(catalog))


NAMES = """s1_discover_recordings s2_parse_footage s3_recordings s4_resolve_geometry s5_resolve_frame_count s6_footage s7_frame_range s8_read_timestamps
s9_frame_lookup s10_list_frame_images s11_read_frame_images t1_build_lut t2_apply_display_transform t3_resolve_mode t4_expand_layout t5_explode_pixels
t6_frame_names t7_playback_timeline j1_sidecar_pairing j2_verify_pairing j3_params_to_frames a1_recording_metadata a2_effective_fps a3_extract_report
a4_pixel_histogram a5_saturation_report a6_verify_report a7_batch_summary w1_tick_delta w3_time_marker_check o1_first_mismatch v1_verify_frames
v2_name_set_compare v3_fingerprint_set_equal x1_write_timestamps x2_encode_frames x3_bmp_tiff x4_write_frame_files x5_write_metadata x6_extract
x7_batch_extract f1_frame_fingerprint st1_ingest_new_recordings flagship
st1_late_recordings s7_source_options t6_name_register j3_curve_table v1_verify_images a4_grouped_histograms a7_batch_status""".split()


def queries():
    return {name: globals()[name] for name in NAMES}


def oracle_sql() -> dict[str, str]:
    from .oracle import SQL

    return dict(SQL)
