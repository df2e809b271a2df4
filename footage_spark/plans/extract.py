"""Whole jobs: extraction of one or of all recordings, and the sinks."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.display import tick_hex
from ..operators.images import encoded_batches, name_images
from ..operators.pixels import CURVE, column_batches, mapped_pixels
from ..operators.timing import recording_metadata
from ..sources.footage import CHUNK_BYTES, local_path, plan_scan, scan_batches, small_batches
from ..sources.recordings import plain_path, recordings
from .frame_files import write_files
from .stamp_files import read_stamp_files, write_stamp_files


def _named(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows with the out_name that they brought from the source, else by a join with names."""
    return rows if "out_name" in rows.columns else rows.join(names.select("recording", "out_name"), "recording")


def write_timestamps(timestamps: DataFrame, names: DataFrame, path: str) -> None:
    """CSV (frame_index, timestamp_raw, timestamp_hex) in a folder for each recording, named <out_name>_timestamps.

    On a mounted folder tasks write the files themselves; elsewhere Spark's writer does.
    """
    named = _named(timestamps, names).withColumn("name", F.concat("out_name", F.lit("_timestamps")))
    named = named.select("name", "frame_index", "timestamp_raw", "timestamp_hex")
    if "://" not in local_path(path):
        return write_stamp_files(named, local_path(path))
    named.sortWithinPartitions("name", "frame_index").write.mode("overwrite").partitionBy("name").csv(path, header=True)


def read_timestamps_csv(spark: SparkSession, path: str) -> DataFrame:
    """frame_index, timestamp_raw, timestamp_hex, name of what write_timestamps wrote."""
    if "://" not in local_path(path):
        return read_stamp_files(spark, local_path(path))
    return spark.read.schema("frame_index long, timestamp_raw long, timestamp_hex string, name string").csv(path, header=True)


def write_metadata(ticks: DataFrame, catalog: DataFrame, path: str) -> None:
    """One JSON line a recording, in a folder for each."""
    recording_metadata(ticks, catalog).join(catalog.select("recording", "out_name"), "recording").select("out_name", F.col("metadata").alias("value")).write.mode("overwrite").partitionBy("out_name").text(path)


def write_images(images: DataFrame, names: DataFrame, path: str) -> None:
    """The lake form: Parquet by recording, with the size of each image beside it, so that nothing reads images to count them."""
    _sized(_named(images, names)).write.mode("overwrite").partitionBy("out_name").parquet(path)


def _sized(images: DataFrame) -> DataFrame:
    return images.withColumn("bytes", F.octet_length("image").cast("long"))


def write_frame_files(images: DataFrame, names: DataFrame, out_root: str) -> DataFrame:
    """One file a frame at out_root/out_name/file_name, on a folder that all executors share; returns the manifest.

    All or none: files get their names after every task has succeeded (see frame_files).
    """
    named = _named(images, names).where("image is not null")
    return write_files(named if "tick" in named.columns else named.withColumn("tick", F.lit(None).cast("long")), out_root)


def extract_images(spark: SparkSession, catalog: DataFrame, start: int = 0, count: int | None = None, fmt: str = "png", layout: str = "gray8", level: int = 6, prefix: str = "cam_", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Scan, curve, layout and encoding in one pass of a worker: a task gets chunk rows and gives images.

    Curve and out_name stand in the chunk's row, so nothing is joined, and raw pixels never leave the worker.
    Ticks come along, so that timestamps need no scan of their own.
    """
    carry, keep = [*CURVE, "out_name"], ["recording", "frame_index", "tick", "out_name"]
    scan = scan_batches(["recording", "frame_index", "tick", "width", "height", "pixels"], carry)
    mapped = column_batches([*keep, "width", "height"], "mapped", mapped_pixels)
    encoded = encoded_batches(fmt, layout, level, "mapped", keep)
    small_batches(spark)
    made = plan_scan(catalog, start, count, carry, chunk_bytes=chunk_bytes).mapInArrow(lambda batches: encoded(mapped(scan(batches))), "recording string, frame_index long, tick long, out_name string, image binary")
    return name_images(made, fmt, prefix)


def extract_report(images: DataFrame, catalog: DataFrame) -> DataFrame:
    """recording, frames_written, frames_total, input_bytes, output_bytes, bytes_a_frame.

    images: what was written, by its column bytes (or, where there is none, image); a recording without frames has a row of zeros.
    """
    sized = images if "bytes" in images.columns else _sized(images)
    got = sized.groupBy("recording").agg(F.count(F.lit(1)).alias("frames_written"), F.sum("bytes").alias("output_bytes"))
    out = catalog.select("recording", "frames_total", "frame_stride").join(got, "recording", "left").na.fill(0, ["frames_written", "output_bytes"])
    each = F.when(F.col("frames_written") > 0, F.round(F.col("output_bytes") / F.col("frames_written"), 3))
    return out.select("recording", "frames_written", "frames_total", (F.col("frames_written") * F.col("frame_stride")).alias("input_bytes"), "output_bytes", each.alias("bytes_a_frame"))


def with_speed(report: DataFrame, seconds: float) -> DataFrame:
    """The report with frames and input MiB a second of the whole run."""
    s = F.lit(max(seconds, 1e-9))
    return report.withColumn("frames_a_second", F.col("frames_written") / s).withColumn("mib_a_second", F.col("input_bytes") / 1048576 / s)


def batch_extract(spark: SparkSession, root: str, out: str, start: int = 0, count: int | None = None, fmt: str = "png", layout: str = "gray8", level: int = 6, files: bool = False, recording: str | None = None, **options) -> DataFrame:
    """All recordings under root (or one): images, timestamps and metadata under out; returns the report with its speed.

    Recordings are read once: timestamps, metadata and the report come from the narrow columns of what was
    written (the manifest, for files).  Output names are kept in out/names, so a later run into the same folder uses them
    again.  Recordings that cannot be read go to out/failed with their status; the others go on.
    """
    began = time.time()
    catalog = recordings(spark, root, **({"register": f"{out}/names"} | options))
    if recording is not None:
        catalog = catalog.where(plain_path("recording") == local_path(recording))
    catalog.write.mode("overwrite").parquet(f"{out}/catalog")  # one listing for all that follows
    catalog = spark.read.parquet(f"{out}/catalog")
    catalog.where("status <> 'ok'").write.mode("overwrite").parquet(f"{out}/failed")
    good = catalog.where("status = 'ok'")
    images = extract_images(spark, good, start, count, fmt, layout, level)
    if files:
        done = write_frame_files(images, good, f"{out}/frames")
    else:
        write_images(images, good, f"{out}/images")
        done = spark.read.parquet(f"{out}/images")
    done = done.select("recording", "frame_index", "tick", "out_name", "bytes")
    stamps = done.select("recording", "out_name", "frame_index", F.col("tick").alias("timestamp_raw"), tick_hex(F.col("tick")).alias("timestamp_hex"))
    write_timestamps(stamps, good, f"{out}/timestamps")
    write_metadata(done, good, f"{out}/metadata")
    extract_report(done, good).write.mode("overwrite").parquet(f"{out}/report")
    return with_speed(spark.read.parquet(f"{out}/report"), time.time() - began)
