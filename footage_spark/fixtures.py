"""Recordings made from the given tables: as views, and as files."""

from __future__ import annotations

import os
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: First tick, step of ticks and curve of the made recordings.
FIRST_TICK, STEP, BRIGHTNESS, CONTRAST, GAMMA, FPS = 10_000_000, 2000, 49.0, 18.0, 1.0, 500.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as 8 x 8 frames, a recording for each label: recording, frame_index, tick, width, height, raws."""
    order = Window.partitionBy("label").orderBy("vec_id")
    raw = F.transform("embedding", lambda e: F.least(F.greatest(F.floor((e.cast("double") + 0.5) * 256.0), F.lit(0)), F.lit(255)).cast("int"))
    rows = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("cam_"), "label").alias("recording"), (F.row_number().over(order) - 1).cast("long").alias("frame_index"), raw.alias("raws"))
    return rows.select("recording", "frame_index", (FIRST_TICK + STEP * F.col("frame_index")).alias("tick"), F.lit(8).alias("width"), F.lit(8).alias("height"), "raws")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with binary pixels, all in expressions."""
    hexes = F.array_join(F.transform("raws", lambda r: F.lpad(F.hex(r), 2, "0")), "")
    return frame_rows(spark, sf_dir).withColumn("pixels", F.unhex(hexes)).drop("raws")


def pixel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = frame_rows(spark, sf_dir).select("recording", "frame_index", F.posexplode("raws").alias("pos", "raw"))
    return one.select("recording", "frame_index", (F.col("pos") % 8).alias("x"), F.expr("cast(pos div 8 as int)").alias("y"), "raw")


def curves(frames_: DataFrame) -> DataFrame:
    """One row a recording with the made curve."""
    return frames_.select("recording").distinct().select("recording", F.lit(BRIGHTNESS).alias("mode_b"), F.lit(CONTRAST).alias("mode_c"), F.lit(GAMMA).alias("mode_g"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as camera clocks, a recording for each user: recording, frame_index, tick."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    at = F.expr("unix_micros(cast(ts as timestamp))")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("recording"), (F.row_number().over(order) - 1).cast("long").alias("frame_index"), at.alias("tick"))


def sidecar_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as sidecars: p_partkey, p_name, xml."""
    field = lambda n, c: F.concat(F.lit(f"<{n}>"), c.cast("string"), F.lit(f"</{n}>"))
    size = F.col("p_size")
    n = F.when(F.col("p_partkey") % 7 != 0, field("NumberOfImages", F.col("p_partkey"))).otherwise("")
    settings = F.when(F.col("p_partkey") % 11 != 0, F.concat(F.lit("<SettingsProcessing>"), field("Brightness", size), field("Contrast", F.lit(18)), F.lit("<Gamma>1</Gamma></SettingsProcessing>"))).otherwise("")
    xml = F.concat(F.lit("<F><Footage>"), field("ResolutionX", size), field("ResolutionY", size + 1), n, F.lit("<Framerate>500</Framerate></Footage>"), settings, F.lit("<Camera>"), field("Name", F.col("p_brand")), F.lit("</Camera></F>"))
    return table(spark, sf_dir, "part").select("p_partkey", xml.alias("xml"))


def sidecar_text(width, height, count, first_tick=FIRST_TICK, brightness=BRIGHTNESS, contrast=CONTRAST, gamma=GAMMA, name="cam", fps=FPS, settings=True) -> str:
    """A sidecar as text; None leaves a field out."""
    made = {"ResolutionX": width, "ResolutionY": height, "NumberOfImages": count, "BitsPerPixel": 1, "Framerate": fps, "Exposure": 1998, "TimeMarkerReference": first_tick}
    body = "".join(f"<{k}>{v}</{k}>" for k, v in made.items() if v is not None)
    curve = f"<SettingsProcessing><Brightness>{brightness}</Brightness><Contrast>{contrast}</Contrast><Gamma>{gamma}</Gamma></SettingsProcessing>" if settings else ""
    return f"<Recording><Footage>{body}</Footage>{curve}<Camera><Name>{name}</Name></Camera></Recording>"


def write_recording(path: str, pixels, ticks_, sidecar: str | None) -> None:
    """path.bin (and path.footage) of frames, each (height, width)."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(f"{path}.bin", "wb") as out:
        for tick, frame in zip(ticks_, pixels, strict=True):
            out.write(struct.pack("<Q", tick & (2**64 - 1)) + frame.astype(np.uint8).tobytes())
    if sidecar is not None:
        with open(f"{path}.footage", "w") as out:
            out.write(sidecar)


def write_lake(frames_: DataFrame, root: str) -> None:
    """Write frames(recording, frame_index, tick, width, height, pixels) as recordings under a shared folder.

    Each recording's file is written by one task that streams its frames in order.
    """

    def run(batches):
        now, out, count, size, first = None, None, 0, (0, 0), 0

        def close():
            if out is not None:
                out.close()
                with open(os.path.join(root, now, f"{now}.footage"), "w") as car:
                    car.write(sidecar_text(*size, count, first_tick=first, name=now))

        done = []
        for batch in batches:
            for r in batch.to_pylist():
                if r["recording"] != now:
                    close()
                    now, count, size, first = r["recording"], 0, (r["width"], r["height"]), r["tick"]
                    done.append(now)
                    os.makedirs(os.path.join(root, now), exist_ok=True)
                    out = open(os.path.join(root, now, f"{now}.bin"), "wb")  # noqa: SIM115
                out.write(struct.pack("<q", r["tick"]) + r["pixels"])
                count += 1
        close()
        yield pa.record_batch([pa.array(done, pa.string())], ["recording"])

    frames_.repartition("recording").sortWithinPartitions("recording", "frame_index").mapInArrow(run, "recording string").count()
