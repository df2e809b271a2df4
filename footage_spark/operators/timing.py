"""Ticks: deltas, gaps, effective frame rate, metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.display import effective_fps, tick_decimal


#: Frames of a recording that meet in one task.
WINDOW_FRAMES = 1 << 18


def tick_delta(ticks: DataFrame, frames: int = WINDOW_FRAMES) -> DataFrame:
    """ticks(recording, frame_index, tick) with delta to the frame before; exact for unsigned ticks.

    Deltas are taken within runs of `frames` frame numbers, so a recording of any length is spread over
    tasks; each run's last tick (one row a run) then goes to the first frame of the next run that has any.
    """
    rows = ticks.withColumn("run", F.expr(f"frame_index div {frames}"))
    exact = tick_decimal(F.col("tick"))
    within = Window.partitionBy("recording", "run").orderBy("frame_index")
    delta = rows.withColumns({"before": F.lag(exact).over(within), "first": F.row_number().over(within) == 1})
    ends = rows.groupBy("recording", "run").agg(F.max_by(exact, "frame_index").alias("last"))
    above = ends.select("recording", "run", F.lag("last").over(Window.partitionBy("recording").orderBy("run")).alias("above"))
    out = delta.join(above, ["recording", "run"], "left")
    before = F.when(F.col("first"), F.col("above")).otherwise(F.col("before"))
    return out.select(*ticks.columns, (exact - before).cast("long").alias("delta"))


def timing_qa(ticks: DataFrame, framerates: DataFrame, factor: float = 1.5, frames: int = WINDOW_FRAMES) -> DataFrame:
    """Flags for each frame: not after the one before; later than `factor` nominal steps; frames missed."""
    step = F.lit(1e6) / F.col("framerate")
    out = tick_delta(ticks, frames).join(framerates.select("recording", "framerate"), "recording", "left")
    gap = F.coalesce(F.col("delta") > step * factor, F.lit(False))
    return out.select("recording", "frame_index", "tick", "delta", F.coalesce(F.col("delta") <= 0, F.lit(False)).alias("not_monotonic"), gap.alias("gap"), F.when(gap, F.greatest(F.floor(F.col("delta") / step + 0.5) - 1, F.lit(0))).otherwise(0).cast("long").alias("dropped"))


def timing_summary(qa: DataFrame) -> DataFrame:
    return qa.groupBy("recording").agg(F.count(F.lit(1)).alias("frames"), F.count_if("not_monotonic").alias("not_monotonic"), F.count_if("gap").alias("gaps"), F.sum("dropped").alias("dropped"), F.max("delta").alias("longest"))


def recording_timing(ticks: DataFrame) -> DataFrame:
    """recording, frames, first_tick, last_tick, effective_fps; one partial row a task and recording."""
    got = ticks.groupBy("recording").agg(F.count(F.lit(1)).alias("frames"), F.min_by("tick", "frame_index").alias("first_tick"), F.max_by("tick", "frame_index").alias("last_tick"))
    return got.withColumn("effective_fps", effective_fps(F.col("frames"), tick_decimal(F.col("first_tick")), tick_decimal(F.col("last_tick"))))


def recording_metadata(ticks: DataFrame, recordings: DataFrame, bit_depth: int = 8) -> DataFrame:
    """recording, metadata (JSON; what is unknown is left out)."""
    kept = recordings.select("recording", "width", "height", "mode", "mode_b", "mode_c", "mode_g", "camera_name", "framerate", "exposure_us", "frame_stride")
    out = recording_timing(ticks).join(kept, "recording")
    curve = F.struct(F.col("mode_b").alias("brightness"), F.col("mode_c").alias("contrast"), F.col("mode_g").alias("gamma"))
    body = F.struct(
        "width", "height", "frames", "frame_stride", "mode", curve.alias("transform"), F.lit(bit_depth).alias("bit_depth"), F.col("camera_name").alias("camera"), F.col("framerate").alias("fps_nominal"), "exposure_us",
        F.col("first_tick").alias("timestamp_first"), F.col("last_tick").alias("timestamp_last"), F.col("effective_fps").alias("effective_fps_from_timestamps"),
    )
    return out.select("recording", F.to_json(body).alias("metadata"))


def time_marker_check(ticks: DataFrame, recordings: DataFrame) -> DataFrame:
    """recording, first_tick, time_marker_reference, matches (null where the sidecar has none)."""
    first = ticks.groupBy("recording").agg(F.min_by("tick", "frame_index").alias("first_tick"))
    out = first.join(recordings.select("recording", "time_marker_reference"), "recording", "left")
    return out.withColumn("matches", F.col("first_tick") == F.col("time_marker_reference"))


def batch_summary(recordings: DataFrame, key: str = "recording") -> DataFrame:
    """level (batch, camera, recording), camera_dir, recording, recordings, ok, failed, frames, status.

    One row for each recording, for each camera folder and for the whole batch.  A recording's status is its own;
    that of a folder or batch is ok, or failed if any recording in it failed (others have been counted
    all the same).  Without recordings there are no rows.
    """
    ok = F.col("status") == "ok"
    counted = recordings.select("camera_dir", F.col(key).alias("recording"), "status", "frames_total").groupingSets([["camera_dir", "recording"], ["camera_dir"], []], "camera_dir", "recording")
    got = counted.agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("recordings"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.coalesce(F.sum(F.when(ok, F.col("frames_total"))), F.lit(0)).alias("frames"), F.min("status").alias("own"),
    )
    level = F.element_at(F.create_map(*map(F.lit, (0, "recording", 1, "camera", 3, "batch"))), F.col("g").cast("int"))
    status = F.when(F.col("g") == 0, F.col("own")).when(F.col("failed") > 0, "failed").otherwise("ok")
    return got.select(level.alias("level"), "camera_dir", "recording", "recordings", "ok", "failed", "frames", status.alias("status"))
