"""Per-frame work on binary pixels (Arrow batches), and the same as rows of pixels for SQL."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.display import display_level, lut, unclamped

LAYOUTS = {"gray8": 1, "gray16": 2, "rgba8": 4, "rgba16": 8}
#: Bytes of an Arrow batch to or from a worker, about; one longer row is a batch of its own.
BATCH_BYTES = 2 << 20

#: What a frame needs of its recording's row to be mapped.
CURVE = ("mode_b", "mode_c", "mode_g")
#: Most recordings whose curves are sent to every task: some hundred bytes each.  Beyond it tasks look theirs up.
MOST_CURVES = 200_000
#: Recordings of one file of the table of curves, about.
CURVES_A_FILE = 50_000


def with_curve(frames: DataFrame, recordings: DataFrame, folder: str | None = None, most: int = MOST_CURVES) -> DataFrame:
    """Frames with mode_b, mode_c, mode_g of their own recording, for frames that did not bring them; pixels stay where they are.

    read_frames(carry=CURVE) needs nothing of this.  Here up to `most` recordings are counted and sent
    to every task.  With more, curves are written to a table in folder (or the shared folder), by hash of the recording,
    and each task reads the few files that its own recordings are in.  Frames of unknown recordings go.
    """
    curves = recordings.select("recording", *CURVE)
    n = curves.count()
    if n <= most:
        return frames.join(F.broadcast(curves), "recording")
    return _looked_up(frames, curves, folder or shared_folder(frames.sparkSession), max(1, n // CURVES_A_FILE))


def shared_folder(spark) -> str:
    """A new folder under spark.checkpoint.dir; in local mode, where none is named, a temporary one (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        return tempfile.mkdtemp(prefix="spark-lake-")
    path = f"{re.sub('^file:(//)?', '', base)}/lake-{uuid.uuid4().hex}"
    if "://" in path:
        raise ValueError("recordings are opened by path: the shared folder must be mounted")
    os.makedirs(path)
    return path


def _bucket(recording: str, buckets: int) -> int:
    return zlib.crc32(recording.encode()) % buckets


def _looked_up(frames: DataFrame, curves: DataFrame, folder: str, buckets: int) -> DataFrame:
    """frames with CURVE from a table of `buckets` folders that tasks read when they meet a recording."""
    path = f"{folder}/curves"
    bucket = (F.crc32(F.col("recording").cast("binary")) % buckets).cast("int")
    curves.select("recording", *(F.col(c).cast("double").alias(c) for c in CURVE), bucket.alias("bucket")).repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)

    def run(batches):
        known: dict[int, dict[str, tuple]] = {}
        for batch in batches:
            rows = []
            for name in batch.column("recording").to_pylist():
                k = _bucket(name, buckets)
                if k not in known:
                    if len(known) >= 8:  # few files at a time, whatever the order of recordings
                        known.pop(next(iter(known)))
                    here = f"{path}/bucket={k}"
                    table = pq.read_table(here, columns=["recording", *CURVE], partitioning=None) if os.path.isdir(here) else None
                    known[k] = {} if table is None else dict(zip(table.column("recording").to_pylist(), zip(*(table.column(c).to_pylist() for c in CURVE), strict=True), strict=True))
                rows.append(known[k].get(name))
            kept = np.array([r is not None for r in rows], bool)
            mine = [r for r in rows if r is not None]
            batch = batch.filter(pa.array(kept))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[i] for r in mine], pa.float64()) for i in range(len(CURVE)))], names=[*batch.schema.names, *CURVE])

    return frames.mapInArrow(run, T.StructType([*frames.schema, *(T.StructField(c, T.DoubleType()) for c in CURVE)]))


def small_batches(spark: SparkSession) -> None:
    """Rows go to and from workers in batches of BATCH_BYTES at most: the session's setting is lowered where it is higher."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def pieces(values: Iterable, size=lambda value: len(value or b"")) -> Iterator[tuple[int, list]]:
    """(number of the first, values) of runs that end as soon as they have BATCH_BYTES: small rows may make large values."""
    first, held, n = 0, [], 0
    for value in values:
        held.append(value)
        n += size(value)
        if n >= BATCH_BYTES:
            yield first, held
            first, held, n = first + len(held), [], 0
    if held:
        yield first, held


def column_batches(keep: list[str], name: str, make):
    """Batches -> batches of the columns `keep` and a binary one whose values are made, one by one, from each batch."""

    def run(batches):
        for batch in batches:
            for first, made in pieces(make(batch)):
                part = batch.slice(first, len(made))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(made, pa.binary())], names=[*keep, name])

    return run


def _with_column(df: DataFrame, name: str, make) -> DataFrame:
    """df with a binary column made from each Arrow batch; a column of that name is replaced."""
    small_batches(df.sparkSession)
    keep = [c for c in df.columns if c != name]
    schema = T.StructType([*df.select(*keep).schema, T.StructField(name, T.BinaryType())])
    return df.mapInArrow(column_batches(keep, name, make), schema)


def mapped_pixels(batch) -> Iterator[bytes | None]:
    """Pixels of a batch through their frames' curves."""
    tables: dict[tuple, bytes] = {}
    for raw, b, c, g in zip(*(batch.column(x).to_pylist() for x in ("pixels", *CURVE)), strict=True):
        if (b, c, g) not in tables and None not in (b, c, g):
            tables[b, c, g] = lut(b, c, g)
        yield None if raw is None or None in (b, c, g) else raw.translate(tables[b, c, g])


def apply_display_transform(frames: DataFrame) -> DataFrame:
    """`mapped`: pixels through the frame's curve (mode_b, mode_c, mode_g); null pixels stay null."""
    return _with_column(frames, "mapped", mapped_pixels)


def expand(gray: bytes, layout: str) -> bytes:
    """Gray bytes as one of LAYOUTS; 16-bit samples are 257 times the byte, big-endian; alpha is full."""
    g = np.frombuffer(gray, np.uint8)
    if layout == "gray8":
        return gray
    if layout == "gray16":
        return np.repeat(g, 2).tobytes()
    out = np.full((len(g), 4 if layout == "rgba8" else 8), 255, np.uint8)
    out[:, : 3 * out.shape[1] // 4] = g[:, None]
    return out.tobytes()


def expand_layout(frames: DataFrame, layout: str, column: str = "mapped") -> DataFrame:
    """`samples`: the pixels of a column in another layout."""
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout {layout}")
    return _with_column(frames, "samples", lambda batch: (None if x is None else expand(x, layout) for x in batch.column(column).to_pylist()))


def explode_pixels(frames: DataFrame) -> DataFrame:
    """recording, frame_index, x, y, raw of every pixel, row by row."""

    def run(batches):
        for batch in batches:
            for one in range(batch.num_rows):
                row = {c: batch.column(c)[one].as_py() for c in ("recording", "frame_index", "width", "pixels")}
                raw = np.frombuffer(row["pixels"] or b"", np.uint8)
                at = np.arange(len(raw))
                w = row["width"] or 1
                yield pa.record_batch([pa.array([row["recording"]] * len(raw), pa.string()), pa.array(np.full(len(raw), row["frame_index"])), pa.array((at % w).astype(np.int32)), pa.array((at // w).astype(np.int32)), pa.array(raw.astype(np.int32))], ["recording", "frame_index", "x", "y", "raw"])

    return frames.mapInArrow(run, "recording string, frame_index long, x int, y int, raw int")


def map_pixels(pixels: DataFrame) -> DataFrame:
    """Pixel rows with `mapped`, as an expression."""
    return pixels.withColumn("mapped", display_level(F.col("raw"), F.col("mode_b"), F.col("mode_c"), F.col("mode_g")))


def pixel_histogram(frames: DataFrame, column: str = "pixels") -> DataFrame:
    """recording, raw, n: each task counts its own frames first, so pixels are never shuffled."""

    def run(batches):
        for batch in batches:
            held: dict[str, np.ndarray] = {}
            for name, pixels in zip(batch.column("recording").to_pylist(), batch.column(column), strict=True):
                raw = np.frombuffer(pixels.as_buffer(), np.uint8) if pixels.is_valid else np.zeros(0, np.uint8)
                held[name] = held.get(name, 0) + np.bincount(raw, minlength=256)
            for name, counts in held.items():
                at = np.flatnonzero(counts)
                yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["recording", "raw", "n"])

    return frames.select("recording", column).mapInArrow(run, "recording string, raw int, n long").groupBy("recording", "raw").agg(F.sum("n").alias("n"))


BINS = "level string, recording string, frame_index long, mode string, bins array<long>"


def grouped_histograms(frames: DataFrame, column: str = "pixels") -> DataFrame:
    """BINS: the 256 counts of pixels by frame, by recording and by mode, of frames(recording, frame_index, mode, pixels).

    Each task adds up its frames' arrays for every level first (one row a group and batch, none for a pixel or
    bin); arrays of a group then meet element by element.  Null pixels count as none.
    """
    schema = pa.schema([("level", pa.string()), ("recording", pa.string()), ("frame_index", pa.int64()), ("mode", pa.string()), ("bins", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            held: dict[tuple, np.ndarray] = {}
            names = zip(*(batch.column(c).to_pylist() for c in ("recording", "frame_index", "mode")), strict=True)
            for (recording, index, mode), pixels in zip(names, batch.column(column), strict=True):
                raw = np.frombuffer(pixels.as_buffer(), np.uint8) if pixels.is_valid else np.zeros(0, np.uint8)
                one = np.bincount(raw, minlength=256)
                for group in (("frame", recording, index, mode), ("recording", recording, None, None), ("mode", None, None, mode)):
                    held[group] = held[group] + one if group in held else one
            groups = list(held)
            for a in range(0, len(groups), 1024):
                part = groups[a : a + 1024]
                flat = np.concatenate([held[g] for g in part])
                bins = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 256, dtype=np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(zip(*part, strict=True), schema.types[:4], strict=True)), bins], schema=schema)

    part = frames.select("recording", "frame_index", "mode", column).mapInArrow(run, BINS)
    return part.groupBy("level", "recording", "frame_index", "mode").agg(F.array(*(F.sum(F.col("bins")[i]) for i in range(256))).alias("bins"))


def histogram_rows(grouped: DataFrame) -> DataFrame:
    """level, recording, frame_index, mode, raw, n: the bins of grouped histograms that are not empty."""
    return grouped.select("level", "recording", "frame_index", "mode", F.posexplode("bins").alias("raw", "n")).where("n > 0")


def saturation_report(histogram: DataFrame, curves: DataFrame) -> DataFrame:
    """Pixels that each recording's curve clips, and levels before and after it."""
    h = histogram.join(curves.select("recording", "mode_b", "mode_c", "mode_g"), "recording")
    over = unclamped(F.col("raw"), F.col("mode_b"), F.col("mode_c"))
    level = display_level(F.col("raw"), F.col("mode_b"), F.col("mode_c"), F.col("mode_g"))
    clipped = F.sum(F.when((over > 255) | (over < 0), F.col("n")).otherwise(0))
    return h.groupBy("recording").agg(
        F.sum("n").alias("n_pixels"), clipped.alias("n_clipped"), F.round(clipped / F.sum("n"), 6).alias("clipped_share"), F.count(F.lit(1)).alias("raw_levels"), F.count_distinct(level).alias("mapped_levels")
    )


def playback_timeline(frames: DataFrame, fps: float, start: int = 0, in_order: bool = False) -> DataFrame:
    """Mapped frames with pts in seconds, in order within each recording, without the raw pixels.

    in_order: the frames come from read_frames(in_order=True) and are in order already; others are
    dealt by range of (recording, frame_index), which moves the mapped pixels.
    """
    out = apply_display_transform(frames).drop("pixels").withColumn("pts", (F.col("frame_index") - start) / F.lit(float(fps)))
    return out if in_order else out.repartitionByRange("recording", "frame_index").sortWithinPartitions("recording", "frame_index")
