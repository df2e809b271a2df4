"""Frames of many recordings, read in parallel by seeking.

A frame is an unsigned 64-bit little-endian tick and width * height bytes.  The work is planned as a
table of chunks (a run of frames of one recording), made from the catalogue by expressions: ranges
cut it before anything is read, what a frame needs of its recording (curve, output name) stands in
the chunk's row, and no join is needed once there are pixels.  The `footage` batch source plans the
same chunks from a root and load options.  Paths are opened where tasks run: use a shared mount.
"""

from __future__ import annotations

import json
import os
import re
import sys
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from fnmatch import fnmatchcase
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..operators.pixels import BATCH_BYTES, small_batches
from .recordings import _names, read_folder

SCHEMA = "recording string, frame_index bigint, tick bigint, width int, height int, pixels binary"
HEADERS = "recording string, frame_index bigint, tick bigint"
TYPES = {"recording": pa.string(), "frame_index": pa.int64(), "tick": pa.int64(), "width": pa.int32(), "height": pa.int32(), "pixels": pa.binary()}
CHUNK_BYTES = 64 << 20
#: Frames of a chunk of headers, and the largest frame whose header is read along with its pixels.
HEADER_FRAMES, HEADER_BLOCK = 1 << 18, 4096
#: Most partitions of a scan; a partition then has several chunks.
MOST_PARTITIONS = 100_000


@dataclass
class Chunk(InputPartition):
    path: str
    first: int
    n: int
    stride: int
    width: int
    height: int


def local_path(recording: str) -> str:
    return recording.removeprefix("file://").removeprefix("file:")


def _block(fd: int, at: int, size: int) -> bytes:
    """Bytes [at, at + size) of a file, fewer at its end."""
    parts = []
    while size > 0 and (got := os.pread(fd, size, at)):
        parts.append(got)
        at, size = at + len(got), size - len(got)
    return b"".join(parts)


def read_chunk(c: Chunk, fields: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of a chunk's frames; without `pixels` only 8 bytes of a large frame are read.  A cut-off frame is left out."""
    if not c.n:
        return
    size, wanted = c.width * c.height, "pixels" in fields
    whole = wanted or c.stride <= HEADER_BLOCK
    per = max(1, BATCH_BYTES // c.stride) if whole else 65536
    fd = os.open(c.path, os.O_RDONLY)
    try:
        for a in range(c.first, c.first + c.n, per):
            m = min(per, c.first + c.n - a)
            if whole:
                raw = np.frombuffer(_block(fd, a * c.stride, m * c.stride), np.uint8)
                m = len(raw) // c.stride
                frames = raw[: m * c.stride].reshape(m, c.stride)
                ticks = np.ascontiguousarray(frames[:, :8]).view("<i8").ravel()
            else:
                heads = [os.pread(fd, 8, i * c.stride) for i in range(a, a + m)]
                heads = [h for h in heads if len(h) == 8]
                m, ticks = len(heads), np.frombuffer(b"".join(heads), "<i8")
            have = {"recording": lambda m=m: pa.array([c.path] * m, pa.string()), "frame_index": lambda a=a, m=m: pa.array(np.arange(a, a + m)), "tick": lambda t=ticks: pa.array(t)}
            have |= {"width": lambda m=m: pa.array(np.full(m, c.width, np.int32)), "height": lambda m=m: pa.array(np.full(m, c.height, np.int32))}
            if wanted:
                body = np.ascontiguousarray(frames[:, 8 : 8 + size])
                ends = pa.py_buffer((np.arange(m + 1) * size).astype(np.int32))
                have["pixels"] = lambda m=m, ends=ends, body=body: pa.Array.from_buffers(pa.binary(), m, [None, ends, pa.py_buffer(body)])
            if m:
                yield pa.record_batch([have[f]() for f in fields], fields)
    finally:
        os.close(fd)


@dataclass
class Chunks(InputPartition):
    """Chunks that one task reads."""

    chunks: list[Chunk]


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"\s*[+-]?[0-9]+\s*", text) else None


def sidecar_numbers(xml: str | None) -> tuple[int | None, int | None, int | None]:
    """Width, height and number of images of a sidecar, null where absent or unreadable: as parse_sidecars, for planning."""
    try:
        top = ElementTree.fromstring(xml or "").find("Footage")
    except ElementTree.ParseError:
        top = None
    return (None,) * 3 if top is None else tuple(_number(top.findtext(x)) for x in ("ResolutionX", "ResolutionY", "NumberOfImages"))


def plan_root(root: str, names: list[str], width: int | None = None, height: int | None = None, stride: int | None = None) -> list[dict]:
    """path, n, stride, width, height of the recordings in root and right below it whose geometry is known.

    names: patterns of which one must match a recording's stem or folder/stem; none: all.
    """
    base = local_path(root).rstrip("/") or "/"
    folders = [base, *(f"{base}/{x}" for x in sorted(_names(base)[0]))]
    out = []
    for r in (r for folder in folders for r in read_folder(folder, True)):
        label = f"{os.path.basename(r['camera_dir'])}/{r['stem']}"
        if names and not any(fnmatchcase(r["stem"], x) or fnmatchcase(label, x) for x in names):
            continue
        w, h, stated = sidecar_numbers(r["xml"])
        w, h = width or (w if w and w > 0 else None), height or (h if h and h > 0 else None)
        step = stride or (8 + w * h if w and h else None)
        if not w or not h or step < 8 + w * h:
            continue
        held = r["file_size"] // step
        out.append({"path": r["recording"], "n": min(stated, held) if stated and stated > 0 else held, "stride": step, "width": w, "height": h})
    return out


class FootageReader(DataSourceReader):
    def __init__(self, options, schema):
        whole = lambda x: None if options.get(x) is None else int(options[x])
        self.fields = [f.name for f in schema.fields]
        if unknown := set(self.fields) - set(TYPES):
            raise ValueError(f"no such columns: {sorted(unknown)}")
        self.chunk_bytes = int(options.get("chunk_bytes", CHUNK_BYTES))
        self.listed, self.root = options.get("catalog"), options.get("root") or options.get("path")
        self.start, self.count = whole("start") or 0, whole("count")
        self.names = [x.strip() for x in options.get("recordings", "").split(",") if x.strip()]
        self.geometry = whole("width"), whole("height"), whole("stride")
        self.only, self.low, self.high, self.given = None, 0, None, dict(options)

    def pushFilters(self, filters):
        """Recordings and frame ranges asked for are not planned otherwise; Spark applies the filters again."""
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("recording",) and isinstance(f, EqualTo | In):
                asked = {value} if isinstance(f, EqualTo) else set(value)
                self.only = asked if self.only is None else self.only & asked
            elif column == ("frame_index",) and isinstance(value, int):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    end = value + (not isinstance(f, LessThan))
                    self.high = end if self.high is None else min(self.high, end)
            yield f

    def partitions(self):
        if self.listed is not None:
            known = [r | {"first": r.get("first", 0)} for r in json.loads(self.listed)]
        elif self.root:
            if self.start < 0:
                raise ValueError("start is below 0")
            known = [r | {"first": self.start, "n": r["n"] - self.start if self.count is None else min(self.count, r["n"] - self.start)} for r in plan_root(self.root, self.names, *self.geometry)]
            if known and all(r["n"] <= 0 for r in known) and self.count != 0:
                raise ValueError(f"no recording has frame {self.start}")
        else:
            raise ValueError(f"footage needs a root (or path), or a catalog: {self.given}")
        chunks = []
        for r in known:
            if self.only is not None and r["path"] not in self.only:
                continue
            first, end = max(r["first"], self.low), r["first"] + r["n"]
            end = end if self.high is None else min(end, self.high)
            # without pixels a chunk is as many frames as one task reads headers of
            per = max(1, self.chunk_bytes // r["stride"], 1 if "pixels" in self.fields else HEADER_FRAMES)
            chunks += [Chunk(r["path"], a, min(per, end - a), r["stride"], r["width"], r["height"]) for a in range(first, end, per)]
        some = -(-len(chunks) // MOST_PARTITIONS) or 1
        return [Chunks(chunks[a : a + some]) for a in range(0, len(chunks), some)] or [Chunks([])]

    def read(self, part):
        for chunk in part.chunks:
            yield from read_chunk(chunk, self.fields)


class FootageSource(DataSource):
    """spark.read.format("footage").load(root), or CREATE TABLE ... USING footage OPTIONS (root '...').

    Options: start and count (frames of every recording, by absolute index), recordings (patterns of stems
    or folder/stem, comma-separated), width, height and stride (where sidecars do not say), chunk_bytes.  A schema
    without pixels reads headers only.  Planned on the driver, one entry a chunk: for lakes of very many
    recordings read_frames plans the same in tasks.  catalog: a JSON list of path, first, n, stride,
    width, height in place of a path.
    """

    @classmethod
    def name(cls):
        return "footage"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FootageReader(self.options, schema)


@contextmanager
def code_by_value():
    """What is pickled meanwhile takes its code along: the processes that plan sources and state may not find this package."""
    package = sys.modules[__name__.partition(".")[0]]
    cloudpickle.register_pickle_by_value(package)
    try:
        yield
    finally:
        cloudpickle.unregister_pickle_by_value(package)


def register_source(spark: SparkSession, source: type[DataSource]) -> None:
    """Make a source known to the session."""
    with code_by_value():
        spark.dataSource.register(source)


def register_footage(spark: SparkSession) -> None:
    """Make the source known to the session, with filters that reach its planning."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    register_source(spark, FootageSource)


def load_footage(spark: SparkSession, catalog: list[dict], schema: str = SCHEMA) -> DataFrame:
    """Frames of a few recordings by the batch source; the list passes the driver."""
    register_footage(spark)
    return spark.read.format("footage").schema(schema).option("catalog", json.dumps(catalog)).load()


def plan_chunks(recordings: DataFrame, start: int = 0, count: int | None = None, chunk_bytes: int = CHUNK_BYTES, least_frames: int = 1, carry=()) -> DataFrame:
    """recording, frame_stride, width, height, first, n and the carried columns of each chunk of the frames [start, start + count)."""
    end = F.col("frames_total") if count is None else F.least(F.col("frames_total"), F.lit(start + count).cast("long"))
    per = F.greatest(F.expr(f"{chunk_bytes}L div frame_stride"), F.lit(least_frames).cast("long"))
    ok = recordings.where("status = 'ok'").withColumn("end", end).withColumn("per", per).where((F.col("end") > start) & F.lit(start >= 0))
    parts = ok.select(F.regexp_replace("recording", "^file:(//)?", "").alias("recording"), "frame_stride", "width", "height", "end", "per", *carry, F.explode(F.sequence(F.lit(start).cast("long"), F.col("end") - 1, F.col("per"))).alias("first"))
    return parts.select("recording", "frame_stride", "width", "height", "first", F.least("per", F.col("end") - F.col("first")).alias("n"), *carry)


def scan_batches(fields: list[str], carry=()):
    """Batches of chunk rows -> batches of their frames, each with the carried columns of its chunk."""

    def run(batches):
        for batch in batches:
            rest = [batch.column(c) for c in carry]
            for i, r in enumerate(batch.select(["recording", "first", "n", "frame_stride", "width", "height"]).to_pylist()):
                for out in read_chunk(Chunk(local_path(r["recording"]), r["first"], r["n"], r["frame_stride"], r["width"], r["height"]), fields):
                    again = pa.array(np.full(out.num_rows, i))
                    yield pa.RecordBatch.from_arrays([*out.columns, *(x.take(again) for x in rest)], names=[*fields, *carry])

    return run


def scan_chunks(parts: DataFrame, schema: str = SCHEMA, carry=()) -> DataFrame:
    """Frames of chunk rows, each with the carried columns of its chunk."""
    small_batches(parts.sparkSession)
    full = T.StructType([*T.StructType.fromDDL(schema), *parts.select(*carry).schema])
    return parts.mapInArrow(scan_batches([f.name for f in T.StructType.fromDDL(schema)], carry), full)


def plan_scan(recordings: DataFrame, start: int = 0, count: int | None = None, carry=(), in_order: bool = False, chunk_bytes: int = CHUNK_BYTES, least_frames: int = 1) -> DataFrame:
    """Chunk rows dealt to tasks.  Only recordings with status ok are read; a start past every recording's end raises."""
    parts = plan_chunks(recordings, start, count, chunk_bytes, least_frames, carry)
    n = parts.count()  # one number; chunk rows themselves stay where they are
    if not n and not recordings.where("status = 'ok'").isEmpty():
        raise ValueError(f"no recording has frame {start}")
    # a stated number of partitions: a chunk's row is so small that Spark would else put all in one
    n = min(max(n, 1), MOST_PARTITIONS)
    return parts.repartitionByRange(n, "recording", "first").sortWithinPartitions("recording", "first") if in_order else parts.repartition(n, "recording", "first")


def read_frames(spark: SparkSession, recordings: DataFrame, start: int = 0, count: int | None = None, carry=(), in_order: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Frames [start, start + count) of every recording, by absolute index, with columns of its catalogue row (carry).

    in_order: partitions and the frames in them come in order of (recording, frame_index); only the
    chunk rows are shuffled for it.
    """
    return scan_chunks(plan_scan(recordings, start, count, list(carry), in_order, chunk_bytes), SCHEMA, list(carry))


def read_timestamps(spark: SparkSession, recordings: DataFrame, start: int = 0, count: int | None = None, carry=()) -> DataFrame:
    """The same range without pixels: of frames over HEADER_BLOCK bytes 8 bytes are read."""
    from ..functions.display import tick_hex

    heads = scan_chunks(plan_scan(recordings, start, count, list(carry), least_frames=HEADER_FRAMES), HEADERS, list(carry))
    return heads.select("recording", "frame_index", F.col("tick").alias("timestamp_raw"), tick_hex(F.col("tick")).alias("timestamp_hex"), *carry)


def read_frames_at(spark: SparkSession, recordings: DataFrame, asked: DataFrame, carry=()) -> DataFrame:
    """The asked(recording, frame_index) frames alone; an index is clamped to the recording's frames."""
    ok = recordings.where("status = 'ok' and frames_total > 0").withColumn("recording", F.regexp_replace("recording", "^file:(//)?", ""))
    names = asked.select(F.regexp_replace("recording", "^file:(//)?", "").alias("recording"), "frame_index")
    index = F.greatest(F.lit(0).cast("long"), F.least(F.col("frame_index").cast("long"), F.col("frames_total") - 1))
    parts = names.join(ok, "recording").select("recording", "frame_stride", "width", "height", index.alias("first"), F.lit(1).cast("long").alias("n"), *carry).distinct()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return scan_chunks(parts.repartition(n, "recording", "first"), SCHEMA, list(carry))


def read_frame(spark: SparkSession, recordings: DataFrame, recording: str, index: int) -> DataFrame:
    """One frame; the index is clamped to the recording's frames."""
    one = recordings.where(F.regexp_replace("recording", "^file:(//)?", "") == local_path(recording))
    return read_frames_at(spark, one, one.select("recording", F.lit(index).cast("long").alias("frame_index")))
