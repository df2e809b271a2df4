"""The sink of one image file a frame, as a data source: staged by tasks, committed as a whole, then given its names.

Tasks write under a folder of their own attempt and return what they staged.  Commit writes one record
that names the attempts that count; without it no file ever gets a final name.  Then the staged files are renamed
where tasks run, which may be done again at any time with the same result.  The manifest lists what was committed.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..sources.footage import local_path, register_source

SCHEMA = "recording string, frame_index bigint, tick bigint, out_name string, file_name string, image binary"
MANIFEST = "recording string, frame_index bigint, tick bigint, out_name string, path string, bytes bigint"


@dataclass
class Staged(WriterCommitMessage):
    """One task's list of staged files (a name under the job's staging folder), and its totals."""

    listing: str
    frames: int
    size: int


class FrameFileWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.root, self.job = local_path(options["path"]), options.get("job") or uuid.uuid4().hex
        self.staging = f"{jobs(self.root)}/staging/{self.job}"

    def write(self, iterator):
        context = TaskContext.get()
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}"
        os.makedirs(f"{self.staging}/{name}", exist_ok=True)
        frames, total, made = 0, 0, set()
        with open(f"{self.staging}/{name}.jsonl", "w") as listing:
            for batch in iterator:
                for r in batch.to_pylist():
                    if r["image"] is None:
                        continue
                    if r["out_name"] not in made:
                        os.makedirs(f"{self.staging}/{name}/{r['out_name']}", exist_ok=True)
                        made.add(r["out_name"])
                    with open(f"{self.staging}/{name}/{r['out_name']}/{r['file_name']}", "wb") as file:
                        file.write(r["image"])
                    listing.write(json.dumps({k: r[k] for k in ("recording", "frame_index", "tick", "out_name", "file_name")} | {"bytes": len(r["image"])}) + "\n")
                    frames, total = frames + 1, total + len(r["image"])
        return Staged(name, frames, total)

    def commit(self, messages):
        got = [m for m in messages if m is not None]
        record = {"job": self.job, "listings": [m.listing for m in got], "frames": sum(m.frames for m in got), "bytes": sum(m.size for m in got)}
        os.makedirs(f"{jobs(self.root)}/commits", exist_ok=True)
        part = f"{jobs(self.root)}/commits/.{self.job}.part"
        with open(part, "w") as out:
            json.dump(record, out)
        os.replace(part, commit_path(self.root, self.job))

    def abort(self, messages):
        shutil.rmtree(self.staging, ignore_errors=True)


class FrameFiles(DataSource):
    """df.write.format("frame_files"): columns of SCHEMA, options path (a folder that all share) and job (a name of its own)."""

    @classmethod
    def name(cls):
        return "frame_files"

    def schema(self):
        return SCHEMA

    def writer(self, schema, overwrite):
        return FrameFileWriter(self.options)


def jobs(root: str) -> str:
    """The folder beside root (on one file system with it) for what is staged, commit records and manifests."""
    return f"{root.rstrip('/')}-jobs"


def commit_path(root: str, job: str) -> str:
    return f"{jobs(root)}/commits/{job}.json"


def _placed(staging: str, root: str, listing: str):
    """Rename one task's files; rows of MANIFEST.  A file that has its final name already is left there."""
    with open(f"{staging}/{listing}.jsonl") as lines:
        for r in map(json.loads, lines):
            staged, path = f"{staging}/{listing}/{r['out_name']}/{r['file_name']}", f"{root}/{r['out_name']}/{r['file_name']}"
            os.makedirs(os.path.dirname(path), exist_ok=True)
            try:
                os.replace(staged, path)
            except FileNotFoundError:
                if os.path.getsize(path) != r["bytes"]:
                    raise
            yield r | {"path": path}


def promote(spark: SparkSession, root: str, job: str) -> DataFrame:
    """Give the files of a committed job their names, and return its manifest (a table beside root).

    May be called again after a failure: renaming starts from the commit record.
    """
    root = local_path(root)
    with open(commit_path(root, job)) as file:
        listings = json.load(file)["listings"]
    staging, manifest = f"{jobs(root)}/staging/{job}", f"{jobs(root)}/manifest/job={job}"
    kinds = [("recording", pa.string()), ("frame_index", pa.int64()), ("tick", pa.int64()), ("out_name", pa.string()), ("path", pa.string()), ("bytes", pa.int64())]

    def run(batches):
        for batch in batches:
            for listing in batch.column("listing").to_pylist():
                held = []
                for r in _placed(staging, root, listing):
                    held.append(r)
                    if len(held) == 10_000:
                        yield pa.record_batch([pa.array([x[k] for x in held], t) for k, t in kinds], [k for k, _ in kinds])
                        held = []
                if held:
                    yield pa.record_batch([pa.array([x[k] for x in held], t) for k, t in kinds], [k for k, _ in kinds])

    if os.path.isdir(staging):
        rows = spark.createDataFrame([(x,) for x in listings], "listing string")
        rows.repartition(max(1, min(len(listings), 10_000)), "listing").mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(manifest)
        shutil.rmtree(staging, ignore_errors=True)
    return spark.read.schema(MANIFEST).parquet(manifest)


def write_files(images: DataFrame, root: str) -> DataFrame:
    """Write images(recording, frame_index, tick, out_name, file_name, image) as files; returns the manifest."""
    spark, job = images.sparkSession, uuid.uuid4().hex
    register_source(spark, FrameFiles)
    images.select("recording", "frame_index", "tick", "out_name", "file_name", "image").write.format("frame_files").mode("append").option("path", root).option("job", job).save()
    return promote(spark, root, job)
