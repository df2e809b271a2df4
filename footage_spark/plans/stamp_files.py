"""The sink of one CSV folder a recording: staged by tasks, then named where tasks run, then put in place as a whole.

Spark's own writer opens, checks and renames a file for each recording in some milliseconds, and the driver merges
them one by one; with very many short recordings nearly all the time goes there.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.csv as pacsv
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = b"frame_index,timestamp_raw,timestamp_hex\n"
#: What the names of partition folders escape, and the folder of a null or empty name.
_ESCAPED = re.compile("[\x01-\x1f\x7f\"#%'*/:=?\\\\{\\[\\]^]")
_NO_NAME = "__HIVE_DEFAULT_PARTITION__"
#: Rows that are sent on together, about.
READ_ROWS = 10_000


def folder_of(name: str | None) -> str:
    """The folder of a name, as readers of partitioned tables expect it."""
    return f"name={_ESCAPED.sub(lambda m: f'%{ord(m[0]):02X}', name) if name else _NO_NAME}"


def _stage(staging: str):
    """Rows (name, line) sorted by name -> a file a name in the folder of this attempt; one row with its name."""

    def run(batches):
        context = TaskContext.get()
        attempt = f"{context.partitionId():06d}-{context.taskAttemptId()}"
        here, now, out, begun = f"{staging}/{attempt}", None, None, False
        os.makedirs(here, exist_ok=True)
        try:
            for batch in batches:
                names, lines = (batch.column(c).to_pylist() for c in ("name", "line"))
                first = 0
                while first < len(names):
                    last = first + 1
                    while last < len(names) and names[last] == names[first]:
                        last += 1
                    if not begun or folder_of(names[first]) != now:
                        if out is not None:
                            out.close()
                        now, begun = folder_of(names[first]), True
                        known = os.path.exists(f"{here}/{now}")
                        out = open(f"{here}/{now}", "ab")  # noqa: SIM115
                        if not known:
                            out.write(HEADER)
                    out.write(("\n".join(lines[first:last]) + "\n").encode())
                    first = last
        finally:
            if out is not None:
                out.close()
        yield pa.record_batch([pa.array([attempt], pa.string())], ["attempt"])

    return run


def _place(staging: str, tree: str):
    """Attempts -> their files in the folders of the tree; may be done again after a failure."""

    def run(batches):
        for batch in batches:
            for attempt in batch.column("attempt").to_pylist():
                for name in os.listdir(f"{staging}/{attempt}"):
                    os.makedirs(f"{tree}/{name}", exist_ok=True)
                    os.replace(f"{staging}/{attempt}/{name}", f"{tree}/{name}/part-{attempt}.csv")
            yield pa.record_batch([batch.column("attempt")], ["attempt"])

    return run


def write_stamp_files(stamps: DataFrame, path: str) -> None:
    """Write stamps(name, frame_index, timestamp_raw, timestamp_hex) as path/name=.../part-*.csv, instead of what is there.

    path is on a folder that all executors share.  A failed job leaves what was there.
    """
    spark, job = stamps.sparkSession, f"{path.rstrip('/')}-jobs/{uuid.uuid4().hex}"
    staging, tree = f"{job}/staging", f"{job}/tree"
    os.makedirs(staging)
    os.makedirs(tree)
    try:
        line = F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("frame_index", "timestamp_raw", "timestamp_hex")))
        sorted_ = stamps.sortWithinPartitions("name", "frame_index").select("name", line.alias("line"))
        attempts = [r["attempt"] for r in sorted_.mapInArrow(_stage(staging), "attempt string").collect()]
        if attempts:
            made = spark.createDataFrame([(x,) for x in attempts], "attempt string").repartition(min(len(attempts), 10_000), "attempt")
            made.mapInArrow(_place(staging, tree), "attempt string").count()
        open(f"{tree}/_SUCCESS", "w").close()
        if os.path.isdir(path):
            os.replace(path, f"{job}/before")
        os.replace(tree, path)
    finally:
        shutil.rmtree(job, ignore_errors=True)


def _read(path: str):
    """Folders of recordings -> the rows of their files, some files at a time."""
    kinds = {"frame_index": pa.int64(), "timestamp_raw": pa.int64(), "timestamp_hex": pa.string()}
    options = pacsv.ConvertOptions(column_types=kinds, include_columns=list(kinds), null_values=[""], strings_can_be_null=True)

    def run(batches):
        held, many = [], 0
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                name = folder.removeprefix("name=")
                name = None if name == _NO_NAME else unquote(name)
                for file in os.listdir(f"{path}/{folder}"):
                    if file.startswith((".", "_")):
                        continue
                    for part in pacsv.open_csv(f"{path}/{folder}/{file}", read_options=pacsv.ReadOptions(use_threads=False), convert_options=options):
                        held.append(part.append_column("name", pa.array([name] * part.num_rows, pa.string())))
                        many += part.num_rows
                        if many >= READ_ROWS:
                            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                            held, many = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def read_stamp_files(spark: SparkSession, path: str) -> DataFrame:
    """frame_index, timestamp_raw, timestamp_hex, name of what write_stamp_files wrote.

    Folders are listed and opened where tasks run; a reader of partitioned tables lists each by a task of its own.
    """

    def folders(batches):
        for batch in batches:
            for _ in range(batch.num_rows):
                found = []
                with os.scandir(path) as entries:
                    for entry in entries:
                        if entry.name.startswith("name="):
                            found.append(entry.name)
                        if len(found) == READ_ROWS:
                            yield pa.record_batch([pa.array(found, pa.string())], ["folder"])
                            found = []
                yield pa.record_batch([pa.array(found, pa.string())], ["folder"])

    tasks = 4 * max(spark.sparkContext.defaultParallelism, 1)
    listed = spark.range(0, 1, 1, 1).mapInArrow(folders, "folder string")
    return listed.repartition(tasks, "folder").mapInArrow(_read(path), "frame_index long, timestamp_raw long, timestamp_hex string, name string")
