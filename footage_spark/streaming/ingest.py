"""Incremental ingest: recordings are taken once, when both their files are there and whole.

A stream of arrivals (files of the lake by the time they last changed, one folder a task) is grouped by
recording.  What is incomplete waits as state, with a timer; what is taken, and what has waited too
long, leaves it.  So a run looks at what has changed since the last one and at what waits, not at what was ingested before.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor

from ..sources.footage import code_by_value, local_path, register_source, sidecar_numbers
from ..sources.recordings import SIDECAR_SUFFIX, SUFFIX, _names, parse_sidecars, resolve, with_names

EVENTS = "recording string, kind string, size bigint, xml string"
ARRIVALS = "recording string, footage_path string, xml string, file_size bigint, outcome string"
#: Most tasks of a listing.
MOST_TASKS = 1000
#: A file that changes while it is looked for is left to the next run: file times are this exact at least.
SETTLE_MS = 50
#: How long a recording may wait, and how long one that was taken is remembered.
WAIT_SECONDS, REMEMBER_SECONDS = 7 * 86_400, 90 * 86_400


@dataclass
class Folders(InputPartition):
    folders: list[str]
    after: int
    until: int


def _changed(folder: str, after: int, until: int):
    """(name, size) of files whose content or name changed in (after, until], in nanoseconds."""
    try:
        with os.scandir(folder) as entries:
            for e in entries:
                if e.name.startswith(".") or not e.name.endswith((SUFFIX, SIDECAR_SUFFIX)) or e.is_dir():
                    continue
                stat = e.stat()
                # the change time, as a file that is moved here keeps its older time of writing
                if after < stat.st_ctime_ns <= until:
                    yield e.name, stat.st_size
    except OSError:  # gone meanwhile
        return


class ArrivalReader(DataSourceStreamReader):
    def __init__(self, options):
        self.root, self.settle = local_path(options.get("root") or options["path"]).rstrip("/"), int(options.get("settle_ms", SETTLE_MS))

    def initialOffset(self):
        return {"ns": 0}

    def latestOffset(self):
        return {"ns": time.time_ns() - self.settle * 1_000_000}

    def partitions(self, start, end):
        folders = [self.root, *(f"{self.root}/{x}" for x in sorted(_names(self.root)[0]))]
        some = -(-len(folders) // MOST_TASKS)
        return [Folders(folders[a : a + some], start["ns"], end["ns"]) for a in range(0, len(folders), some)]

    def read(self, part):
        for folder in part.folders:
            for name, size in _changed(folder, part.after, part.until):
                if name.endswith(SUFFIX):
                    yield f"{folder}/{name}", "recording", size, None
                else:
                    try:
                        with open(f"{folder}/{name}", "rb") as file:
                            xml = file.read().decode("utf-8", "replace")
                    except OSError:
                        continue
                    yield f"{folder}/{name.removesuffix(SIDECAR_SUFFIX)}{SUFFIX}", "sidecar", size, xml

    def commit(self, end):
        pass


class Arrivals(DataSource):
    """spark.readStream.format("footage_arrivals").load(root): EVENTS of recordings and sidecars as they land or grow.

    Each trigger has an offset of its own (the time), so that timers are looked at even if nothing came.
    """

    @classmethod
    def name(cls):
        return "footage_arrivals"

    def schema(self):
        return EVENTS

    def streamReader(self, schema):
        return ArrivalReader(self.options)


class Waiting(StatefulProcessor):
    """State of each recording that is not whole: its size, its sidecar; a timer that gives it up."""

    def __init__(self, wait_seconds: float, remember_seconds: float, width=None, height=None, stride=None):
        self.wait, self.remember, self.geometry = int(wait_seconds * 1000), int(remember_seconds * 1000), (width, height, stride)

    def init(self, handle):
        self.handle = handle
        self.seen = handle.getValueState("seen", "size bigint, xml string, told boolean")
        self.taken = handle.getValueState("taken", "at bigint", self.remember)

    def needs(self, xml: str) -> int:
        """Bytes that the sidecar announces, 0 where it does not say."""
        w, h, n = sidecar_numbers(xml)
        width, height, stride = self.geometry
        w, h = width or w, height or h
        step = stride or (8 + w * h if w and h and w > 0 and h > 0 else 0)
        return max(n or 0, 0) * step

    def row(self, recording, xml, size, outcome):
        side = None if xml is None else recording.removesuffix(SUFFIX) + SIDECAR_SUFFIX
        return pd.DataFrame({"recording": [recording], "footage_path": [side], "xml": [xml], "file_size": pd.array([size], "Int64"), "outcome": [outcome]})

    def handleInputRows(self, key, rows, timerValues):
        (recording,) = key
        size, xml, told = self.seen.get() if self.seen.exists() else (None, None, False)
        for batch in rows:
            for kind, length, text in zip(batch["kind"], batch["size"], batch["xml"], strict=True):
                if kind == "recording":
                    size = int(length)
                else:
                    xml = text
        if self.taken.exists():  # touched again: it was taken once
            return
        now = timerValues.getCurrentProcessingTimeInMs()
        if xml is not None and size is not None and size >= self.needs(xml):
            self.forget(now)
            yield self.row(recording, xml, size, "whole")
            return
        if not self.seen.exists():
            self.handle.registerTimer(now + self.wait)
        self.seen.update((size, xml, told or xml is not None))
        if xml is not None and not told:
            yield self.row(recording, xml, size, "incomplete")

    def forget(self, now):
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.seen.clear()
        self.taken.update((now,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.seen.exists():
            size, xml, _ = self.seen.get()
            self.seen.clear()
            yield self.row(key[0], xml, size, "expired")

    def close(self):
        pass


def catalog_of(arrivals: DataFrame, register: str, **options) -> DataFrame:
    """Catalogue rows of arrivals, named by the register; status incomplete or expired for what is not whole."""
    stem = F.regexp_extract("recording", r"([^/]+)\.bin$", 1)
    found = arrivals.withColumn("camera_dir", F.regexp_extract("recording", r"^(.*)/[^/]+$", 1)).withColumn("stem", stem)
    full = resolve(parse_sidecars(with_names(found, register)).drop("xml"), **options)
    return full.withColumn("status", F.when(F.col("outcome") == "whole", F.col("status")).otherwise(F.col("outcome"))).drop("outcome")


def arrivals(spark: SparkSession, root: str, wait_seconds: float = WAIT_SECONDS, settle_ms: int = SETTLE_MS, width=None, height=None, stride=None) -> DataFrame:
    """The stream of ARRIVALS under root: each recording whole once, or incomplete and later whole or expired."""
    register_source(spark, Arrivals)
    events = spark.readStream.format("footage_arrivals").option("settle_ms", settle_ms).load(local_path(root))
    with code_by_value():
        return events.groupBy("recording").transformWithStateInPandas(Waiting(wait_seconds, REMEMBER_SECONDS, width, height, stride), ARRIVALS, "Append", "ProcessingTime")


def ingest_new_recordings(spark: SparkSession, root: str, out: str, checkpoint: str, then: Callable[[DataFrame], None] | None = None, register: str | None = None, wait_seconds: float = WAIT_SECONDS, settle_ms: int = SETTLE_MS, trigger: dict | None = None, **options):
    """Stream the lake under root and append catalogue rows to out; by default what is there now, then the query ends.

    A recording whose file is missing or still short when its sidecar is seen gets a row with status incomplete,
    and one with its own status once it is whole; then(rows with status ok) is called for those.  One
    that has waited for wait_seconds gets a row with status expired and is given up, unless it changes again.
    Names come from the register (out + "-names" unless given), as in recordings(register=...).  Rows of a batch that
    runs twice replace themselves.
    """
    names = register or f"{out.rstrip('/')}-names"
    stream = arrivals(spark, root, wait_seconds, settle_ms, *(options.get(x) for x in ("width", "height", "stride")))

    def take(batch: DataFrame, epoch: int) -> None:
        # state is worked out once; all else reads what came of it
        landed = f"{checkpoint}/landed/epoch={epoch}"
        batch.write.mode("overwrite").parquet(landed)
        came = batch.sparkSession.read.schema(ARRIVALS).parquet(landed)
        if came.isEmpty():
            return
        catalog_of(came, names, **options).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        if then is not None:
            then(batch.sparkSession.read.parquet(f"{out}/epoch={epoch}").where("status = 'ok'"))

    # state with timers needs this store; the setting is taken over by the query as it starts
    name, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, store)
    try:
        return stream.writeStream.trigger(**(trigger or {"availableNow": True})).option("checkpointLocation", checkpoint).foreachBatch(take).start()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
