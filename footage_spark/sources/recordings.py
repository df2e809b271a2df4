"""The recordings catalogue: files found, sidecars parsed, geometry and frame counts resolved."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.display import output_name

#: Fields of a sidecar, all read as text first so that one bad number spoils one field only.
SIDECAR = (
    "Footage struct<ResolutionX string, ResolutionY string, NumberOfImages string, Framerate string, Exposure string, TimeMarkerReference string>, "
    "SettingsProcessing struct<Brightness string, Contrast string, Gamma string>, Camera struct<Name string>"
)
#: The operating point at which the curve was verified.
VERIFIED = {"brightness": 49.0, "contrast": 18.0, "gamma": 1.0}


#: What a folder's listing gives of each recording.
FOUND = "recording string, camera_dir string, stem string, sidecar_path string, file_size bigint, footage_path string, xml string"
SUFFIX, SIDECAR_SUFFIX = ".bin", ".footage"


def plain_path(column) -> Column:
    """A path without the scheme of local files."""
    return F.regexp_replace(column, "^file:(//)?", "")


def _names(folder: str) -> tuple[list[str], dict[str, int | None], set[str]]:
    """Folders, recordings with their sizes, and sidecars in a folder; names that start with a dot are left out."""
    folders, bins, cars = [], {}, set()
    with os.scandir(folder) as entries:
        for e in entries:
            if e.name.startswith("."):
                continue
            if e.is_dir():
                folders.append(e.name)
            elif e.name.endswith(SUFFIX) and len(e.name) > len(SUFFIX):
                bins[e.name.removesuffix(SUFFIX)] = e.stat().st_size
            elif e.name.endswith(SIDECAR_SUFFIX):
                cars.add(e.name.removesuffix(SIDECAR_SUFFIX))
    return folders, bins, cars


def read_folder(folder: str, read: bool) -> list[dict]:
    """FOUND rows of the recordings that stand in a folder itself; sidecars are read if asked for."""
    try:
        _, bins, cars = _names(folder)
    except OSError:  # gone or not to be read: its recordings are not seen, others are
        return []
    made = []
    for stem, size in sorted(bins.items()):
        side = f"{folder}/{stem}{SIDECAR_SUFFIX}"
        xml = None
        if read and stem in cars:
            try:
                with open(side, "rb") as file:
                    xml = file.read().decode("utf-8", "replace")
            except OSError:
                cars.discard(stem)
        made.append({"recording": f"{folder}/{stem}{SUFFIX}", "camera_dir": folder, "stem": stem, "sidecar_path": side, "file_size": size, "footage_path": side if stem in cars else None, "xml": xml})
    return made


def list_recordings(spark: SparkSession, root: str, sidecars: bool = False) -> DataFrame:
    """FOUND rows of the recordings in root and in the folders right below it.

    Folders are rows: one task lists root, then each folder is listed where tasks run, with its sidecars in
    the same visit.  Nothing deeper is ever opened, whatever stands there.
    """
    base = root.removeprefix("file://").removeprefix("file:").rstrip("/") or "/"
    if not os.path.isdir(base):
        raise FileNotFoundError(base)
    fields = [f.name for f in T.StructType.fromDDL(FOUND)]

    def below(frames):
        for frame in frames:
            for folder in frame["folder"]:
                yield pd.DataFrame({"folder": [folder, *(f"{folder}/{x}" for x in sorted(_names(folder)[0]))]})

    def run(frames):
        for frame in frames:
            for folder in frame["folder"]:
                made = read_folder(folder, sidecars)
                for a in range(0, len(made), 1000):
                    yield pd.DataFrame(made[a : a + 1000], columns=fields)

    top = spark.range(1).select(F.lit(base).alias("folder")).mapInPandas(below, "folder string")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return top.repartition(n, "folder").mapInPandas(run, FOUND)


def _numbered(found: DataFrame, known: DataFrame | None) -> DataFrame:
    """found with base, k and out_name: equal output names (a.b and a_b, or one stem in two cameras) get a number, after those
    in known(base, k, out_name); where a recording has that name already, a hash of the path too."""
    named = found.withColumn("base", output_name(F.col("stem"))).withColumn("k", F.row_number().over(Window.partitionBy("base").orderBy("recording")))
    if known is not None:
        named = named.join(known.groupBy("base").agg(F.max("k").alias("so_far")), "base", "left").withColumn("k", F.col("k") + F.coalesce("so_far", F.lit(0))).drop("so_far")
    named = named.withColumn("name", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), F.col("k"))))
    again = F.row_number().over(Window.partitionBy("name").orderBy("k", "recording")) > 1
    named = named.withColumn("again", again)
    if known is not None:
        named = named.join(known.select(F.col("out_name").alias("name"), F.lit(True).alias("theirs")), "name", "left").withColumn("again", F.col("again") | F.coalesce("theirs", F.lit(False))).drop("theirs")
    return named.withColumn("out_name", F.when(F.col("again"), F.concat("name", F.lit("_"), F.md5("recording"))).otherwise(F.col("name"))).drop("name", "again")


REGISTER = "recording string, base string, k int, out_name string"


def read_register(spark: SparkSession, register: str) -> DataFrame | None:
    """The names given so far, or None before the first."""
    try:
        return spark.read.schema(REGISTER).parquet(register)
    except AnalysisException:
        return None


def with_names(found: DataFrame, register: str | None = None, listing: DataFrame | None = None) -> DataFrame:
    """found(recording, stem, ...) with out_name, which no two recordings share.

    Without a register names hold for this listing only.  A register is a table that only grows: who has a name keeps
    it whatever comes later, and new ones are appended before anything uses them.  One run at a time may write to it.
    listing: the same recordings where found is dear to make twice; one that lands in between waits for the next run.
    """
    if register is None:
        return _numbered(found, None).drop("base", "k")
    spark = found.sparkSession
    known = read_register(spark, register)
    path = plain_path("recording")
    names = (found if listing is None else listing).select(path.alias("recording"), "stem").distinct()
    fresh = (names if known is None else names.join(known.select("recording"), "recording", "left_anti")).persist()
    made = _numbered(fresh, known).select("recording", "base", F.col("k").cast("int").alias("k"), "out_name")
    if not fresh.isEmpty():
        made.write.mode("append").parquet(register)  # the committer shows all of them or none
        known = read_register(spark, register)
    fresh.unpersist()
    if known is None:
        return found.withColumn("out_name", F.lit(None).cast("string"))
    return found.withColumn("of", path).join(known.select(F.col("recording").alias("of"), "out_name"), "of").drop("of")


def discover_recordings(spark: SparkSession, root: str, register: str | None = None) -> DataFrame:
    """recording, camera_dir, stem, out_name, sidecar_path, file_size of `.bin` files in root and one level below.

    Names that start with a dot are left out.  Content is never read.
    """
    return with_names(list_recordings(spark, root), register).select("recording", "camera_dir", "stem", "out_name", "sidecar_path", "file_size")


def parse_sidecars(texts: DataFrame, xml: str = "xml") -> DataFrame:
    """texts with the typed fields of its XML column; what is absent or unreadable is null."""
    x = F.from_xml(xml, SIDECAR)
    typed = lambda path, kind: F.col(f"x.{path}").try_cast(kind)
    return texts.withColumn("x", x).select(
        *[c for c in texts.columns],
        typed("Footage.ResolutionX", "int").alias("xml_width"),
        typed("Footage.ResolutionY", "int").alias("xml_height"),
        typed("Footage.NumberOfImages", "bigint").alias("num_images"),
        typed("Footage.Framerate", "double").alias("framerate"),
        typed("Footage.Exposure", "double").alias("exposure_us"),
        typed("Footage.TimeMarkerReference", "bigint").alias("time_marker_reference"),
        F.col("x.Camera.Name").alias("camera_name"),
        typed("SettingsProcessing.Brightness", "double").alias("brightness"),
        typed("SettingsProcessing.Contrast", "double").alias("contrast"),
        typed("SettingsProcessing.Gamma", "double").alias("gamma"),
        F.coalesce(F.col("x.SettingsProcessing").isNotNull(), F.lit(False)).alias("has_processing"),
    )


def resolve_geometry(catalog: DataFrame, width: int | None = None, height: int | None = None, stride: int | None = None) -> DataFrame:
    """width, height, frame_stride, capacity_frames, trailing_bytes: what is asked for, else the sidecar's."""
    w = F.coalesce(F.lit(width).cast("int"), F.when(F.col("xml_width") > 0, F.col("xml_width")))
    h = F.coalesce(F.lit(height).cast("int"), F.when(F.col("xml_height") > 0, F.col("xml_height")))
    out = catalog.withColumn("width", w).withColumn("height", h)
    out = out.withColumn("frame_stride", F.coalesce(F.lit(stride).cast("bigint"), 8 + F.col("width").cast("bigint") * F.col("height")))
    return out.withColumn("capacity_frames", F.expr("file_size div frame_stride")).withColumn("trailing_bytes", F.expr("file_size % frame_stride"))


def resolve_frame_count(catalog: DataFrame, requested: int | None = None, use_capacity: bool = False) -> DataFrame:
    """frames_total: what is asked for, else the sidecar's count, else all there are; never more than there are."""
    stated = F.lit(None).cast("bigint") if use_capacity else F.when(F.col("num_images") > 0, F.col("num_images"))
    asked = F.coalesce(F.lit(requested).cast("bigint"), stated, F.col("capacity_frames"))
    return catalog.withColumn("frames_total", F.least(asked, F.col("capacity_frames")))


def resolve_mode(catalog: DataFrame, mode: str = "reference", brightness=None, contrast=None, gamma=None) -> DataFrame:
    """mode, mode_b, mode_c, mode_g: the curve of each recording; null where reference mode has no settings."""
    if mode not in ("reference", "raw", "linear", "custom"):
        raise ValueError(f"unknown mode {mode}")
    value = lambda own, user, base: F.when(F.col("has_processing"), F.coalesce(F.col(own), F.lit(base))) if mode == "reference" else F.lit(float(base if mode != "custom" or user is None else user))
    g = value("gamma", gamma, 1.0)
    return catalog.withColumns({"mode": F.lit("raw" if mode == "linear" else mode), "mode_b": value("brightness", brightness, 0.0), "mode_c": value("contrast", contrast, 0.0), "mode_g": F.when(g > 0, g).otherwise(F.when(g.isNotNull(), 1.0))})


def resolve(paired: DataFrame, mode: str = "reference", width=None, height=None, stride=None, frames=None, use_capacity=False, brightness=None, contrast=None, gamma=None) -> DataFrame:
    """Geometry, frame counts, curve and status of paired files and sidecars."""
    return with_status(resolve_mode(resolve_frame_count(resolve_geometry(paired, width, height, stride), frames, use_capacity), mode, brightness, contrast, gamma))


def with_status(catalog: DataFrame) -> DataFrame:
    """status: ok, or the first thing that is wrong; other recordings go on."""
    status: Column = (
        F.when(F.col("width").isNull() | F.col("height").isNull(), "unknown geometry")
        .when((F.col("frame_stride") < 8) | F.col("frame_stride").isNull(), "bad stride")
        .when(F.coalesce(F.col("frames_total"), F.lit(0)) <= 0, "no frames")
        .when(F.col("mode_b").isNull(), "no processing settings")
        .otherwise("ok")
    )
    near = lambda c: F.col(c) == VERIFIED[c]
    verified = F.col("has_processing") & near("brightness") & near("contrast") & (F.coalesce(F.col("gamma"), F.lit(1.0)) == 1.0)
    return catalog.withColumn("status", status).withColumn("verified_operating_point", F.coalesce(verified, F.lit(False)))


def pair_sidecars(bins: DataFrame, sidecars: DataFrame, bin_key: str = "sidecar_path", sidecar_key: str = "footage_path") -> DataFrame:
    """bins with the fields of their sidecars, null where there is none; has_processing is false there."""
    paired = bins.join(sidecars, bins[bin_key] == sidecars[sidecar_key], "left")
    return paired.withColumn("has_processing", F.coalesce("has_processing", F.lit(False)))


def recordings(spark: SparkSession, root: str, mode: str = "reference", width=None, height=None, stride=None, frames=None, use_capacity=False, brightness=None, contrast=None, gamma=None, register: str | None = None) -> DataFrame:
    """One row a recording: files, sidecar (if there), geometry, counts, curve and status; names by the register, if one is given."""
    found = with_names(list_recordings(spark, root, sidecars=True), register, list_recordings(spark, root))
    return resolve(parse_sidecars(found).drop("xml", "sidecar_path"), mode, width, height, stride, frames, use_capacity, brightness, contrast, gamma)
