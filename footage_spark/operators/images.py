"""Image files of frames: encoding to PNG, BMP and TIFF, listing, and PNG decoding."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.display import EXTENSIONS, frame_file_name
from .pixels import CURVE, LAYOUTS, _with_column, column_batches, expand, mapped_pixels, pieces, small_batches

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Pixels a metre (96 dpi) and gamma that files carry.
PIXELS_A_METRE, GAMMA = 3779, 45455


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _zlib(raw: bytes, level: int, strategy: int = zlib.Z_DEFAULT_STRATEGY) -> bytes:
    """A zlib stream with the header 78 5E that files state, whatever the level."""
    pack = zlib.compressobj(level, zlib.DEFLATED, -15, 9, strategy)
    return b"\x78\x5e" + pack.compress(raw) + pack.flush() + struct.pack(">I", zlib.adler32(raw))


#: A frame whose runs alone pack to less than this share of it is packed by matches too, and the smaller is kept.
PLAIN_SHARE = 1 / 16


def _packed(rows: np.ndarray, layout: str, level: int) -> bytes:
    """Filtered rows as a zlib stream.

    Differences of neighbours in sensor noise have few matches but short codes: gray frames are packed by runs
    and codes alone.  Other layouts repeat each difference, so they need matches, and at one level less they are as small as
    unfiltered rows.
    """
    raw = rows.tobytes()
    if layout != "gray8" or not level:
        return _zlib(raw, level if level in (0, 1) or level > 6 else level - 1)
    runs = _zlib(raw, level, zlib.Z_RLE)
    if level <= 6 and len(runs) > PLAIN_SHARE * len(raw):
        return runs
    return min(runs, _zlib(raw, level), key=len)


def png(gray: bytes, width: int, height: int, layout: str = "gray8", level: int = 6) -> bytes:
    """A PNG whose rows hold each pixel's difference to the one before (row filter 1; level 0: as they are)."""
    size = LAYOUTS[layout]
    samples = np.frombuffer(expand(gray, layout), np.uint8).reshape(height, width * size)
    rows = np.zeros((height, 1 + width * size), np.uint8)
    rows[:, 1:] = samples
    if level:
        rows[:, 0] = 1
        rows[:, 1 + size :] -= samples[:, :-size]
    head = struct.pack(">IIBBBBB", width, height, 16 if layout.endswith("16") else 8, 6 if layout.startswith("rgba") else 0, 0, 0, 0)
    body = [(b"IHDR", head), (b"sRGB", b"\0"), (b"gAMA", struct.pack(">I", GAMMA)), (b"pHYs", struct.pack(">IIB", PIXELS_A_METRE, PIXELS_A_METRE, 1)), (b"IDAT", _packed(rows, layout, level)), (b"IEND", b"")]
    return SIGNATURE + b"".join(_chunk(*x) for x in body)


def bmp(gray: bytes, width: int, height: int) -> bytes:
    """8-bit gray palette, bottom row first, rows padded to four bytes."""
    pad = -width % 4
    rows = np.zeros((height, width + pad), np.uint8)
    rows[:, :width] = np.frombuffer(gray, np.uint8).reshape(height, width)[::-1]
    palette = np.zeros((256, 4), np.uint8)
    palette[:, :3] = np.arange(256)[:, None]
    at = 14 + 40 + 1024
    return struct.pack("<2sIHHI", b"BM", at + rows.size, 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.size, PIXELS_A_METRE, PIXELS_A_METRE, 256, 0) + palette.tobytes() + rows.tobytes()


def tiff(gray: bytes, width: int, height: int) -> bytes:
    """Baseline, little-endian, one uncompressed gray strip."""
    tags = [(256, 4, width), (257, 4, height), (258, 3, 8), (259, 3, 1), (262, 3, 1), (273, 4, 8 + 2 + 12 * 10 + 4), (277, 3, 1), (278, 4, height), (279, 4, len(gray)), (296, 3, 1)]
    return struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + struct.pack("<I", 0) + gray


def encoded_batches(fmt: str, layout: str, level: int, column: str, keep: list[str]):
    """Batches of frames -> batches of the columns `keep` and `image`."""
    if fmt not in EXTENSIONS or layout not in LAYOUTS:
        raise ValueError(f"unknown format {fmt} or layout {layout}")
    level = min(max(level, 0), 9)

    def make(batch):
        for gray, w, h in zip(*(batch.column(c).to_pylist() for c in (column, "width", "height")), strict=True):
            yield None if gray is None else png(gray, w, h, layout, level) if fmt == "png" else bmp(gray, w, h) if fmt == "bmp" else tiff(gray, w, h)

    return column_batches(keep, "image", make)


def name_images(images: DataFrame, fmt: str, prefix: str) -> DataFrame:
    """images(recording, frame_index, image) with file_name and format, and tick and out_name where they have them."""
    named = [c for c in ("tick", "out_name") if c in images.columns]
    return images.select("recording", "frame_index", *named, frame_file_name(prefix, F.col("frame_index"), EXTENSIONS[fmt]).alias("file_name"), F.lit(fmt).alias("format"), "image")


def encode_frames(frames: DataFrame, fmt: str = "png", layout: str = "gray8", level: int = 6, prefix: str = "cam_", column: str = "mapped") -> DataFrame:
    """recording, frame_index, file_name, format, image, and tick and out_name where frames have them.

    BMP and TIFF hold 8-bit gray, whatever the layout asked for.
    """
    keep = _kept(frames)
    return _encoded(frames.select(*keep, "width", "height", column), encoded_batches(fmt, layout, level, column, keep), keep, fmt, prefix)


def encode_mapped(frames: DataFrame, fmt: str = "png", layout: str = "gray8", level: int = 6, prefix: str = "cam_") -> DataFrame:
    """encode_frames(apply_display_transform(frames)) in one pass of a worker, which a task then has in place of two."""
    keep = _kept(frames)
    mapped = column_batches([*keep, "width", "height"], "mapped", mapped_pixels)
    encoded = encoded_batches(fmt, layout, level, "mapped", keep)
    return _encoded(frames.select(*keep, "width", "height", "pixels", *CURVE), lambda batches: encoded(mapped(batches)), keep, fmt, prefix)


def _kept(frames: DataFrame) -> list[str]:
    return ["recording", "frame_index", *(c for c in ("tick", "out_name") if c in frames.columns)]


def _encoded(frames: DataFrame, run, keep: list[str], fmt: str, prefix: str) -> DataFrame:
    small_batches(frames.sparkSession)
    schema = T.StructType([*frames.select(*keep).schema, T.StructField("image", T.BinaryType())])
    return name_images(frames.mapInArrow(run, schema), fmt, prefix)


def list_frame_images(spark: SparkSession, root: str, prefix: str = "cam_", extension: str = ".Png") -> DataFrame:
    """source, file_name, frame_index, image of files named prefix, digits, ending, and no others."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{extension}").load(root)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return named_frames(files.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("source"), name.alias("file_name"), F.col("content").alias("image")), prefix, extension)


def named_frames(files: DataFrame, prefix: str, extension: str) -> DataFrame:
    pattern = f"^{re.escape(prefix)}([0-9]+){re.escape(extension)}$"
    return files.where(F.col("file_name").rlike(pattern)).withColumn("frame_index", F.regexp_extract("file_name", pattern, 1).cast("long"))


#: Samples a pixel by PNG colour type.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def decode_png(raw: bytes) -> tuple[int, int, int, int, bytes]:
    """width, height, bit depth, colour type, samples; raises ValueError on a broken file."""
    if raw[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, data, ended = 8, None, [], False
    while at + 12 <= len(raw) and not ended:
        (n,) = struct.unpack_from(">I", raw, at)
        kind, body = raw[at + 4 : at + 8], raw[at + 8 : at + 8 + n]
        if len(body) < n or struct.unpack(">I", raw[at + 8 + n : at + 12 + n].rjust(4, b"\0"))[0] != zlib.crc32(kind + body):
            raise ValueError("bad chunk")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended:
        raise ValueError("incomplete PNG")
    width, height, depth, colour, _, _, interlace = head
    if depth not in (8, 16) or colour not in CHANNELS or interlace:
        raise ValueError("unsupported PNG")
    step = CHANNELS[colour] * depth // 8
    try:
        flat = zlib.decompress(b"".join(data))
    except zlib.error as e:
        raise ValueError("bad deflate stream") from e
    if len(flat) != height * (1 + width * step):
        raise ValueError("wrong size")
    rows = np.frombuffer(flat, np.uint8).reshape(height, 1 + width * step)
    if (rows[:, 0] <= 1).all():  # no row needs the one above: all at once
        out, sums = rows[:, 1:].copy(), rows[:, 0] == 1
        out[sums] = np.cumsum(out[sums].reshape(-1, width, step), axis=1, dtype=np.uint8).reshape(-1, width * step)
        return width, height, depth, colour, out.tobytes()
    out, above = np.zeros((height, width * step), np.uint8), np.zeros(width * step, np.uint8)
    for y in range(height):
        above = out[y] = _unfilter(int(rows[y, 0]), rows[y, 1:], above, step)
    return width, height, depth, colour, out.tobytes()


def _unfilter(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 2:
        return row + above
    if kind == 1:  # running sums of each sample byte
        return np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint64).astype(np.uint8).ravel()
    if kind not in (3, 4):
        raise ValueError("bad row filter")
    pixels, up = row.reshape(-1, step).astype(int).tolist(), above.reshape(-1, step).astype(int).tolist()
    left, corner, out = [0] * step, [0] * step, []
    for here, over in zip(pixels, up, strict=True):
        now = []
        for v, a, b, c in zip(here, left, over, corner, strict=True):
            if kind == 3:
                guess = (a + b) // 2
            else:
                guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            now.append((v + guess) & 255)
        out += now
        left, corner = now, over
    return np.array(out, np.uint8)


def to_gray8(samples: bytes, depth: int, colour: int) -> bytes:
    """First byte of each pixel: gray is R, and the upper byte of a 16-bit sample is the 8-bit value."""
    return samples[:: CHANNELS[colour] * depth // 8]


#: What reading gives of each image.
DECODED = "width int, height int, bit_depth int, color_type int, pixels binary, error string"


def _decoded(image: bytes | None) -> tuple:
    try:
        return (*decode_png(image or b""), None)
    except ValueError as e:
        return (None,) * 5 + (str(e),)


def decoded_batches(keep: list[str]):
    """Batches of images -> batches of the columns `keep` and DECODED; images pack to a thousandth, so one batch may give many."""
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())
    names = [*keep, *T.StructType.fromDDL(DECODED).names]

    def run(batches):
        for batch in batches:
            for first, made in pieces(map(_decoded, batch.column("image").to_pylist()), lambda row: len(row[4] or b"")):
                part = batch.slice(first, len(made))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True))], names=names)

    return run


def _read(images: DataFrame, fields: str, then=None) -> DataFrame:
    """images(..., image) with DECODED, and what `then` makes of it in the same pass; fields: the new columns."""
    small_batches(images.sparkSession)
    keep = [c for c in images.columns if c not in ("image", *T.StructType.fromDDL(DECODED + ", gray binary").names)]
    schema = T.StructType([*images.select(*keep).schema, *T.StructType.fromDDL(fields)])
    decoded = decoded_batches(keep)
    return images.select(*keep, "image").mapInArrow(decoded if then is None else lambda batches: then(keep)(decoded(batches)), schema)


def read_frame_images(images: DataFrame) -> DataFrame:
    """images(..., image) with width, height, bit_depth, color_type, pixels, error; a bad file has an error and no pixels."""
    return _read(images, DECODED)


def gray_values(batch):
    """The 8-bit gray values of a batch's pixels."""
    for p, d, c in zip(*(batch.column(x).to_pylist() for x in ("pixels", "bit_depth", "color_type")), strict=True):
        yield None if p is None else to_gray8(p, d, c)


def canonical(decoded: DataFrame) -> DataFrame:
    """decoded with `gray` (8-bit) in place of pixels, so that layouts compare."""
    return _with_column(decoded, "gray", gray_values).drop("pixels")


def read_gray_images(images: DataFrame) -> DataFrame:
    """canonical(read_frame_images(images)) in one pass of a worker: wide samples never leave it."""
    fields = DECODED.replace("pixels binary, ", "")
    names = T.StructType.fromDDL(fields).names
    return _read(images, f"{fields}, gray binary", lambda keep: column_batches([*keep, *names], "gray", gray_values))
