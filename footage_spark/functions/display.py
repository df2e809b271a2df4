"""Display curve and naming as column expressions (nothing here leaves code generation)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ending of image files by format.
EXTENSIONS = {"png": ".Png", "bmp": ".bmp", "tiff": ".tif"}


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("double")


def _line(raw, b, c, floor):
    """The linear part, for columns and for arrays alike."""
    return floor((raw + b) * (1.0 + c / 50.0) + 0.5)


def _bend(level, g, floor):
    """The gamma part of a clamped level, for columns and for arrays alike."""
    return floor(255.0 * (level / 255.0) ** (1.0 / g) + 0.5)


def unclamped(raw: Column, brightness, contrast) -> Column:
    """The curve before clamping; below 0 or above 255 means the pixel is clipped."""
    return _line(raw, _col(brightness), _col(contrast), F.floor)


def display_level(raw: Column, brightness, contrast, gamma) -> Column:
    """Display value 0..255 of a raw value: linear part, clamp, then gamma where it is neither 1 nor below 0."""
    low = F.least(F.greatest(unclamped(raw, brightness, contrast), F.lit(0)), F.lit(255)).cast("double")
    g = _col(gamma)
    return F.when((g != 1.0) & (g > 0.0), _bend(low, g, F.floor)).otherwise(low).cast("int")


def lut(brightness: float, contrast: float, gamma: float) -> bytes:
    """The same curve as 256 bytes, for binary pixels."""
    level = np.clip(_line(np.arange(256.0), brightness, contrast, np.floor), 0, 255)
    bent = _bend(level, gamma, np.floor) if gamma != 1 and gamma > 0 else level
    return bent.astype(np.uint8).tobytes()


def frame_file_name(prefix, index: Column, extension) -> Column:
    """prefix, the index with five digits at least, ending."""
    p = prefix if isinstance(prefix, Column) else F.lit(prefix)
    e = extension if isinstance(extension, Column) else F.lit(extension)
    return F.format_string("%s%05d%s", p, index, e)


def output_name(stem: Column) -> Column:
    return F.replace(stem, F.lit("."), F.lit("_"))


def tick_hex(tick: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.hex(tick), 16, "0"))


def tick_decimal(tick: Column) -> Column:
    """Unsigned value of a tick's 64 bits."""
    d = tick.cast("decimal(20,0)")
    return F.when(tick < 0, d + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(d)


def effective_fps(n: Column, first: Column, last: Column) -> Column:
    span = (last - first).cast("double") / 1e6
    return F.when((n > 1) & (span > 0), F.round((n - 1) / span, 3))


def checksums(content: Column) -> list[Column]:
    return [F.crc32(content).alias("crc32"), F.md5(content).alias("md5"), F.sha2(content, 256).alias("sha256")]
