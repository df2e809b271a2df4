"""Shared vector helpers over Arrow text columns.

Texts are read as UTF-8 bytes without making Python strings: a batch gives one byte array
and the offsets of its rows.  A null text counts as empty everywhere.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

#: The characters that end a word (space and \x09-\x0D).
WHITE_SPACE = np.zeros(256, bool)
WHITE_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_CODE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []

#: Bytes of text that the vector code holds at a time; one longer text is handled alone.
CHUNK_BYTES = 1 << 20
#: Most bytes of an Arrow batch that goes to a worker; one longer row is a batch of its own.
BATCH_BYTES = 1 << 22


def rows(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    text = column.cast(pa.large_binary())
    _, offsets, data = text.buffers()
    n = len(text)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64, count=n + 1, offset=8 * text.offset)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if text.null_count:
        lengths = np.where(np.asarray(text.is_valid()), np.diff(at), 0)
        if lengths.sum() != at[-1] - at[0]:
            body = np.concatenate([body[a : a + m] for a, m in zip(at[:-1], lengths, strict=True)] or [body[:0]])
            return body, np.concatenate([[0], np.cumsum(lengths)])
    return body[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Yield (first, last) row ranges of about `limit` bytes."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64."""
    if _powers and len(_powers[0]) > n:
        return _powers[0], _powers[1]
    size = 1 << max(16, int(n).bit_length())
    made = []
    for base in (_BASE, _BASE_INVERSE):
        out = np.full(size, base, np.uint64)
        out[0] = 1
        made.append(np.multiply.accumulate(out, out=out))
    if size <= 2 * CHUNK_BYTES:  # those of one very long text are not kept
        _powers[:] = made
    return made[0], made[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running hash of a byte array; see span_hash."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings [start, end), equal for equal strings anywhere."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words of every row; words end at a row's end."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~WHITE_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def by_row(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Sum of values by row."""
    return np.bincount(row, weights=values, minlength=n)


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ragged rows of these lengths: the row of each element and its place in the row."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def checkpoint_dir(spark) -> str:
    """The shared folder that the cluster names; a new one under /tmp only in local mode, where none is set (tests)."""
    import tempfile

    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            named = current.get()
        elif spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df):
    """Cut the lineage by an eager checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(True)


def small_batches(df):
    """df, whose rows go to Python workers in batches of BATCH_BYTES at most.

    A worker's memory follows the bytes of a batch.  The session's setting is lowered where it is
    higher; it holds for the whole session and changes no result.
    """
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    return df


def tidy(run):
    """run, for mapInArrow, that gives freed memory back to the system at the end of a partition.

    Workers are used again for other stages, and wait beside those that work.
    """

    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return tidied


def with_row(df, columns=None):
    """The table (or the columns named) with a text of its own for each row (column row), the same in every pass.

    It begins with a hash of the row's columns, so that rows which differ come in the same order in every run, wherever
    they are stored; equal rows are told apart by file and place.  Tables that are not read straight from
    files are numbered and kept in the shared folder, as numbers would change with the partitions.  A column row that is there
    already is replaced.
    """
    from pyspark.errors import AnalysisException
    from pyspark.sql import functions as F

    columns = [c for c in (df.columns if columns is None else columns) if c != "row"]
    digits = lambda *x: F.lpad(F.hex(F.xxhash64(*x)), 16, "0")
    content = digits(*(F.col(c) for c in columns))
    try:
        return df.select(*columns, F.concat(content, digits("_metadata.file_path", "_metadata.row_index")).alias("row"))
    except AnalysisException:  # not read straight from files
        return cut(df.select(*columns, F.concat(content, digits(F.monotonically_increasing_id())).alias("row")))


def number_equals(df, key: str, name: str):
    """df, read back from a checkpoint, with a number (column name) from 1 among the rows of equal key.

    Rows of a key are numbered within their partition, and the counts of the partitions before are added: no
    task holds more of one key than a partition does.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    parts = df.withColumn("__part", F.spark_partition_id()).withColumn("__in", F.row_number().over(Window.partitionBy(key, "__part").orderBy(key)))
    counts = parts.groupBy(key, "__part").agg(F.max("__in").alias("__n"))
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return parts.join(offsets, [key, "__part"]).select(*df.columns, (F.col("__before") + F.col("__in")).alias(name))


def join_hot(big, small, keys, most: int = 10_000):
    """Inner join of big with small(keys, ...), whose keys are unique, that no key of big can make lopsided.

    Keys with a most-th of big's rows or more (so `most` of them at the utmost) are sent to every task; the
    rest meet in a shuffle.  big is read three times: cut it before.
    """
    from pyspark.sql import functions as F

    least = max(big.count() / most, 1000)  # under 1000 rows of one key no task suffers
    hot = cut(big.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).select(*keys))
    if hot.isEmpty():
        return big.join(small, keys)
    cold = big.join(F.broadcast(hot), keys, "left_anti").join(small, keys)
    return cold.unionByName(big.join(F.broadcast(small.join(F.broadcast(hot), keys, "left_semi")), keys))
