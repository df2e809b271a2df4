"""Comparison of two sets of frames (or of any keyed content)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frame_fingerprint(frames: DataFrame, column: str = "pixels") -> DataFrame:
    from ..functions.display import checksums

    return frames.select("*", *checksums(F.col(column)))


def compare_content(ref: DataFrame, out: DataFrame, key: str, content: str, order: str | None = None) -> DataFrame:
    """key, order_value, outcome (equal, mismatch, only_ref, only_out); contents meet as SHA-256, not as bytes.

    Null content on either side is a mismatch.
    """
    side = lambda df, n: df.select(F.col(key).alias("key"), F.sha2(F.col(content), 256).alias(f"d_{n}"), F.col(order or key).alias(f"o_{n}"), F.lit(True).alias(f"in_{n}"))
    both = side(ref, "ref").join(side(out, "out"), "key", "full_outer")
    outcome = F.when(F.col("in_out").isNull(), "only_ref").when(F.col("in_ref").isNull(), "only_out").when(F.coalesce(F.col("d_ref") == F.col("d_out"), F.lit(False)), "equal").otherwise("mismatch")
    return both.select("key", F.coalesce("o_ref", "o_out").alias("order_value"), outcome.alias("outcome"))


def verify_report(detail: DataFrame, subset: bool = False) -> DataFrame:
    """One row: counts, the name verdict, the first bad key in order, and whether all passes."""
    n = lambda *kinds: F.count_if(F.col("outcome").isin(*kinds))
    got = detail.agg(
        n("equal", "mismatch", "only_ref").alias("files_ref"), n("equal", "mismatch", "only_out").alias("files_out"), n("equal", "mismatch").alias("compared"), n("mismatch").alias("mismatched"), n("only_ref").alias("only_ref"), n("only_out").alias("only_out"),
        F.min_by("key", F.when(F.col("outcome") == "mismatch", F.col("order_value"))).alias("first_mismatch"),
    )
    names = F.when((F.col("only_ref") == 0) & (F.col("only_out") == 0), "EQUAL").when(F.col("only_out") == 0, "SUBSET-OK").otherwise("DIFFER")
    fine = (F.col("names") == "EQUAL") | ((F.col("names") == "SUBSET-OK") & F.lit(subset))
    return got.withColumn("names", names).withColumn("passed", (F.col("mismatched") == 0) & fine & (F.col("files_out") > 0))


def first_mismatches(detail: DataFrame, k: int = 10) -> DataFrame:
    """The k first mismatches (top k is the feature here)."""
    return detail.where("outcome = 'mismatch'").orderBy("order_value").limit(k)


def name_set_compare(ref: DataFrame, out: DataFrame, key: str = "file_name") -> DataFrame:
    """only_ref, only_out, verdict of two name sets."""
    a, b = ref.select(F.col(key).alias("key")).distinct(), out.select(F.col(key).alias("key")).distinct()
    counts = a.join(b, "key", "left_anti").agg(F.count(F.lit(1)).alias("only_ref")).crossJoin(b.join(a, "key", "left_anti").agg(F.count(F.lit(1)).alias("only_out")))  # one row each
    return counts.withColumn("verdict", F.when((F.col("only_ref") == 0) & (F.col("only_out") == 0), "EQUAL").when(F.col("only_out") == 0, "SUBSET-OK").otherwise("DIFFER"))


def fingerprint_set_equal(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """only_a, only_b, equal: checksums as multisets, in any order."""
    x, y = a.select(F.md5(column).alias("md5")), b.select(F.md5(column).alias("md5"))
    left = x.exceptAll(y).agg(F.count(F.lit(1)).alias("only_a"))
    right = y.exceptAll(x).agg(F.count(F.lit(1)).alias("only_b"))
    return left.crossJoin(right).withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))  # one row each


def verify_images(ref: DataFrame, out: DataFrame, subset: bool = False) -> tuple[DataFrame, DataFrame]:
    """(detail, report) of two tables of images(file_name, frame_index, image)."""
    from .images import read_gray_images

    prepare = lambda df: read_gray_images(df).withColumn("content", F.when(F.col("error").isNull(), F.concat(F.encode(F.format_string("%d,%d,", "width", "height"), "UTF-8"), "gray")))
    detail = compare_content(prepare(ref), prepare(out), "file_name", "content", "frame_index")
    return detail, verify_report(detail, subset)
