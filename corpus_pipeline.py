"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again.

classifier -> near-duplicates -> repeated bytes -> source mix -> token ids

Every stage takes nulls in any column, empty and very long texts, ties, repeated rows and an empty
table; all but the last return COLUMNS, and other columns of docs are left out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from footage_spark.llm import bpe, grade_model, mixing, near_copies, suffix_dedup
from footage_spark.llm.queries import rank_path, table
from footage_spark.llm.text import checkpoint_dir, with_row

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark, docs, sf_dir):
    """Documents that the grade model keeps; fitted on the labelled ones among docs.

    Repeated rows stay or go together.  Without labels nothing can be told and all rows stay.
    """
    model = grade_model.train(docs, table(spark, sf_dir, "labels"))
    return grade_model.grade(docs, model).where("kept").select(*COLUMNS)


def drop_near_copies(spark, docs, sf_dir):
    """One row of each group of near copies (Jaccard 0.8 of five-word shingles): the one with the smallest doc_id.

    Candidates are the links of SimHash (op6's ball hashing, on fingerprints of five-word shingles) and, for the pairs
    that are more than its 4 bits apart, those of MinHash keys; each is confirmed by the exact similarity.
    A row with a null doc_id stays only where its group has no other (of several such the first by a hash of
    its columns, in every run); of equal rows one stays.
    Texts without words, null ones too, are one group.
    """
    docs = with_row(docs, COLUMNS)
    return docs.join(near_copies.first_of_groups(docs), "row", "left_semi").select(*COLUMNS)


def cut_repeats(spark, docs, sf_dir):
    """Texts without the bytes that an earlier document has; n_chars follows, empty texts go on.

    A row with a null doc_id has no rank: it loses and takes nothing.  A null text stays null.
    """
    return suffix_dedup.dedup_texts(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark, docs, sf_dir):
    """Each row as often as the mix takes it; copies are rows with the same doc_id.

    Rows are mixed one by one, those with a null or repeated doc_id too.  Rows without words are not taken.
    """
    docs = with_row(docs, COLUMNS)
    taken = mixing.mix_sources(docs, row="row").where("copies > 0").select("row", "copies")
    return docs.join(taken, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def tokenize(spark, docs, sf_dir):
    """Documents with their token ids (little-endian unsigned 32-bit integers) and the count of them; a null text has none."""
    return bpe.encode(docs, rank_path()).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


STAGES = [("classifier", keep_good), ("near_duplicates", drop_near_copies), ("repeated_bytes", cut_repeats), ("source_mix", mix), ("token_ids", tokenize)]

#: The stages are not plain SQL (a fitted model, hashing to links, rounding by hash, merges by rank).
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages from documents; each one's rows are written to the shared folder and read again."""
    import uuid

    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
