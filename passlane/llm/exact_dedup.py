"""Exact deduplication by 128-bit content hash, with the bytes compared (DataFrame only).

Texts are equal when identical after deleting the six ASCII white-space characters; null
counts as empty. Rows are grouped by the MD5 of the normalised text *and* the normalised
text itself, so the aggregate compares bytes inside every hash group and two texts with
one hash form two classes. Copies collapse before the shuffle (partial aggregation), so a
text that holds a third of the rows leaves one row for each task.

Defined results: null or empty text is one class of its own; of equal rows the one with the
most code points stays, then the smallest doc_id (null last); an empty table gives no rows;
further columns are carried by ``drop_copies`` and ignored by ``copies``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passlane.llm.common import md5_of

#: Fixed value: the characters that do not count.
BLANKS = " \t\n\x0b\f\r"


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _with_keys(docs: DataFrame, hash_of: Callable[[Column], Column]) -> DataFrame:
    norm = normalised(F.col("text"))
    return docs.select(
        "doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("_n"),
        norm.alias("_norm"), hash_of(norm).alias("_hash"), F.sha2(norm, 256).alias("_sha"))


def copies(docs: DataFrame, hash_of: Callable[[Column], Column] = md5_of) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    A class is named by its hash and SHA-256. If the byte comparison finds two different
    texts with one such name, the job fails rather than merge them. Rows that agree in
    doc_id and text are one document twice: both carry the same answer.
    """
    rows = _with_keys(docs.select("doc_id", "text"), hash_of)
    best = F.max(F.struct(F.col("_n"), F.bitwise_not("doc_id").alias("neg"))).alias("best")
    classes = rows.groupBy("_hash", "_sha", "_norm").agg(F.count("*").alias("n"), best)
    named = classes.groupBy("_hash", "_sha").agg(
        F.count("*").alias("k"), F.max("n").alias("n"), F.max("best").alias("best")).select(
        F.col("_hash").alias("c_hash"), F.col("_sha").alias("c_sha"),
        F.when(F.col("k") == 1, F.col("n")).otherwise(
            F.raise_error(F.lit("two texts share both hashes"))).alias("group_size"),
        F.bitwise_not("best.neg").alias("keep_id"))
    return (rows.drop("_norm")
            .join(named, (F.col("_hash") == F.col("c_hash")) & (F.col("_sha") == F.col("c_sha")))
            .select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
                    F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    F.col("_sha").alias("text_sha256")))


def drop_copies(docs: DataFrame, hash_of: Callable[[Column], Column] = md5_of) -> DataFrame:
    """``docs`` with exactly one row for each class of equal texts, all columns kept."""
    norm = normalised(F.col("text"))
    plain = [c for c, t in docs.dtypes if not ("map<" in t or "variant" in t or "interval" in t)]
    order = F.struct(F.length(F.coalesce("text", F.lit(""))), F.bitwise_not("doc_id"),
                     F.xxhash64(*[F.col(f"`{c}`") for c in plain]))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return (docs.groupBy(hash_of(norm).alias("_hash"), norm.alias("_norm"))
            .agg(F.max_by(row, order).alias("_row")).select("_row.*"))
