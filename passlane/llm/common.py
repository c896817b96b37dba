"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passlane.session import ensure_checkpoint_dir

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Rows of an Arrow batch; a worker holds a few batches of whole texts at a time.
BATCH_ROWS = 500


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, and bound their Arrow batches.

    Nothing is done where PYTHONPATH or the working folder already leads to it; else the
    package goes to the executors as a zip through Spark's own file distribution.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    paths = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if any(p and os.path.isdir(os.path.join(p, "passlane", "llm")) for p in paths):
        return
    sc = spark.sparkContext
    if not getattr(sc, "_passlane_shipped", False):
        base = os.path.join(tempfile.mkdtemp(prefix="passlane-code-"), "passlane_code")
        sc.addPyFile(shutil.make_archive(base, "zip", _ROOT, "passlane"))
        sc._passlane_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    The files survive lost executors and end the lineage; Spark removes them when the
    frame is no longer referenced and its checkpoint cleaner is on.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if(df: DataFrame, size: Column, most_bytes: int = 8 << 20) -> DataFrame:
    """``df``, stored by the caller, marked for a broadcast if its ``size`` (bytes of a row) sums
    up to ``most_bytes`` at most; a larger one is joined by a shuffle."""
    total = df.agg(F.sum(size + 64)).first()[0] or 0
    return F.broadcast(df) if total <= most_bytes else df


def md5_of(text: Column) -> Column:
    """128-bit content hash as 16 bytes; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def number_rows(df: DataFrame, by: list[str], order: list[str], out: str,
                rows_per_slice: int = 50_000) -> DataFrame:
    """Add ``out``: 0, 1, 2 ... without gaps inside each value of ``by``.

    A value of ``by`` may hold most rows, so each is dealt over slices by a hash of
    ``order``; only the counts of the slices are brought together (one row for each value
    and slice), and rows are numbered inside their slice. ``order`` should identify rows;
    rows equal in it are interchangeable. ``df`` is read twice and should be stored.
    """
    most = df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    slices = -(-most // rows_per_slice) or 1
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (sliced.groupBy(*by, "_slice").count()
               .select(*[F.col(c).alias(f"_o_{c}") for c in by], F.col("_slice").alias("_o_slice"),
                       F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset")))
    inside = Window.partitionBy(*by, "_slice").orderBy(*order)
    numbered = sliced.withColumn("_in", F.row_number().over(inside) - 1)
    on = [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in by] + [F.col("_slice") == F.col("_o_slice")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return (numbered.join(offsets, cond)
            .withColumn(out, (F.col("_offset") + F.col("_in")).cast("long"))
            .drop("_slice", "_in", "_offset", "_o_slice", *[f"_o_{c}" for c in by]))
