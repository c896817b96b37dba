"""State counts, the five-counter summary and gauge rows.

All three are single-pass aggregations: a partial hash aggregate per task, then a
final one over at most five groups (or one row), so the shuffle carries a handful
of rows per task whatever the table size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passlane import schema as S

SUMMARY_COLUMNS = {
    "pending_payment": S.PENDING_PAYMENT,
    "payment_complete": S.PAID,
    "payment_failed": S.PAYMENT_FAILED,
    "payment_cancelled": S.PAYMENT_CANCELLED,
    "failed_submission": S.SUBMISSION_FAILED,
}


def state_counts(decl: DataFrame) -> DataFrame:
    """Rows per state where a state exists: (state, n)."""
    return (decl.where(F.col("state").isNotNull())
            .groupBy("state").agg(F.count(F.lit(1)).cast("bigint").alias("n")))


def status_summary(decl: DataFrame) -> DataFrame:
    """One row, five counters; absent states count 0, unknown states are ignored."""
    return decl.agg(*[
        F.count_if(F.col("state") == F.lit(state)).cast("bigint").alias(name)
        for name, state in SUMMARY_COLUMNS.items()
    ])


def status_gauges(decl: DataFrame) -> DataFrame:
    """The five counters as (metric, value) rows under the fixed gauge names."""
    summary = status_summary(decl)
    pairs = ", ".join(f"'{S.GAUGE_NAMES[state]}', {name}" for name, state in SUMMARY_COLUMNS.items())
    return summary.selectExpr(f"stack({len(SUMMARY_COLUMNS)}, {pairs}) AS (metric, value)")
