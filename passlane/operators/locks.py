"""The lock table as data: expiry predicates and set joins against work lists.

A lock row ``(lock_id, last_updated, last_updated_date)`` holds one key. Rows with a
``last_updated_date`` expire ``ttl`` seconds after it; legacy rows without that
date never expire by TTL and are removed by the legacy sweep instead.

Joins: work lists are filtered with ``left_anti`` on the integer key. Spark picks a
broadcast hash join when the planner's size estimate of the lock side is under
``spark.sql.autoBroadcastJoinThreshold`` (a checked bound), else a shuffle join;
AQE can switch at run time with real sizes. Nothing is broadcast unconditionally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passlane import schema as S
from passlane.operators.worklists import _ts, minus_seconds


def live_locks(locks: DataFrame, as_of, ttl_seconds: int = S.LOCK_TTL_SECONDS) -> DataFrame:
    """Locks not yet expired at ``as_of``."""
    return locks.where(F.col("last_updated_date").isNull()
                       | (F.col("last_updated_date") > minus_seconds(as_of, ttl_seconds)))


def legacy_locks(locks: DataFrame, as_of, ttl_seconds: int = S.LOCK_TTL_SECONDS) -> DataFrame:
    """Legacy rows (no date) older than the TTL: the ones the legacy sweep removes."""
    return locks.where(is_swept(as_of, ttl_seconds))


def has_expired(as_of, ttl_seconds: int = S.LOCK_TTL_SECONDS) -> Column:
    """True for a lock whose life has ended (TTL on its date)."""
    return F.col("last_updated_date").isNotNull() & (F.col("last_updated_date") <= minus_seconds(as_of, ttl_seconds))


def is_swept(as_of, ttl_seconds: int = S.LOCK_TTL_SECONDS) -> Column:
    """True for a legacy lock (no date) that the legacy sweep removes."""
    return F.col("last_updated_date").isNull() & (F.col("last_updated") < minus_seconds(as_of, ttl_seconds))


def expire_locks(locks: DataFrame, as_of, ttl_seconds: int = S.LOCK_TTL_SECONDS) -> DataFrame:
    """The lock table after TTL expiry and the legacy sweep."""
    return locks.where(~(has_expired(as_of, ttl_seconds) | is_swept(as_of, ttl_seconds)))


def exclude_locked(rows: DataFrame, locks: DataFrame, as_of, key: str = "ref_value",
                   ttl_seconds: int = S.LOCK_TTL_SECONDS) -> DataFrame:
    """Rows whose key holds no live lock.

    An outer join and not an anti join, which the optimizer would move below what was made of the
    rows' documents, so that documents would be shuffled."""
    held = live_locks(locks, as_of, ttl_seconds).select(F.col("lock_id").alias("__lock_key"))
    return (rows.join(held, rows[key] == held["__lock_key"], "left")
            .where(F.col("__lock_key").isNull()).drop("__lock_key"))


def acquire_locks(rows: DataFrame, locks: DataFrame, as_of, key: str = "ref_value",
                  ttl_seconds: int = S.LOCK_TTL_SECONDS) -> DataFrame:
    """New lock rows a batch takes: one per free key, stamped ``as_of``.

    The first insert of a key wins; a batch holding the same key twice gets one lock.
    """
    free = exclude_locked(rows.select(F.col(key).alias("lock_id")).dropDuplicates(["lock_id"]),
                          locks, as_of, key="lock_id", ttl_seconds=ttl_seconds)
    stamp = _ts(as_of)
    return free.select(F.col("lock_id").cast("int"), stamp.alias("last_updated"),
                       stamp.alias("last_updated_date"))


def release_locks(locks: DataFrame, keys: DataFrame, key: str = "ref_value") -> DataFrame:
    """The lock table without the given keys; a key with no lock is not an error."""
    k = keys.select(F.col(key).alias("__release_key"))
    return locks.join(k, locks["lock_id"] == k["__release_key"], "left_anti")

