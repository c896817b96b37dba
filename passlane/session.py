"""Spark session helpers.

The library never creates its own session inside an operator; callers pass one in.
``build_session`` is for tests, the bench and local runs. On a cluster the
platform's session is used as is, and only settings that are unset get a default.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on. Timestamps in the driver tables are wall-clock
# values (TIMESTAMP_NTZ); pinning UTC keeps any zone-aware conversion stable.
CORE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Work lists and lock tables are joined by key; a side is broadcast only when
    # the planner's size estimate is under this bound (10 MiB, Spark's default).
    "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "passlane") -> SparkSession:
    """Local session for tests and the bench (UI off, AQE on, UTC)."""
    builder = (
        SparkSession.builder.master(master or "local[*]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("PASSLANE_DRIVER_MEMORY", "8g"))
    )
    for k, v in CORE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


# Settings that change plans but never results: safe to set on a caller's session.
PLAN_CONF = {k: v for k, v in CORE_CONF.items()
             if k.startswith("spark.sql.adaptive") or k == "spark.sql.parquet.filterPushdown"}


def apply_core_conf(spark: SparkSession) -> SparkSession:
    """Set the plan-only settings (AQE, skew join, pushdown) on an existing session.

    Results never depend on the session time zone: driver timestamps are
    TIMESTAMP_NTZ and every ``as_of`` literal is built from text."""
    for k, v in PLAN_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on a shared session: leave it
            pass
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint directory.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as is; without
    one, executors would each write to their own disk, so that is an error. Only a local
    session (tests) gets a fresh scratch folder.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    master = spark.sparkContext.master
    if not current and master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not current:
        current = tempfile.mkdtemp(prefix="passlane-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current
