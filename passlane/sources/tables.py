"""Readers for the driver's parquet tables and for the library's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from passlane import schema as S

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


class DriverTables:
    """Lazy accessors for ``{sf_dir}/{name}.parquet``.

    Each access is a fresh scan, so Catalyst prunes columns and pushes filters into
    the parquet reader for whatever the caller selects.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in DRIVER_TABLES:
            return self.table(name)
        raise AttributeError(name)


def read_declarations(spark: SparkSession, path: str) -> DataFrame:
    """Scan a stored declarations table with its declared schema (no inference)."""
    return spark.read.schema(S.STORED_DECLARATIONS).parquet(path)


def read_declaration_keys(spark: SparkSession, path: str) -> DataFrame:
    """Scan a stored declarations table that has no document columns."""
    fields = [f for f in S.STORED_DECLARATIONS.fields if f.name not in S.DOCUMENT_COLUMNS]
    return spark.read.schema(StructType(fields)).parquet(path)


def read_locks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.LOCKS).parquet(path)


def read_submissions_text(spark: SparkSession, path: str) -> DataFrame:
    """Raw submission bodies, one JSON document per line, kept as text."""
    return spark.read.text(path).withColumnRenamed("value", "raw")
