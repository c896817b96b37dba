"""Domain inputs of one scale-factor directory.

The stand-in domain tables are derived from the driver tables by Spark
(``passlane.sources.bridge``) and stored once as parquet under the session's
checkpoint directory (a shared folder on a cluster), then read by every query,
the way a deployment reads its declarations table. The declarations table is
partitioned by ``state`` so work-list predicates prune whole directories.
Set ``PASSLANE_TABLE_CACHE=0`` to derive them in-plan on every query instead.
"""

from __future__ import annotations

import datetime as _dt
import hashlib
import os
import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from passlane.operators.worklists import with_receipt_at
from passlane.session import apply_core_conf, ensure_checkpoint_dir
from passlane.sources import bridge
from passlane.sources.tables import DriverTables, read_declaration_keys, read_declarations, read_locks

AS_OF = bridge.AS_OF
# Bump when a bridge formula changes so stored tables are derived again.
BRIDGE_VERSION = "11"

_PARTITION_BY = {"declarations": ["state"], "declaration_keys": ["state"]}


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


class Inputs:
    """Domain DataFrames for ``sf_dir`` (stored once, read lazily)."""

    def __init__(self, spark: SparkSession, sf_dir: str, as_of: _dt.datetime = AS_OF,
                 store: bool | None = None):
        self.spark = apply_core_conf(spark)
        self.sf_dir = sf_dir.rstrip("/")
        self.as_of = as_of
        self.tables = DriverTables(spark, sf_dir)
        self.store = (os.environ.get("PASSLANE_TABLE_CACHE", "1") != "0") if store is None else store

    def _fingerprint(self) -> str:
        """Names, sizes and times of the source files, so that changed input gets new tables."""
        fs, p = _fs(self.spark, self.sf_dir)
        found, todo = [], [p]
        while todo:
            for s in fs.listStatus(todo.pop()):
                if s.isDirectory():
                    todo.append(s.getPath())
                else:
                    found.append(f"{s.getPath()}|{s.getLen()}|{s.getModificationTime()}")
        return "\n".join(sorted(found))

    @cached_property
    def _root(self) -> str:
        base = ensure_checkpoint_dir(self.spark).rstrip("/")
        key = hashlib.sha256(f"{self._fingerprint()}|{self.as_of}|{BRIDGE_VERSION}".encode())
        return f"{base}/passlane-tables/{key.hexdigest()[:16]}"

    def _finished(self, name: str) -> str | None:
        """A copy of the table whose write was committed, if there is one."""
        fs, p = _fs(self.spark, f"{self._root}/{name}")
        if not fs.exists(p):
            return None
        copies = sorted(s.getPath().toString() for s in fs.listStatus(p) if _exists(self.spark, f"{s.getPath()}/_SUCCESS"))
        return copies[0] if copies else None

    def _stored(self, name: str, build, read=None, deal: bool = False, per_file: int = 20_000) -> DataFrame:
        """The table, from a committed copy. Every writer has a folder of its own, nothing is
        renamed or deleted, and a copy without its ``_SUCCESS`` marker is never read. Documents
        repeat much of each other and are compressed well; they are written by the task that made
        them, never shuffled. ``deal``: rows straight from a small driver table, which is one scan
        task, are dealt first, so that later scans run in parallel."""
        if not self.store:
            return build()
        if not (path := self._finished(name)):
            path = f"{self._root}/{name}/copy-{uuid.uuid4().hex[:12]}"
            rows, parts = build(), _PARTITION_BY.get(name, ())
            if deal:
                rows = rows.repartition(self.spark.sparkContext.defaultParallelism)
            rows.write.option("maxRecordsPerFile", per_file).option("compression", "zstd").partitionBy(*parts).parquet(path)
            if not _exists(self.spark, f"{path}/_SUCCESS"):
                return build()
        return read(self.spark, path) if read else self.spark.read.parquet(path)

    @cached_property
    def declarations(self) -> DataFrame:
        """Stored with what the age filter needs as a column of its own (``receipt_at``)."""
        return self._stored("declarations", lambda: with_receipt_at(bridge.declarations(self.tables)), read_declarations)

    @property
    def new_declarations(self) -> DataFrame:
        """The declarations for a table that stores them itself: read if they are stored, else made where
        they are written, not stored a second time."""
        if self.store and self._finished("declarations"):
            return self.declarations
        return with_receipt_at(bridge.declarations(self.tables))

    @cached_property
    def declaration_keys(self) -> DataFrame:
        """The declarations without their documents: for queries that read none, so that none is made."""
        return self._stored("declaration_keys", lambda: with_receipt_at(bridge.declaration_keys(self.tables)).drop("data"),
                            read_declaration_keys, per_file=1_000_000)

    @cached_property
    def locks(self) -> DataFrame:
        return self._stored("locks", lambda: bridge.locks(self.declaration_keys, self.as_of), read_locks)

    @cached_property
    def raw_notifications(self) -> DataFrame:
        return self._stored("raw_notifications", lambda: bridge.raw_notifications(self.tables), deal=True)

    @cached_property
    def submission_responses(self) -> DataFrame:
        return self._stored("submission_responses",
                            lambda: bridge.submission_responses(self.declaration_keys))

    @cached_property
    def raw_submissions(self) -> DataFrame:
        return self._stored("raw_submissions", lambda: bridge.raw_submissions(self.tables))

    @cached_property
    def raw_amendments(self) -> DataFrame:
        return self._stored("raw_amendments", lambda: bridge.raw_amendments(self.tables))

    @cached_property
    def lookup_requests(self) -> DataFrame:
        return self._stored("lookup_requests", lambda: bridge.lookup_requests(self.tables))

    def path(self, name: str) -> str:
        """Storage path of a domain table (derived and stored first if needed)."""
        store, self.store = self.store, True
        try:
            getattr(self, name)
            self.__dict__.pop(name, None) if not store else None
        finally:
            self.store = store
        return self._finished(name)

    def build_all(self) -> None:
        """Derive and store every domain table now (bench warm-up)."""
        for name in ("declarations", "declaration_keys", "locks", "raw_notifications",
                     "submission_responses", "raw_submissions", "raw_amendments",
                     "lookup_requests"):
            getattr(self, name)
