"""Structured Streaming versions of the intake, payment, counter, timeout and dispatch jobs.

A micro-batch does work in proportion to what it brings, not to how many batches came before:

* payments keep what they can change (state, amendment state, time) in a ``KeyedTable`` beside
  the declarations; a batch reads the buckets its messages fall in, appends its changes there,
  and buckets that many batches have added to are folded into one;
* counters keep the latest version of each key in Spark's state store, which hands old and new
  state to the job, so that a batch adds signed differences to five numbers;
* intake reserves a block of reference numbers for a batch with one small file;
* locks, removals and dispatch keep their tables and cursors the same way.

Batch N replaces only its own output and reads only what batch N - 1 left, so that a retried
batch gives the same rows. What a batch cannot use goes to ``rejected`` or ``quarantine`` beside
the main output and does not stop the others.

``trigger`` defaults to ``availableNow`` (process what is there, then stop: tests, backfills).
``max_files_per_trigger`` bounds a micro-batch. Periodic jobs are clocked by a ``rate`` source,
so they run whether or not files arrive; ``as_of`` may be a function, evaluated once for each
batch and noted, so that a retried batch works at the same time as before.
"""

from __future__ import annotations

import datetime as _dt
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passlane import schema as S
from passlane.operators import documents as D
from passlane.operators import folds as FO
from passlane.operators import intake as I
from passlane.operators import locks as L
from passlane.operators import worklists as W
from passlane.session import ensure_checkpoint_dir
from passlane.sources.keyed import KeyedTable, file_system, read_note, write_note  # noqa: F401

#: What a payment can change in a declaration row.
CHANGED = ["state", "amend_state", "last_updated"]
#: Appended batches after which a bucket of the payment state is folded.
COMPACT_AFTER = 8


def stream_root(spark: SparkSession, name: str) -> str:
    """A fresh folder for one stream run under the session's checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/passlane-streams/{name}-{uuid.uuid4().hex[:8]}"


def _await(q) -> None:
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def _run(stream: DataFrame, fn, checkpoint: str, trigger: dict | None = None, mode: str = "append") -> None:
    w = stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).outputMode(mode)
    _await(w.trigger(**(trigger or {"availableNow": True})).start())


def _source(spark: SparkSession, path: str, max_files_per_trigger: int | None) -> DataFrame:
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return reader.parquet(path)


def _write(df: DataFrame, root: str, output: str, batch_id: int) -> None:
    """Replace the files of this batch of one output, and no others."""
    df.write.mode("overwrite").parquet(f"{root}/{output}/batch={batch_id}")


def _kept(spark: SparkSession, root: str, name: str, batch_id: int):
    """What the batch before this one kept under ``name``, or None.

    There are two places, written in turn: a batch overwrites its own, never the one it reads."""
    note = read_note(spark, f"{root}/{name}/{(batch_id + 1) % 2}.json")
    return note["value"] if note and note["batch"] == batch_id - 1 else None


def _keep(spark: SparkSession, root: str, name: str, batch_id: int, value) -> None:
    write_note(spark, f"{root}/{name}/{batch_id % 2}.json", {"batch": batch_id, "value": value})


def _last_kept(spark: SparkSession, root: str, name: str):
    notes = [n for n in (read_note(spark, f"{root}/{name}/{k}.json") for k in (0, 1)) if n]
    return max(notes, key=lambda n: n["batch"])["value"] if notes else None


def _time_of(spark: SparkSession, root: str, batch_id: int, as_of):
    """``as_of`` of a batch: a value, or a function whose first answer for the batch is kept."""
    if not callable(as_of):
        return as_of
    note = read_note(spark, f"{root}/clock/{batch_id % 2}.json")
    if not note or note["batch"] != batch_id:
        _keep(spark, root, "clock", batch_id, as_of().isoformat(sep=" "))
        note = read_note(spark, f"{root}/clock/{batch_id % 2}.json")
    return _dt.datetime.fromisoformat(note["value"])


def _now(frame_or_call) -> DataFrame:
    """A table given as a frame, or as a function that reads it as it is now."""
    return frame_or_call() if callable(frame_or_call) else frame_or_call


def periodic(spark: SparkSession, batch: Callable[[int], None], root: str, every: str = "1 day",
             runs: int | None = None) -> None:
    """Call ``batch(n)`` on every tick of a clock; with ``runs`` stop after so many (for tests)."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    q = (ticks.writeStream.foreachBatch(lambda _, n: batch(n) if runs is None or n < runs else None)
         .option("checkpointLocation", f"{root}/_checkpoint").trigger(processingTime=every).start())
    if runs is None:
        q.awaitTermination()
    while q.isActive and (q.lastProgress is None or q.lastProgress["batchId"] < runs - 1):
        time.sleep(0.2)
    failed = q.exception()
    q.stop()
    if failed is not None:
        raise RuntimeError(str(failed))


# -- payments

def latest_state(state: KeyedTable, version: int, buckets: list[int]) -> DataFrame:
    """Rows of some buckets as of a version: their folded rows, with what was appended since."""
    base = state.read(version, buckets, part="base")
    if not any(len(state.held(version).get(b, [])) > 1 for b in buckets):
        return base
    log = latest_changes(state.read(version, buckets, with_version=True, part="log"))
    log = log.select(F.col("ref_value").alias("_key"), F.struct(*CHANGED).alias("_new"))
    return base.join(log, F.col("ref_value") == F.col("_key"), "left").select("ref_value", *[
        F.when(F.col("_key").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in CHANGED])


def latest_changes(rows: DataFrame) -> DataFrame:
    """Of each key the row written last (``v``): the fold of the payment state."""
    return rows.groupBy("ref_value").agg(F.max_by(F.struct(*CHANGED), "v").alias("_new")).select("ref_value", "_new.*")


def payment_state(spark: SparkSession, root: str, buckets: int = 64) -> KeyedTable:
    return KeyedTable(spark, f"{root}/state", "ref_value", buckets)


def current_declarations(spark: SparkSession, declarations_path: str, root: str) -> DataFrame:
    """The stored declarations with the changes of all finished batches: the base of a stream that starts anew."""
    base = spark.read.parquet(declarations_path)
    state = payment_state(spark, root)
    if state.version() is None:
        return base
    new = latest_changes(state.read(with_version=True)).select(F.col("ref_value").alias("_key"), *[
        F.col(c).alias(f"_{c}") for c in CHANGED])
    joined = base.join(new, base["ref_value"] == new["_key"], "left")
    return joined.select(*[F.when(F.col("_key").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
                           if c in CHANGED else F.col(c) for c in base.columns])


def payments_batch(spark: SparkSession, declarations_path: str, locks, as_of, root: str, buckets: int = 64,
                   compact_after: int = COMPACT_AFTER):
    """The batch function of ``stream_payments``: versions 2n + 1 (changes) and 2n + 2 (folded) of the state."""
    def batch(df: DataFrame, batch_id: int) -> None:
        now = _time_of(spark, root, batch_id, as_of)
        state = payment_state(spark, root, buckets)
        state.create(lambda: spark.read.parquet(declarations_path).select("ref_value", *CHANGED))
        before = 2 * batch_id
        notes = FO.intake_notifications(df).persist()
        good = notes.where(F.col("reject_reason").isNull())
        touched = state.touched(good)
        current = latest_state(state, before, touched)
        _write(FO.payment_outcomes(good, current, _now(locks), now), root, "outcomes", batch_id)
        _write(notes.where(F.col("reject_reason").isNotNull()), root, "rejected", batch_id)
        notes.unpersist()
        outcomes = spark.read.parquet(f"{root}/outcomes/batch={batch_id}")
        state.append(FO.apply_payments(outcomes, current, now), before + 1)
        if state.compact(before + 2, compact_after, latest_changes):
            state.vacuum(before)

    return batch


def stream_payments(spark: SparkSession, notifications_path: str, declarations_path: str,
                    locks, as_of, root: str, trigger: dict | None = None,
                    max_files_per_trigger: int | None = None, buckets: int = 64,
                    compact_after: int = COMPACT_AFTER) -> str:
    """Payment notifications → outcomes and changed rows per batch; unusable messages go to ``rejected``."""
    src = _source(spark, notifications_path, max_files_per_trigger)
    _run(src, payments_batch(spark, declarations_path, locks, as_of, root, buckets, compact_after),
         f"{root}/_checkpoint", trigger)
    return f"{root}/outcomes"


# -- intake

def intake_batch(spark: SparkSession, start: int, as_of, root: str):
    """The batch function of ``stream_intake``.

    A batch reserves a block of numbers, as many as it has eligible bodies, by one small file;
    its tasks number inside the block. Only the block before it is looked at."""
    def batch(df: DataFrame, batch_id: int) -> None:
        now = _time_of(spark, root, batch_id, as_of)
        before = _kept(spark, root, "counter", batch_id)
        low = start if before is None else before["high"]
        # a file is one task; bodies cost time by their number, so they are dealt to all cores
        df = df.repartition("seq").persist()
        high = low + I.eligible_submissions(df).count()
        _keep(spark, root, "counter", batch_id, {"low": low, "high": high})
        # only what the outputs read is kept, not the parsed documents beside it
        validated = I.validated_submissions(df, low).select(
            "seq", "ref_value", "charge_reference", "correlation_id", "errors", "__journey_ok", "journey_data", "data").persist()
        _write(I.accept_submissions(validated, now), root, "accepted", batch_id)
        _write(I.rejected_submissions(df, validated), root, "rejected", batch_id)
        validated.unpersist()
        df.unpersist()

    return batch


def last_reference(spark: SparkSession, root: str) -> int | None:
    """The highest reference number reserved so far."""
    block = _last_kept(spark, root, "counter")
    return block["high"] if block else None


def once_each(stream: DataFrame, event_time: str, within: str) -> DataFrame:
    """Drop bodies whose correlation id came before, within so long of event time (``event_time``
    is a timestamp column). Bodies without an id are all kept: each is refused on its own."""
    key = F.coalesce(F.concat(F.lit("id:"), "correlation_id"), F.concat(F.lit("row:"), F.col("seq").cast("string")))
    return (stream.withColumn("_once", key).withWatermark(event_time, within)
            .dropDuplicatesWithinWatermark(["_once"]).drop("_once"))


def stream_intake(spark: SparkSession, submissions_path: str, start: int, as_of, root: str,
                  trigger: dict | None = None, max_files_per_trigger: int | None = None,
                  event_time: str | None = None, once_within: str | None = None) -> str:
    """Raw submissions → accepted rows and rejections per batch, numbered across batches.

    With ``once_within`` (such as "1 hour") a body sent again takes no second number."""
    src = _source(spark, submissions_path, max_files_per_trigger)
    if once_within:
        src = once_each(src, event_time, once_within)
    _run(src, intake_batch(spark, start, as_of, root), f"{root}/_checkpoint", trigger)
    return f"{root}/accepted"


# -- counters

#: Keys whose latest versions share one row of the state store, 9 bytes each (one call of the job a pack:
#: with few keys in a pack the calls cost more than their work).
PACK = 1024
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def latest_versions(pack: int = PACK):
    """The state function of ``stream_status``: (states, times) of ``pack`` keys → signed differences.

    A version replaces the known one if its time is later or equal (of one batch the latest,
    then the greatest state name); a state that keys leave counts down, one they enter up."""
    codes = {s: k for k, s in enumerate(S.STATES)}

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, times = (np.frombuffer(x, t).copy() for x, t in zip(state.get, ("i1", "<i8"), strict=True)) if state.exists \
            else (np.full(pack, -1, "i1"), np.full(pack, np.iinfo(np.int64).min, "<i8"))
        new = pd.concat(list(frames), ignore_index=True).sort_values(["slot", "time", "state"], na_position="first")
        new = new.groupby("slot", sort=False).tail(1)
        slot = new["slot"].to_numpy(np.int64)
        time_ = new["time"].to_numpy(np.int64)
        code = new["state"].map(codes).fillna(-1).to_numpy(np.int8)
        later = time_ >= times[slot]
        slot, time_, code = slot[later], time_[later], code[later]
        change = np.bincount(code[code >= 0], minlength=len(codes)) - np.bincount(held[slot][held[slot] >= 0], minlength=len(codes))
        held[slot], times[slot] = code, time_
        state.update((held.tobytes(), times.tobytes()))
        moved = np.flatnonzero(change)
        yield pd.DataFrame({"state": [S.STATES[k] for k in moved], "change": change[moved].astype(np.int64)})

    return update


def status_changes(versions: DataFrame, pack: int = PACK) -> DataFrame:
    """Stream of row versions → stream of (state, change), by a stateful operator keyed by packs of keys."""
    earliest = -(1 << 62)
    rows = versions.where(F.col("ref_value").isNotNull()).select(
        F.floor(F.col("ref_value") / pack).cast("long").alias("pack"),
        F.pmod(F.col("ref_value"), F.lit(pack)).cast("long").alias("slot"), "state",
        F.coalesce(F.unix_micros(F.col("last_updated").cast("timestamp")), F.lit(earliest)).alias("time"))
    return rows.groupBy("pack").applyInPandasWithState(
        latest_versions(pack), "state string, change long", "held binary, times binary", "update", "NoTimeout")


def status_batch(spark: SparkSession, root: str):
    """Adds a batch's differences to the five counters."""
    def batch(df: DataFrame, batch_id: int) -> None:
        counts = _kept(spark, root, "gauges", batch_id) or dict.fromkeys(S.STATES, 0)
        for r in df.groupBy("state").agg(F.sum("change").alias("change")).collect():  # five rows at most
            counts[r["state"]] += r["change"]
        _keep(spark, root, "gauges", batch_id, counts)

    return batch


def stream_status(spark: SparkSession, versions_path: str, root: str, trigger: dict | None = None,
                  max_files_per_trigger: int | None = None) -> str:
    """Row versions fed as files → the five gauges over the latest version of each key.

    A key that changes state moves from one counter to the other; it is never counted twice.
    The latest versions are in Spark's state store (RocksDB, only changes are checkpointed)."""
    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB,
                "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        src = status_changes(_source(spark, versions_path, max_files_per_trigger))
        _run(src, status_batch(spark, root), f"{root}/_checkpoint", trigger, mode="update")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return f"{root}/gauges"


def last_gauges(spark: SparkSession, root: str) -> DataFrame:
    """(metric, value) after the last finished batch; each run replaces the one before."""
    counts = _last_kept(spark, root, "gauges") or dict.fromkeys(S.STATES, 0)
    return spark.createDataFrame([(S.GAUGE_NAMES[s], counts[s]) for s in S.STATES], "metric string, value long")


# -- periodic jobs

def periodic_source(spark: SparkSession, table_path: str, job, root: str, every: str = "1 day",
                    runs: int | None = None) -> str:
    """Re-run ``job(current table)`` on every tick; its rows go to ``{root}/out/batch=N``."""
    periodic(spark, lambda n: _write(job(spark.read.parquet(table_path)), root, "out", n), root, every, runs)
    return f"{root}/out"


def lock_table(spark: SparkSession, root: str, locks: DataFrame | None = None, buckets: int = 16) -> KeyedTable:
    """The lock table that jobs share, made from ``locks`` (the earliest lock of a key) if it is new."""
    table = KeyedTable(spark, f"{root}/locks", "lock_id", buckets)
    if locks is not None:
        table.create(lambda: locks.groupBy("lock_id").agg(F.min(F.struct("last_updated", "last_updated_date")).alias("x")).select(
            "lock_id", "x.*"))
    return table


def expire_in(table: KeyedTable, as_of, version: int | None = None, ttl_seconds: int = S.LOCK_TTL_SECONDS) -> DataFrame:
    """Delete the locks whose life has ended at ``as_of``; returns them."""
    return table.delete_where(L.has_expired(as_of, ttl_seconds), version)


def sweep_in(table: KeyedTable, as_of, version: int | None = None, ttl_seconds: int = S.LOCK_TTL_SECONDS) -> DataFrame:
    """Delete the legacy locks (without a date) older than the TTL, as the clean-up job does; returns them."""
    return table.delete_where(L.is_swept(as_of, ttl_seconds), version)


def acquire_in(table: KeyedTable, rows: DataFrame, as_of, version: int | None = None, key: str = "ref_value") -> DataFrame:
    """Lock the keys of ``rows`` that are free; returns the lock rows added (one winner a key)."""
    stamp = W._ts(as_of)
    return table.insert(rows.select(F.col(key).cast("int").alias("lock_id"), stamp.alias("last_updated"),
                                    stamp.alias("last_updated_date")), version)


def release_in(table: KeyedTable, rows: DataFrame, version: int | None = None, key: str = "ref_value") -> DataFrame:
    """Delete the locks of the keys of ``rows``; returns them. A key without a lock is no error."""
    return table.delete(rows.select(F.col(key).cast("int").alias("lock_id")), version)


def timeout_batch(spark: SparkSession, declarations, locks: DataFrame, as_of, root: str, buckets: int = 64,
                  stale=W.stale_declarations):
    """The batch function of ``stream_timeouts``. ``declarations``: a path, or a function that gives the rows.

    Tick n: expired locks go (version 2n + 1 of the lock table), stale rows are found, those whose
    key is free are locked (2n + 2), deleted from the table (n + 1), and written to the outputs."""
    def batch(batch_id: int) -> None:
        now = _time_of(spark, root, batch_id, as_of)
        held = lock_table(spark, root, locks)
        table = KeyedTable(spark, f"{root}/declarations", "ref_value", buckets)
        table.create(declarations if callable(declarations) else lambda: spark.read.parquet(declarations))
        expire_in(held, now, 2 * batch_id + 1)
        candidates = stale(table.read(batch_id), now).select("ref_value")
        won = acquire_in(held, candidates, now, 2 * batch_id + 2)
        removed = table.delete(won.select(F.col("lock_id").alias("ref_value")), batch_id + 1)
        for output in ("removed", "tap"):
            _write(removed, root, output, batch_id)
        if batch_id % COMPACT_AFTER == COMPACT_AFTER - 1:
            held.vacuum(2 * batch_id)
            table.vacuum(batch_id)

    return batch


def stream_timeouts(spark: SparkSession, declarations, locks: DataFrame, as_of, root: str,
                    every: str = "1 day", runs: int | None = None) -> tuple[str, str]:
    """Periodic timeout job: each tick deletes the stale unlocked rows of the current table.

    They go to the main sink and to a tap; their keys stay locked until the locks expire. The
    lock table is live: what a tick locks is held in the next one."""
    periodic(spark, timeout_batch(spark, declarations, locks, as_of, root), root, every, runs)
    return f"{root}/removed", f"{root}/tap"


# -- dispatch

def dispatch_batch(spark: SparkSession, table, locks, as_of, root: str, elements: int = 1, per_seconds: int = 1,
                   interval_seconds: int = S.SUBMISSION_INTERVAL_SECONDS, worklist=W.paid_for_submission,
                   document: str = "data"):
    """The batch function of ``stream_dispatch``.

    Kept from tick to tick: whether a listing of the work list is open, when it began, the row
    dealt last (``cursor``) and the time of the next slot (``free``). An open listing gets the slots
    from ``free`` up to now, in key order; a locked row uses its slot up. When it is dealt to its
    end, the next one opens ``interval_seconds`` after it began, and not before ``free``: slots that
    nobody used are lost, they do not pile up."""
    amendment = document == "amend_data"
    period, interval = _dt.timedelta(seconds=per_seconds), _dt.timedelta(seconds=interval_seconds)
    when = _dt.datetime.fromisoformat

    def batch(batch_id: int) -> None:
        now = _time_of(spark, root, batch_id, as_of)
        kept = _kept(spark, root, "cursor", batch_id) or {"open": False, "listed": None, "cursor": None, "free": now.isoformat()}
        free = when(kept["free"])
        if not kept["open"] and (kept["listed"] is None or now >= when(kept["listed"]) + interval):
            free = max(free, now)
            kept |= {"open": True, "listed": now.isoformat(), "cursor": None}
        slots = ((now - free) // period + 1) * elements if kept["open"] and now >= free else 0
        rows = worklist(_now(table))
        if kept["cursor"] is not None:
            rows = rows.where(F.col("ref_value") > kept["cursor"])
        dealt = rows.orderBy("ref_value").limit(slots)  # the throttle: so many rows may go until now
        dealt = I.dispatch_slots(I.assign_references(dealt, 0, ["ref_value"], value_col="seq"), elements, per_seconds)
        dealt = dealt.withColumn("send_at", (W._ts(free) + F.make_interval(secs=F.col("offset_seconds"))).cast("timestamp_ntz")).persist()
        taken, last = dealt.agg(F.count("*"), F.max("ref_value")).first()
        ready = D.refine_payload(L.exclude_locked(dealt, _now(locks), now), document).withColumn("is_amendment", F.lit(amendment))
        ready = ready.withColumn("correlation", D.pick_correlation(ready, F.lit(amendment))).persist()
        broken = FO.quarantined(ready)
        _write(broken.select("charge_reference", "ref_value", "is_amendment", "quarantine_reason"), root, "quarantine", batch_id)
        _write(ready.join(broken.select("ref_value"), "ref_value", "left_anti").select(
            "charge_reference", "ref_value", "correlation", "send_at", D.payload_json().alias("payload")), root, "dispatched", batch_id)
        ready.unpersist()
        dealt.unpersist()
        _keep(spark, root, "cursor", batch_id, {
            "open": kept["open"] and taken == slots, "listed": kept["listed"], "cursor": kept["cursor"] if last is None else last,
            "free": (free + -(-taken // elements) * period).isoformat()})

    return batch


def stream_dispatch(spark: SparkSession, table, locks, as_of, root: str, elements: int = 1, per_seconds: int = 1,
                    every: str = "1 second", runs: int | None = None, **more) -> str:
    """Periodic throttled dispatch of a work list: at most ``elements`` rows in any ``per_seconds``.

    Payloads that cannot be sent go to ``quarantine`` and do not hold up the others."""
    periodic(spark, dispatch_batch(spark, table, locks, as_of, root, elements, per_seconds, **more), root, every, runs)
    return f"{root}/dispatched"
