"""State-machine folds: payments, submission responses, requeue and removals.

Payment fold, closed form (no sequential state needed). For one key, order its
notifications by ``(ts, event_id)`` and let ``k`` be the number of Successful
notifications strictly before the current one. ``paid`` absorbs at each level and
Failed / Cancelled never block a later Successful, so only the first two
Successful positions per key matter:

* ``s1``, ``s2`` = the first and second Successful ``(ts, event_id)`` of the key;
* ``k = 0`` while the row is at or before ``s1``, ``1`` up to ``s2``, else ``≥ 2``.

``s1`` and ``s2`` come from a rank limited to two, which Spark applies before the
shuffle: at most two rows per key and task move. What is known of a key (its declaration
row, its live lock, ``s1`` and ``s2``) is joined first, one row per key, and meets the
messages in a single join; the key is widened there, so that both sides are shuffled for
that join alone and AQE can split the partition of a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passlane import schema as S
from passlane.functions.refs import decode_reference
from passlane.operators import locks as L
from passlane.operators.documents import audit_events, jstrict, pick_correlation
from passlane.operators import worklists as W
from passlane.operators.worklists import _ts

STATUS_TO_STATE = {S.SUCCESSFUL: S.PAID, S.FAILED: S.PAYMENT_FAILED, S.CANCELLED: S.PAYMENT_CANCELLED}


def _pos() -> Column:
    return F.struct(F.col("ts"), F.col("event_id"))


def intake_notifications(raw: DataFrame) -> DataFrame:
    """Parse notification bodies: (event_id, ts, status, reference, ref_value, reject_reason).

    A body without a string ``status`` and ``reference`` is a bad shape; a reference
    that does not decode is a bad reference. Both are refused (400)."""
    p = raw.withColumn("__j", F.expr("try_parse_json(raw)"))
    status = jstrict(F.col("__j"), "$.status", "string")
    reference = jstrict(F.col("__j"), "$.reference", "string")
    p = p.select("event_id", "ts", status.alias("status"), reference.alias("reference"))
    p = p.withColumn("ref_value", decode_reference(F.col("reference")))
    reason = (F.when(F.col("status").isNull() | F.col("reference").isNull(), F.lit("bad_shape"))
              .when(F.col("ref_value").isNull(), F.lit("bad_reference")))
    return p.withColumn("reject_reason", reason)


def notify_join(notes: DataFrame, declarations: DataFrame) -> DataFrame:
    """Notification ⟕ declaration on the key; ``found`` false means 404."""
    d = declarations.select(F.col("ref_value").alias("__k"), F.col("state").alias("__state"),
                            F.col("amend_state").alias("__amend"))
    j = notes.join(d, notes["ref_value"] == d["__k"], "left")
    return (j.withColumn("found", F.col("__k").isNotNull())
            .withColumnRenamed("__state", "decl_state").withColumnRenamed("__amend", "decl_amend_state")
            .drop("__k"))


def payment_outcomes(notes: DataFrame, declarations: DataFrame, locks: DataFrame, as_of
                     ) -> DataFrame:
    """One outcome per accepted notification.

    Columns added: ``level`` (declaration / amendment / null), ``http_status``
    (202, 404, 409, 423, or 500 for an unknown status that would be applied),
    ``applied`` (the notification changes a state) and ``new_state``.
    """
    good = notes.where(F.col("reject_reason").isNull()) if "reject_reason" in notes.columns else notes
    order = Window.partitionBy("ref_value").orderBy("p")
    firsts = (good.where(F.col("status") == S.SUCCESSFUL).select("ref_value", _pos().alias("p"))
              .distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= 2)
              .groupBy("ref_value").agg(F.min(F.when(F.col("n") == 1, F.col("p"))).alias("s1"),
                                        F.min(F.when(F.col("n") == 2, F.col("p"))).alias("s2")))
    held = L.live_locks(locks, as_of).select(F.col("lock_id").alias("__lock")).distinct()
    known_keys = declarations.select("ref_value", F.col("state").alias("decl_state"),
                                     F.col("amend_state").alias("decl_amend_state"))
    known_keys = (known_keys.join(held, known_keys["ref_value"] == held["__lock"], "left")
                  .join(firsts, "ref_value", "left").withColumn("__k", F.col("ref_value").cast("long"))
                  .drop("ref_value"))
    j = (good.join(known_keys, F.col("ref_value").cast("long") == F.col("__k"), "left")
         .withColumn("found", F.col("__k").isNotNull()).drop("__k"))

    pos = _pos()
    k = (F.when(F.col("s1").isNull() | (pos <= F.col("s1")), F.lit(0))
         .when(F.col("s2").isNull() | (pos <= F.col("s2")), F.lit(1)).otherwise(F.lit(2)))
    state, amend = F.col("decl_state"), F.col("decl_amend_state")
    unpaid = state.isin(*S.UNPAID_STATES)
    # which level the notification reaches, and that level's "successes before" count
    level = (F.when(unpaid & (k == 0), F.lit("declaration"))
             .when(unpaid | (state == S.PAID), F.lit("amendment")))
    k_level = F.when(unpaid, k - 1).otherwise(k)
    known = F.col("status").isin(*STATUS_TO_STATE)
    amend_open = amend.isNotNull() & ~amend.isin(S.PAID, S.SUBMISSION_FAILED)
    applies = ((level == "declaration")
               | ((level == "amendment") & amend_open & (k_level == 0)))
    http = (F.when(~F.col("found"), F.lit(404))
            .when(F.col("__lock").isNotNull(), F.lit(423))
            .when(state == S.SUBMISSION_FAILED, F.lit(409))
            .when((level == "amendment") & (amend == S.SUBMISSION_FAILED), F.lit(409))
            .when(applies & ~known, F.lit(500))
            .otherwise(F.lit(202)))
    applied = F.coalesce((http == 202) & applies, F.lit(False))
    new_state = F.when(applied, F.element_at(
        F.create_map(*[x for kv in STATUS_TO_STATE.items() for x in map(F.lit, kv)]), F.col("status")))
    return (j.withColumn("level", F.when(F.col("found") & F.col("__lock").isNull(), level))
            .withColumn("http_status", http)
            .withColumn("applied", applied)
            .withColumn("new_state", new_state)
            .drop("__lock", "s1", "s2"))


def apply_payments(outcomes: DataFrame, declarations: DataFrame, as_of) -> DataFrame:
    """After-images of the rows changed by the notifications.

    Per key and level: ``paid`` if any applied Successful, else the state of the last
    applied notification; ``last_updated`` = as_of for every changed row.
    """
    a = outcomes.where(F.col("applied"))

    def final(level: str) -> Column:
        at = a.where(F.col("level") == level)
        return at, (F.when(F.max((F.col("new_state") == S.PAID).cast("int")) == 1, F.lit(S.PAID))
                    .otherwise(F.max_by("new_state", _pos())))

    decl_rows, decl_final = final("declaration")
    amend_rows, amend_final = final("amendment")
    fd = decl_rows.groupBy("ref_value").agg(decl_final.alias("__state"))
    fa = amend_rows.groupBy("ref_value").agg(amend_final.alias("__amend"))
    changes = fd.join(fa, "ref_value", "full")
    out = declarations.join(changes, "ref_value")
    return out.select(
        *[F.coalesce(F.col("__state"), F.col("state")).alias("state") if c == "state"
          else F.coalesce(F.col("__amend"), F.col("amend_state")).alias("amend_state") if c == "amend_state"
          else _ts(as_of).alias("last_updated") if c == "last_updated"
          else F.col(c)
          for c in declarations.columns])


def receipt_triggers(outcomes: DataFrame) -> DataFrame:
    """Notifications that fire a receipt: applied and Successful."""
    return outcomes.where(F.col("applied") & (F.col("status") == S.SUCCESSFUL))


# -- submission responses -----------------------------------------------------------------

def classify_responses(responses: DataFrame, batch: DataFrame | None = None) -> DataFrame:
    """``result``: 204 → Submitted, 400 → Failed, other → Error; a row of ``batch`` whose
    document is missing (an amendment without its data) → Error, one whose payload could not
    be built (``parse_ok`` false) → ParsingException."""
    r = responses
    if batch is not None:
        doc = F.when(F.col("is_amendment"), F.col("amend_data")).otherwise(F.col("data"))
        # a batch that was joined brings the answer instead of the document
        missing = F.col("no_document") if "no_document" in batch.columns else doc.isNull()
        b = batch.select("charge_reference", "is_amendment", F.col("parse_ok").alias("__ok"),
                         missing.alias("__no_doc"))
        r = r.join(b, ["charge_reference", "is_amendment"], "left")
    else:
        r = r.withColumn("__ok", F.lit(True)).withColumn("__no_doc", F.lit(False))
    result = (F.when(F.col("__no_doc"), F.lit("Error"))
              .when(F.col("__ok") == F.lit(False), F.lit("ParsingException"))
              .when(F.col("http_status") == 204, F.lit("Submitted"))
              .when(F.col("http_status") == 400, F.lit("Failed"))
              .otherwise(F.lit("Error")))
    return r.withColumn("result", result).drop("__ok", "__no_doc")


def _apply_results(batch: DataFrame, classified: DataFrame, as_of, amendment: bool) -> DataFrame:
    sent, state = ("amend_sent_to_hod", "amend_state") if amendment else ("sent_to_hod", "state")
    c = classified.where(F.col("is_amendment") == F.lit(amendment)).select(
        "charge_reference", F.col("result").alias("__result"))
    j = batch.join(c, "charge_reference", "left")
    submitted, failed = F.col("__result") == "Submitted", F.col("__result") == "Failed"
    cols = []
    for col in batch.columns:
        if col == sent:
            cols.append(F.when(submitted, F.lit(True)).otherwise(F.col(col)).alias(col))
        elif col == state:
            cols.append(F.when(failed, F.lit(S.SUBMISSION_FAILED)).otherwise(F.col(col)).alias(col))
        elif col == "last_updated":   # a sent flag does not touch last_updated
            cols.append(F.when(failed, _ts(as_of)).otherwise(F.col(col)).alias(col))
        else:
            cols.append(F.col(col))
    return j.select(*cols, F.coalesce(F.col("__result"), F.lit("NoResponse")).alias("result"))


def apply_submission_results(batch: DataFrame, classified: DataFrame, as_of) -> DataFrame:
    """Fold responses into the declaration batch (rows outside the batch are ignored)."""
    return _apply_results(batch, classified, as_of, amendment=False)


def apply_amendment_results(batch: DataFrame, classified: DataFrame, as_of) -> DataFrame:
    return _apply_results(batch, classified, as_of, amendment=True)


def quarantined(batch: DataFrame) -> DataFrame:
    """Rows of a refined submission batch that cannot be sent, with ``quarantine_reason``; each
    is left as it is and does not stop the others."""
    doc = F.when(F.col("is_amendment"), F.col("amend_data")).otherwise(F.col("data"))
    correlation = pick_correlation(batch, F.col("is_amendment"))
    reason = (F.when(doc.isNull(), F.lit("missing document"))
              .when(correlation.isNull(), F.lit("missing correlation id"))
              .when(~F.col("parse_ok"), F.lit("payload does not parse")))
    return batch.withColumn("quarantine_reason", reason).where(F.col("quarantine_reason").isNotNull())


def submitted_audit(batch: DataFrame, classified: DataFrame) -> DataFrame:
    """Audit rows of a refined batch (``payload``, ``parse_ok``, ``is_amendment``): one for each
    row whose result is Submitted, with the document that was sent."""
    sent = classified.where(F.col("result") == "Submitted").select(
        F.col("charge_reference").alias("__sent"), F.col("is_amendment").alias("__sent_amendment")).distinct()
    # rows become audit rows where they are read, and only then meet the keys that were sent: what is shuffled are the
    # columns asked for. A semi join would be moved down to the documents by the optimizer; keys are distinct here
    rows = audit_events(batch)
    return rows.join(sent, (F.col("charge_reference") == F.col("__sent")) & (F.col("is_amendment") == F.col("__sent_amendment"))).drop(
        "__sent", "__sent_amendment")


# -- requeue and removals --------------------------------------------------------------------

def held_locks(rows: DataFrame, as_of) -> DataFrame:
    """The lock rows that a requeue, timeout or deletion job holds for the rows it took.

    These jobs take only rows whose key is free and never release their locks."""
    stamp = _ts(as_of)
    return rows.select(F.col("ref_value").cast("int").alias("lock_id")).distinct().select(
        "lock_id", stamp.alias("last_updated"), stamp.alias("last_updated_date"))


def requeue_failed(declarations: DataFrame, locks: DataFrame, as_of) -> DataFrame:
    """Unlocked submission-failed rows set back to paid, last_updated = as_of."""
    rows = L.exclude_locked(W.failed_declarations(declarations), locks, as_of)
    return rows.withColumn("state", F.lit(S.PAID)).withColumn("last_updated", _ts(as_of))


def requeue_failed_amendments(declarations: DataFrame, locks: DataFrame, as_of) -> DataFrame:
    rows = L.exclude_locked(W.failed_amendments(declarations), locks, as_of)
    return rows.withColumn("amend_state", F.lit(S.PAID)).withColumn("last_updated", _ts(as_of))


def delete_rows(table: DataFrame, keys: DataFrame, key: str = "ref_value"
                ) -> tuple[DataFrame, DataFrame]:
    """(survivors, removed before-images) of deleting ``keys`` from ``table``."""
    k = keys.select(F.col(key).alias("__del")).distinct()
    survivors = table.join(k, table[key] == k["__del"], "left_anti")
    removed = table.join(k, table[key] == k["__del"], "left_semi")
    return survivors, removed


def remove_stale(declarations: DataFrame, locks: DataFrame, as_of,
                 timeout_seconds: int = S.PAYMENT_TIMEOUT_SECONDS) -> DataFrame:
    """Stale unpaid rows that hold no live lock: the rows the timeout job deletes."""
    return L.exclude_locked(W.stale_declarations(declarations, as_of, timeout_seconds), locks, as_of)


def remove_stale_amendments(declarations: DataFrame, locks: DataFrame, as_of,
                            timeout_seconds: int = S.PAYMENT_TIMEOUT_SECONDS) -> DataFrame:
    """Stale unpaid amendments: the whole row goes, paid original included."""
    return L.exclude_locked(W.stale_amendments(declarations, as_of, timeout_seconds), locks, as_of)


def remove_expired(declarations: DataFrame, locks: DataFrame, as_of,
                   hold_seconds: int = S.DELETION_HOLD_SECONDS) -> DataFrame:
    return L.exclude_locked(W.retention_expired(declarations, as_of, hold_seconds), locks, as_of)


def replace_rows(table: DataFrame, after: DataFrame, key: str = "ref_value") -> DataFrame:
    """Replace rows by key with their after-images; keys not in the table are not added."""
    a = after.join(table.select(key), key, "left_semi")
    return table.join(a.select(key), key, "left_anti").unionByName(a.select(*table.columns))


def insert_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Append new rows (the snapshot a writer would produce with mode 'append')."""
    return table.unionByName(rows.select(*table.columns))
