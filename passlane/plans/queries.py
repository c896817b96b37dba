"""Registered queries: ``name → (spark, sf_dir) → DataFrame``.

Each query derives its domain inputs from the driver tables (``Inputs``) and runs
one library operator (or a composition) over the whole input. Output columns are
flat and named exactly like the DuckDB oracle's (``passlane.plans.oracle``).
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passlane.functions.refs import decode_reference, encode_reference
from passlane.operators import documents as D
from passlane.operators import folds as FO
from passlane.operators import intake as I
from passlane.operators import locks as L
from passlane.operators import lookup as LK
from passlane.operators import validate as V
from passlane.operators import metrics as M
from passlane.operators import worklists as W
from passlane.plans.inputs import Inputs
from passlane.sources import bridge
from passlane.sources.keyed import KeyedTable
from passlane.streaming import jobs as ST

KEY_COLS = ["charge_reference", "ref_value", "state", "amend_state", "sent_to_hod",
            "amend_sent_to_hod", "last_updated"]
LOCK_COLS = ["lock_id", "last_updated", "last_updated_date"]

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__.removeprefix("q_")] = fn
    return fn


def keys(df: DataFrame) -> DataFrame:
    return df.select(*KEY_COLS)


# -- scans ---------------------------------------------------------------------

@query
def q_scan_declarations(spark, sf_dir):
    return Inputs(spark, sf_dir).declaration_keys.select(*KEY_COLS, "correlation_id",
                                                     "amend_correlation_id")


@query
def q_scan_locks(spark, sf_dir):
    return Inputs(spark, sf_dir).locks.select(*LOCK_COLS)


# -- metrics -------------------------------------------------------------------

@query
def q_state_counts(spark, sf_dir):
    return M.state_counts(Inputs(spark, sf_dir).declaration_keys)


@query
def q_status_summary(spark, sf_dir):
    return M.status_summary(Inputs(spark, sf_dir).declaration_keys)


@query
def q_status_gauges(spark, sf_dir):
    return M.status_gauges(Inputs(spark, sf_dir).declaration_keys)


# -- work lists ------------------------------------------------------------------

def _worklist(op) -> Query:
    def run(spark, sf_dir):
        return keys(op(Inputs(spark, sf_dir).declaration_keys))
    run.__name__ = "q_" + op.__name__
    run.__doc__ = op.__doc__
    return run


for _op in (W.unpaid_declarations, W.unpaid_amendments, W.paid_for_submission,
            W.amendments_for_submission, W.deletable_declarations, W.failed_declarations,
            W.failed_amendments):
    query(_worklist(_op))


@query
def q_stale_declarations(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return keys(W.stale_declarations(i.declaration_keys, i.as_of))


@query
def q_stale_amendments(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return keys(W.stale_amendments(i.declaration_keys, i.as_of))


@query
def q_retention_expired(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return keys(W.retention_expired(i.declaration_keys, i.as_of))


@query
def q_is_zero_pound(spark, sf_dir):
    d = Inputs(spark, sf_dir).declarations
    return d.select("charge_reference", W.is_zero_pound().alias("is_zero_pound"))


# -- locks ---------------------------------------------------------------------------

@query
def q_live_locks(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return L.live_locks(i.locks, i.as_of).select(*LOCK_COLS)


@query
def q_legacy_locks(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return L.legacy_locks(i.locks, i.as_of).select(*LOCK_COLS)


@query
def q_expire_locks(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return L.expire_locks(i.locks, i.as_of).select(*LOCK_COLS)


@query
def q_exclude_locked(spark, sf_dir):
    """Unpaid rows that hold no live lock."""
    i = Inputs(spark, sf_dir)
    return keys(L.exclude_locked(W.unpaid_declarations(i.declaration_keys), i.locks, i.as_of))


@query
def q_acquire_locks(spark, sf_dir):
    """Locks the submission batch takes at ``as_of``."""
    i = Inputs(spark, sf_dir)
    return L.acquire_locks(W.paid_for_submission(i.declaration_keys), i.locks, i.as_of)


@query
def q_release_locks(spark, sf_dir):
    """Lock table after releasing the keys of the failed-submission work list."""
    i = Inputs(spark, sf_dir)
    return L.release_locks(i.locks, W.failed_declarations(i.declaration_keys)).select(*LOCK_COLS)


# -- references and intake -------------------------------------------------------------

def counter_start(i: Inputs) -> int:
    """High-water mark of the reference counter: the largest value in the table."""
    return int(i.declaration_keys.agg(F.max("ref_value")).first()[0] or 0)


@query
def q_encode_references(spark, sf_dir):
    """Reference text for every order's value (o_orderkey + 1)."""
    o = Inputs(spark, sf_dir).tables.orders
    v = (F.col("o_orderkey") + 1).cast("int")
    return o.select(v.alias("ref_value"), encode_reference(v).alias("charge_reference"))


@query
def q_validate_references(spark, sf_dir):
    """Decode the reference of every payment message (invalid → null)."""
    n = Inputs(spark, sf_dir).raw_notifications
    ref = F.get_json_object("raw", "$.reference")
    return n.select("event_id", ref.alias("reference"), decode_reference(ref).alias("ref_value"))


@query
def q_intake_submissions(spark, sf_dir):
    """Raw submission bodies read as text: arrival key, correlation id, object or not."""
    r = Inputs(spark, sf_dir).raw_submissions
    return r.select("seq", "correlation_id", I.is_json_object().alias("is_object"))


@query
def q_assign_references(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return I.number_submissions(i.raw_submissions, counter_start(i)).select(
        "seq", "ref_value", "charge_reference")


def _validated(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return i, I.validated_submissions(i.raw_submissions, counter_start(i))


@query
def q_validate_documents(spark, sf_dir):
    """Every schema violation of every numbered, stamped submission."""
    _, v = _validated(spark, sf_dir)
    return V.validation_errors(v, ["seq"])


@query
def q_validation_summary(spark, sf_dir):
    _, v = _validated(spark, sf_dir)
    return V.validation_summary(V.validation_errors(v, ["seq"]))


@query
def q_validation_keywords(spark, sf_dir):
    """Submissions that break one keyword of the schema each: documents per (path, rule)."""
    raw = bridge.broken_submissions(Inputs(spark, sf_dir).raw_submissions)
    v = V.validate_documents(raw.withColumn("charge_reference", encode_reference((F.col("seq") + 1).cast("int"))), "raw", "charge_reference")
    return V.validation_summary(V.validation_errors(v, ["seq"]))


@query
def q_accept_submissions(spark, sf_dir):
    i, v = _validated(spark, sf_dir)
    return I.accept_submissions(v, i.as_of).select(
        "charge_reference", "ref_value", "state", "sent_to_hod", "correlation_id", "last_updated")


@query
def q_rejected_submissions(spark, sf_dir):
    i, v = _validated(spark, sf_dir)
    r = I.rejected_submissions(i.raw_submissions, v)
    return r.select("seq", "ref_value", F.col("errors")[0].alias("first_error"),
                    F.size("errors").cast("bigint").alias("n_errors"))


@query
def q_accept_amendments(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    after, _ = I.accept_amendments(i.raw_amendments, i.declaration_keys, i.locks, i.as_of)
    return after.select(*KEY_COLS, "correlation_id", "amend_correlation_id")


@query
def q_amendment_outcomes(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    _, outcomes = I.accept_amendments(i.raw_amendments, i.declaration_keys, i.locks, i.as_of)
    return outcomes


# -- documents ----------------------------------------------------------------------------

def _payload_cols(refined: DataFrame) -> list:
    p = "payload.simpleDeclarationRequest.requestDetail"
    n = lambda a: F.coalesce(F.size(F.col(a)), F.lit(0))
    return [
        F.col(f"{p}.declarationHeader.messageTypes.messageType").alias("message_type"),
        F.col(f"{p}.declarationHeader.travellingFrom").alias("travelling_from"),
        F.col(f"{p}.liabilityDetails.grandTotalGBP").alias("grand_total_gbp"),
        (n(f"{p}.declarationTobacco.declarationItemTobacco")
         + n(f"{p}.declarationAlcohol.declarationItemAlcohol")
         + n(f"{p}.declarationOther.declarationItemOther")).cast("bigint").alias("n_items"),
        D.payload_json().contains("portOfEntryName").alias("has_port_name"),
    ]


@query
def q_refine_payload(spark, sf_dir):
    """Typed payloads of the submission work list."""
    d = Inputs(spark, sf_dir).declarations
    r = D.refine_payload(W.paid_for_submission(d), "data")
    return r.select("charge_reference", "parse_ok", *_payload_cols(r))


@query
def q_parse_failures(spark, sf_dir):
    """Numbered submissions whose stamped document cannot be made a typed payload."""
    i = Inputs(spark, sf_dir)
    # bodies are read by few tasks, as they are compressed well, and are checked twice here: dealt to all cores
    v = I.validated_submissions(i.raw_submissions.repartition("seq"), counter_start(i))
    r = D.refine_payload(v.select("seq", "ref_value", F.to_json("__doc").alias("stamped")), "stamped")
    return D.parse_failures(r).select("seq", "ref_value")


@query
def q_amendment_or_original(spark, sf_dir):
    d = D.amendment_or_original(Inputs(spark, sf_dir).declarations)
    mt = F.get_json_object("chosen", "$.simpleDeclarationRequest.requestDetail.declarationHeader"
                                     ".messageTypes.messageType")
    return d.select("charge_reference", "chosen_source", mt.alias("message_type"))


@query
def q_pick_correlation(spark, sf_dir):
    """Correlation id of every row in the two submission batches."""
    d = Inputs(spark, sf_dir).declarations
    orig = W.paid_for_submission(d).withColumn("is_amendment", F.lit(False))
    amend = W.amendments_for_submission(d).withColumn("is_amendment", F.lit(True))
    both = orig.unionByName(amend)
    return both.select("charge_reference", "is_amendment",
                       D.pick_correlation(both, F.col("is_amendment")).alias("correlation"))


RECEIPT_COLS = ["subject", "NAME", "DATE", "PLACEOFARRIVAL", "DATEOFARRIVAL", "TIMEOFARRIVAL",
                "REFERENCE", "TOTAL", "TOTALEXCISEGBP", "TOTALCUSTOMSGBP", "TOTALVATGBP",
                "TRAVELLINGFROM"]


@query
def q_receipt_parameters(spark, sf_dir):
    """Receipt parameters of every row (amendment document when there is one)."""
    d = Inputs(spark, sf_dir).declarations
    p = D.receipt_parameters(D.amendment_or_original(d), "chosen")
    return p.select("charge_reference", *RECEIPT_COLS,
                    F.size("items").cast("bigint").alias("n_items"))


@query
def q_receipt_recipients(spark, sf_dir):
    d = Inputs(spark, sf_dir).declarations
    r = D.receipt_recipients(D.receipt_parameters(D.amendment_or_original(d), "chosen"))
    return r.select("charge_reference", "recipient", F.array_join("to", ",").alias("to_text"),
                    "templateId", "force")


@query
def q_receipt_requests(spark, sf_dir):
    """Receipt job over every row with the zero-pound switch on."""
    d = Inputs(spark, sf_dir).declarations
    r = D.receipt_requests(d, disable_zero_pound=True)
    return r.select("charge_reference", "recipient", "subject")


@query
def q_refused_receipts(spark, sf_dir):
    """Rows with documents broken by key for which no receipt can be made, and why."""
    return D.refused_receipts(bridge.broken_receipts(Inputs(spark, sf_dir).declarations)).select("charge_reference", "receipt_error")


@query
def q_goods_items(spark, sf_dir):
    d = D.goods_items(Inputs(spark, sf_dir).declarations, "data")
    return D.explode_items(d, ["charge_reference"])


@query
def q_concat_items(spark, sf_dir):
    d = D.goods_items(Inputs(spark, sf_dir).declarations, "data")
    return d.select("charge_reference", F.size("items").cast("bigint").alias("n_items"))


@query
def q_audit_events(spark, sf_dir):
    """Audit rows for the submission work list."""
    d = Inputs(spark, sf_dir).declarations
    a = D.audit_events(D.refine_payload(W.paid_for_submission(d), "data"))
    return a.select("charge_reference", "auditSource", "auditType",
                    F.col("tags")["transactionName"].alias("transactionName"),
                    F.col("detail.isPrivateTravel").alias("isPrivateTravel"),
                    F.col("detail.simpleDeclarationRequest.requestDetail.declarationHeader"
                          ".chargeReference").alias("detail_reference"))


@query
def q_previous_declaration_view(spark, sf_dir):
    d = Inputs(spark, sf_dir).declarations.where(F.col("state") == "paid")
    v = D.previous_declaration_view(d)
    return v.select(
        "charge_reference", "euCountryCheck", "arrivingNI", "isOver17", "isUKResident",
        "isPrivateTravel",
        F.get_json_object("userInformation", "$.lastName").alias("user_last_name"),
        F.get_json_object("calculation", "$.allTax").alias("calc_all_tax"),
        F.get_json_object("liabilityDetails", "$.grandTotalGBP").alias("liability_grand_total"),
        F.json_array_length("oldPurchaseProductInstances").cast("bigint").alias("n_old_purchase"),
        "amendmentCount",
        F.get_json_object("deltaCalculation", "$.allTax").alias("delta_all_tax"),
        "amendState")


@query
def q_stamp_reference(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    n = I.number_submissions(i.raw_submissions, counter_start(i))
    st = D.stamp_reference(n, "raw", "charge_reference")
    return st.select("seq",
                     F.get_json_object("stamped", "$.simpleDeclarationRequest.requestCommon"
                                                  ".acknowledgementReference").alias("ack_ref"),
                     F.get_json_object("stamped", "$.simpleDeclarationRequest.requestDetail"
                                                  ".declarationHeader.chargeReference").alias("doc_reference"))


@query
def q_split_journey(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    n = I.number_submissions(i.raw_submissions, counter_start(i))
    sp = D.split_journey(n, "raw")
    return sp.select("seq", F.col("journey_data").isNotNull().alias("has_journey"),
                     F.col("data").contains('"journeyData"').alias("data_has_journey"))


# -- payments and folds ------------------------------------------------------------------------

def _notes(i: Inputs) -> DataFrame:
    return FO.intake_notifications(i.raw_notifications)


@query
def q_intake_notifications(spark, sf_dir):
    n = _notes(Inputs(spark, sf_dir))
    return n.select("event_id", "status", "ref_value", "reject_reason")


@query
def q_notify_join(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    n = _notes(i).where(F.col("reject_reason").isNull())
    return FO.notify_join(n, i.declaration_keys).select("event_id", "ref_value", "found")


@query
def q_point_lookup(spark, sf_dir):
    """Declarations looked up by the keys of the payment messages (semi join)."""
    i = Inputs(spark, sf_dir)
    k = _notes(i).where(F.col("reject_reason").isNull()).select("ref_value").distinct()
    return keys(i.declaration_keys.join(k, "ref_value", "left_semi"))


def _outcomes(i: Inputs) -> DataFrame:
    return FO.payment_outcomes(_notes(i), i.declaration_keys, i.locks, i.as_of)


@query
def q_payment_outcomes(spark, sf_dir):
    o = _outcomes(Inputs(spark, sf_dir))
    return o.select("event_id", "ref_value", "level", "http_status", "applied", "new_state")


@query
def q_apply_payments(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return keys(FO.apply_payments(_outcomes(i), i.declaration_keys, i.as_of))


@query
def q_receipt_triggers(spark, sf_dir):
    return FO.receipt_triggers(_outcomes(Inputs(spark, sf_dir))).select("event_id", "ref_value", "level")


@query
def q_triggered_receipts(spark, sf_dir):
    """Receipt requests fired by the payment messages that took effect."""
    i = Inputs(spark, sf_dir)
    r = D.triggered_receipts(FO.receipt_triggers(_outcomes(i)), i.declarations)
    return r.select("event_id", "charge_reference", "recipient", "subject")


def _work(i: Inputs, amendment: bool) -> DataFrame:
    return (W.amendments_for_submission if amendment else W.paid_for_submission)(i.declarations)


def _batch_rows(i: Inputs, amendment: bool, rows: DataFrame | None = None) -> DataFrame:
    """Submission batch rows: work list → refined payload → unlocked. Documents are read where they
    lie; the locks are joined to what was made of them."""
    doc = "amend_data" if amendment else "data"
    made = D.refine_payload(_work(i, amendment) if rows is None else rows, doc)
    made = made.withColumn("is_amendment", F.lit(amendment)).withColumn("no_document", F.col(doc).isNull())
    return L.exclude_locked(made, i.locks, i.as_of)


def _batch(i: Inputs, amendment: bool) -> DataFrame:
    """Submission batch: the throttle deals slots to the whole work list, a locked row uses its
    slot up; then the free rows with correlation ids."""
    numbered = I.assign_references(_work(i, amendment), 0, ["ref_value"], value_col="seq")
    # configured throttle: one element per second
    slotted = I.dispatch_slots(numbered, elements=1, per_seconds=1)
    rows = _batch_rows(i, amendment, slotted)
    return rows.withColumn("correlation", D.pick_correlation(rows, F.lit(amendment)))


@query
def q_submission_batch(spark, sf_dir):
    b = _batch(Inputs(spark, sf_dir), False)
    return b.select("charge_reference", "correlation", "slot", "parse_ok")


@query
def q_amendment_batch(spark, sf_dir):
    b = _batch(Inputs(spark, sf_dir), True)
    return b.select("charge_reference", "correlation", "slot", "parse_ok")


@query
def q_quarantined(spark, sf_dir):
    """Rows of every state that could not be sent as they are, as originals and as amendments."""
    d = Inputs(spark, sf_dir).declarations
    both = None
    for amendment, doc in ((False, "data"), (True, "amend_data")):
        rows = D.refine_payload(d, doc).withColumn("is_amendment", F.lit(amendment))
        both = rows if both is None else both.unionByName(rows)
    return FO.quarantined(both).select("charge_reference", "is_amendment", "quarantine_reason")


@query
def q_quarantine_reasons(spark, sf_dir):
    """Both work lists with documents and ids broken by key: what is sent, and why the rest is not."""
    d = bridge.broken_batches(Inputs(spark, sf_dir).declarations)
    both = None
    for amendment, doc in ((False, "data"), (True, "amend_data")):
        work = (W.amendments_for_submission if amendment else W.paid_for_submission)(d)
        rows = D.refine_payload(work, doc).withColumn("is_amendment", F.lit(amendment))
        both = rows if both is None else both.unionByName(rows)
    why = FO.quarantined(both).select("charge_reference", "is_amendment", "quarantine_reason")
    return both.join(why, ["charge_reference", "is_amendment"], "left").select(
        "charge_reference", "is_amendment", "parse_ok", "quarantine_reason")


@query
def q_dispatch_slots(spark, sf_dir):
    """One row per second (1 element per 1 s): slot of every row in the batch."""
    b = _batch(Inputs(spark, sf_dir), False)
    return b.select("charge_reference", F.col("seq").cast("bigint").alias("seq"), "slot")


@query
def q_submitted_audit(spark, sf_dir):
    """Audit rows of both submission batches: one for each Submitted response."""
    i = Inputs(spark, sf_dir)
    batch = _batch_rows(i, False).unionByName(_batch_rows(i, True))
    a = FO.submitted_audit(batch, FO.classify_responses(i.submission_responses, batch))
    return a.select("charge_reference", "is_amendment", "auditType",
                    F.col("detail.isPrivateTravel").alias("isPrivateTravel"))


@query
def q_classify_responses(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    batch = _batch_rows(i, False).unionByName(_batch_rows(i, True))
    c = FO.classify_responses(i.submission_responses, batch)
    return c.select("charge_reference", "is_amendment", "http_status", "result")


@query
def q_apply_submission_results(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    batch = _batch_rows(i, False)
    c = FO.classify_responses(i.submission_responses, batch)
    out = FO.apply_submission_results(batch.select(*i.declarations.columns), c, i.as_of)
    return out.select(*KEY_COLS, "result")


@query
def q_apply_amendment_results(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    batch = _batch_rows(i, True)
    c = FO.classify_responses(i.submission_responses, batch)
    out = FO.apply_amendment_results(batch.select(*i.declarations.columns), c, i.as_of)
    return out.select(*KEY_COLS, "result")


@query
def q_requeue_failed(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return keys(FO.requeue_failed(i.declaration_keys, i.locks, i.as_of))


@query
def q_requeue_failed_amendments(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return keys(FO.requeue_failed_amendments(i.declaration_keys, i.locks, i.as_of))


@query
def q_remove_stale(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return keys(FO.remove_stale(i.declaration_keys, i.locks, i.as_of))


@query
def q_remove_stale_amendments(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return keys(FO.remove_stale_amendments(i.declaration_keys, i.locks, i.as_of))


@query
def q_remove_expired(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return keys(FO.remove_expired(i.declaration_keys, i.locks, i.as_of))


@query
def q_held_locks(spark, sf_dir):
    """Lock rows that the timeout, deletion and requeue jobs hold."""
    i = Inputs(spark, sf_dir)
    out = None
    for job in (FO.remove_stale, FO.remove_stale_amendments, FO.remove_expired, FO.requeue_failed,
                FO.requeue_failed_amendments):
        rows = FO.held_locks(job(i.declaration_keys, i.locks, i.as_of), i.as_of).select(
            F.lit(job.__name__).alias("job"), *LOCK_COLS)
        out = rows if out is None else out.unionByName(rows)
    return out


def _keyed(i: Inputs, name: str) -> KeyedTable:
    """The declarations as a new table that sinks write to."""
    table = KeyedTable(i.spark, f"{ST.stream_root(i.spark, name)}/declarations", "ref_value")
    table.create(lambda: i.new_declarations)
    return table


@query
def q_delete_rows(spark, sf_dir):
    """The stored table after the timeout job deletes its rows by key (survivors)."""
    i = Inputs(spark, sf_dir)
    table = _keyed(i, "delete")
    table.delete(FO.remove_stale(table.read(), i.locks, i.as_of))
    return keys(table.read())


@query
def q_replace_row(spark, sf_dir):
    """The stored table after accepted amendments replace their rows by key."""
    i = Inputs(spark, sf_dir)
    table = _keyed(i, "replace")
    after, _ = I.accept_amendments(i.raw_amendments, table.read(), i.locks, i.as_of)
    table.replace(after)
    return table.read().select(*KEY_COLS, "amend_correlation_id")


@query
def q_insert_rows(spark, sf_dir):
    """The stored table after the accepted submissions are inserted."""
    i, v = _validated(spark, sf_dir)
    table = _keyed(i, "insert")
    table.insert(W.with_receipt_at(I.accept_submissions(v, i.as_of)))
    return keys(table.read())


@query
def q_replaced_images(spark, sf_dir):
    """What replacing returns: the after-images of the rows that were there."""
    i = Inputs(spark, sf_dir)
    table = _keyed(i, "images")
    requeued = FO.requeue_failed(table.read(), i.locks, i.as_of)
    unknown = requeued.withColumn("ref_value", -F.col("ref_value"))
    return keys(table.replace(requeued.unionByName(unknown)))


@query
def q_amend_join(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    _, outcomes = I.accept_amendments(i.raw_amendments, i.declaration_keys, i.locks, i.as_of)
    return outcomes.select("seq", "ref_value",
                           (F.col("outcome") != "not_found").alias("matched"))


# -- previous-declaration lookup --------------------------------------------------------

@query
def q_intake_lookup_requests(spark, sf_dir):
    r = LK.intake_lookup_requests(Inputs(spark, sf_dir).lookup_requests)
    return r.select("request_id", "reject_reason")


@query
def q_first_match(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return LK.first_match(LK.lookup_matches(i.lookup_requests, i.declarations))


@query
def q_previous_declaration_lookup(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    found = LK.previous_declaration_lookup(i.lookup_requests, i.declarations)
    view = D.previous_declaration_view(found)
    return view.select("request_id", "charge_reference", "euCountryCheck", "isPrivateTravel",
                       "amendState")


# -- streaming: rows arrive in three parts, each a run of the stream over what is new ---------

def _in_parts(rows: DataFrame, by: str, folder: str, run, parts: int = 3) -> None:
    """Append ``rows`` to a folder in order of the number ``by``, and run the stream after each part."""
    low, high = rows.agg(F.min(by), F.max(by)).first()
    width = ((high or 0) - (low or 0)) // parts + 1
    for k in range(parts):
        part = F.floor((F.col(by) - F.lit(low or 0)) / F.lit(width))
        rows.where(part == k).drop(by if by.startswith("__") else "").write.mode("append").parquet(folder)
        run(folder)


@query
def q_stream_payments(spark, sf_dir):
    """Payment stream: outcomes written by the foreachBatch fold, over three micro-batches."""
    i = Inputs(spark, sf_dir)
    root = ST.stream_root(spark, "payments")
    table = i.path("declaration_keys")
    notes = i.raw_notifications.withColumn("__t", F.unix_micros(F.col("ts").cast("timestamp")))
    _in_parts(notes, "__t", f"{root}/in", lambda folder: ST.stream_payments(
        spark, folder, table, i.locks, i.as_of, root))
    return spark.read.parquet(f"{root}/outcomes").select("event_id", "ref_value", "level", "http_status",
                                                         "applied", "new_state")


@query
def q_stream_intake(spark, sf_dir):
    """Intake stream: accepted rows of three micro-batches, numbered across them."""
    i = Inputs(spark, sf_dir)
    root, start = ST.stream_root(spark, "intake"), counter_start(i)
    _in_parts(i.raw_submissions, "seq", f"{root}/in", lambda folder: ST.stream_intake(
        spark, folder, start, i.as_of, root))
    return spark.read.parquet(f"{root}/accepted").select("charge_reference", "ref_value", "state", "sent_to_hod",
                                                         "correlation_id", "last_updated")


@query
def q_stream_status(spark, sf_dir):
    """Counters over row versions: every sixth key arrives as pending first and again as it is."""
    i = Inputs(spark, sf_dir)
    d = i.declaration_keys.select("ref_value", "state", "last_updated")
    day = F.expr("INTERVAL 1 DAY")
    old = d.where("ref_value % 6 = 0").withColumn("state", F.lit("pending-payment")).withColumn(
        "last_updated", F.col("last_updated") - day)
    versions = (old.withColumn("__part", F.lit(0))
                .unionByName(d.where("ref_value % 2 = 1").withColumn("__part", F.lit(1)))
                .unionByName(d.where("ref_value % 2 = 0").withColumn("__part", F.lit(2))))
    root = ST.stream_root(spark, "status")
    _in_parts(versions, "__part", f"{root}/in", lambda folder: ST.stream_status(spark, folder, root))
    return ST.last_gauges(spark, root)


@query
def q_periodic_source(spark, sf_dir):
    """The unpaid work list re-run by a clock (three ticks): the rows of the last run."""
    i = Inputs(spark, sf_dir)
    out = ST.periodic_source(spark, i.path("declaration_keys"), W.unpaid_declarations,
                             ST.stream_root(spark, "periodic"), every="1 second", runs=3)
    return keys(spark.read.parquet(f"{out}/batch=2"))


def _timeouts(i: Inputs) -> tuple[str, str]:
    return ST.stream_timeouts(i.spark, lambda: i.new_declarations, i.locks, lambda: i.as_of,
                              ST.stream_root(i.spark, "timeouts"), every="1 second", runs=3)


@query
def q_stream_timeouts(spark, sf_dir):
    """Periodic timeout job, three ticks: the rows it deletes."""
    return keys(spark.read.parquet(_timeouts(Inputs(spark, sf_dir))[0]))


@query
def q_tap_output(spark, sf_dir):
    """The tap sink of the timeout stream: the same rows as the main sink."""
    return keys(spark.read.parquet(_timeouts(Inputs(spark, sf_dir))[1]))


@query
def q_lock_table_after_ticks(spark, sf_dir):
    """The live lock table after two timeout ticks, 120 days apart, and the legacy sweep."""
    i, later = Inputs(spark, sf_dir), _dt.timedelta(days=120)
    times, root = iter((i.as_of, i.as_of + later)), ST.stream_root(spark, "ticks")
    tick = ST.timeout_batch(spark, lambda: i.new_declarations, i.locks, lambda: next(times), root)
    tick(0)
    tick(1)
    table = ST.lock_table(spark, root)
    ST.sweep_in(table, i.as_of + later)
    return table.read().select(*LOCK_COLS)


@query
def q_stream_dispatch(spark, sf_dir):
    """Throttled dispatch over four ticks of a minute, ten rows a second: who goes when."""
    i, root = Inputs(spark, sf_dir), ST.stream_root(spark, "dispatch")
    times = iter(i.as_of + _dt.timedelta(minutes=n) for n in range(4))
    tick = ST.dispatch_batch(spark, i.declarations, i.locks, lambda: next(times), root, elements=10, interval_seconds=86_400)
    for n in range(4):
        tick(n)
    return spark.read.parquet(f"{root}/dispatched").select("charge_reference", "correlation", "send_at")


# -- flagship ----------------------------------------------------------------------------------

@query
def q_stale_unlocked_receipts(spark, sf_dir):
    """Stale unpaid rows minus live locks, with reference and receipt total
    (scan + pushed filter + anti join + nested projection)."""
    i = Inputs(spark, sf_dir)
    rows = FO.remove_stale(i.declarations, i.locks, i.as_of)
    total = F.get_json_object("data", "$.simpleDeclarationRequest.requestDetail.liabilityDetails"
                                      ".grandTotalGBP")
    return rows.select("charge_reference", "ref_value", "state", "last_updated",
                       total.alias("grand_total_gbp"))


def queries() -> dict[str, Query]:
    return dict(REGISTRY)
