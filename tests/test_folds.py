import datetime as dt
import random

from pyspark.sql import functions as F

from passlane import schema as S
from passlane.functions.refs import encode_reference
from passlane.operators import folds as FO

AS_OF = dt.datetime(2020, 1, 15, 12, 0, 0)
MAP = {S.SUCCESSFUL: S.PAID, S.FAILED: S.PAYMENT_FAILED, S.CANCELLED: S.PAYMENT_CANCELLED}


def sequential(state, amend, statuses):
    """Plain-Python fold, one notification at a time (test oracle only)."""
    out = []
    for st in statuses:
        if state == S.SUBMISSION_FAILED:
            out.append((409, False))
        elif state == S.PAID:
            if amend is None or amend == S.PAID:
                out.append((202, False))
            elif amend == S.SUBMISSION_FAILED:
                out.append((409, False))
            elif st in MAP:
                amend = MAP[st]
                out.append((202, True))
            else:
                out.append((500, False))
        elif st in MAP:
            state = MAP[st]
            out.append((202, True))
        else:
            out.append((500, False))
    return state, amend, out


def _tables(spark, cases):
    decl_rows, note_rows = [], []
    eid = 0
    t0 = dt.datetime(2020, 1, 1)
    for key, (state, amend, statuses) in enumerate(cases, start=1):
        decl_rows.append((key, state, amend))
        for j, st in enumerate(statuses):
            note_rows.append((eid, t0 + dt.timedelta(minutes=j), st, key))
            eid += 1
    decl = spark.createDataFrame(decl_rows, "ref_value int, state string, amend_state string") \
        .withColumn("charge_reference", encode_reference(F.col("ref_value"))) \
        .withColumn("last_updated", F.lit(t0).cast("timestamp_ntz"))
    notes = spark.createDataFrame(note_rows, "event_id long, ts timestamp_ntz, status string, ref_value int")
    locks = spark.createDataFrame([], S.LOCKS)
    return decl, notes, locks


def test_closed_form_equals_sequential_fold(spark):
    rng = random.Random(7)
    states = list(S.STATES)
    cases = []
    for _ in range(400):
        state = rng.choice(states)
        amend = rng.choice([None] + states) if state == S.PAID else None
        statuses = [rng.choice([S.SUCCESSFUL, S.FAILED, S.CANCELLED, "view"])
                    for _ in range(rng.randint(1, 8))]
        cases.append((state, amend, statuses))
    decl, notes, locks = _tables(spark, cases)
    outcomes = FO.payment_outcomes(notes, decl, locks, AS_OF)
    got = {r.event_id: (r.http_status, r.applied) for r in outcomes.collect()}
    after = {r.ref_value: (r.state, r.amend_state)
             for r in FO.apply_payments(outcomes, decl, AS_OF).collect()}
    eid = 0
    for key, (state, amend, statuses) in enumerate(cases, start=1):
        fs, fa, out = sequential(state, amend, statuses)
        for o in out:
            assert got[eid] == o, (key, state, amend, statuses)
            eid += 1
        if any(a for _, a in out):
            assert after[key] == (fs, fa), (key, state, amend, statuses)
        else:
            assert key not in after


def test_failed_payment_can_later_become_paid(spark):
    decl, notes, locks = _tables(spark, [(S.PENDING_PAYMENT, None, [S.FAILED, S.SUCCESSFUL])])
    after = FO.apply_payments(FO.payment_outcomes(notes, decl, locks, AS_OF), decl, AS_OF).first()
    assert after.state == S.PAID


def test_unknown_key_is_404_and_lock_is_423(spark):
    decl, notes, _ = _tables(spark, [(S.PENDING_PAYMENT, None, [S.SUCCESSFUL])])
    stray = spark.createDataFrame([(99, dt.datetime(2020, 1, 1), S.SUCCESSFUL, 77)],
                                  "event_id long, ts timestamp_ntz, status string, ref_value int")
    locks = spark.createDataFrame([(1, AS_OF, AS_OF)], S.LOCKS)
    got = {r.event_id: r.http_status for r in
           FO.payment_outcomes(notes.unionByName(stray), decl, locks, AS_OF).collect()}
    assert got == {0: 423, 99: 404}


def test_sent_flag_keeps_last_updated(spark):
    t0 = dt.datetime(2020, 1, 1)
    batch = spark.createDataFrame([("A", 1, S.PAID, False, t0), ("B", 2, S.PAID, False, t0)],
                                  "charge_reference string, ref_value int, state string, "
                                  "sent_to_hod boolean, last_updated timestamp_ntz")
    resp = spark.createDataFrame([("A", 204, False), ("B", 400, False)],
                                 "charge_reference string, http_status int, is_amendment boolean")
    out = {r.charge_reference: r for r in
           FO.apply_submission_results(batch, FO.classify_responses(resp), AS_OF).collect()}
    assert out["A"].sent_to_hod and out["A"].last_updated == t0 and out["A"].state == S.PAID
    assert out["B"].state == S.SUBMISSION_FAILED and out["B"].last_updated == AS_OF
