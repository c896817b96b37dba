import datetime as dt

from passlane import schema as S
from passlane.operators import locks as L
from passlane.operators import metrics as M
from passlane.operators import worklists as W

AS_OF = dt.datetime(2020, 1, 15, 12, 0, 0)


def _decl(spark, rows):
    base = dict(charge_reference="X", state=S.PAID, amend_state=None, sent_to_hod=False,
                amend_sent_to_hod=None, correlation_id="c", amend_correlation_id=None,
                journey_data="{}", data="{}", amend_data=None, last_updated=AS_OF)
    full = []
    for i, r in enumerate(rows):
        d = dict(base, ref_value=i, **r)
        full.append(tuple(d[c] for c in S.DECLARATION_COLUMNS))
    return spark.createDataFrame(full, S.DECLARATIONS)


def refs(df):
    return sorted(r.ref_value for r in df.select("ref_value").collect())


def test_seven_work_lists(spark):
    d = _decl(spark, [
        dict(state=S.PENDING_PAYMENT),                                           # 0
        dict(state=S.PAYMENT_FAILED),                                            # 1
        dict(state=S.PAYMENT_CANCELLED),                                         # 2
        dict(state=S.PAID, sent_to_hod=False),                                   # 3
        dict(state=S.PAID, sent_to_hod=True, amend_state=S.PAID, amend_sent_to_hod=False),  # 4
        dict(state=S.PAID, sent_to_hod=True),                                    # 5
        dict(state=S.SUBMISSION_FAILED),                                         # 6
        dict(state=S.PENDING_PAYMENT, amend_state=S.SUBMISSION_FAILED),          # 7
        dict(state=S.PAID, sent_to_hod=True, amend_state=S.PAID, amend_sent_to_hod=True),   # 8
        dict(state=S.PAID, sent_to_hod=True, amend_state=S.PAYMENT_FAILED,
             amend_sent_to_hod=False),                                           # 9
    ])
    assert refs(W.unpaid_declarations(d)) == [0, 1, 2, 7]
    assert refs(W.unpaid_amendments(d)) == [9]
    assert refs(W.paid_for_submission(d)) == [3]
    assert refs(W.amendments_for_submission(d)) == [4]
    assert refs(W.deletable_declarations(d)) == [5, 8]
    assert refs(W.failed_declarations(d)) == [6]
    assert refs(W.failed_amendments(d)) == [7]   # state not checked


def test_stale_boundary_is_strict(spark):
    cut = AS_OF - dt.timedelta(days=14)
    d = _decl(spark, [dict(state=S.PENDING_PAYMENT, last_updated=cut),
                      dict(state=S.PENDING_PAYMENT, last_updated=cut - dt.timedelta(seconds=1))])
    assert refs(W.stale_declarations(d, AS_OF)) == [1]


def test_retention_uses_receipt_date(spark):
    doc = '{"simpleDeclarationRequest":{"requestCommon":{"receiptDate":"%s"}}}'
    d = _decl(spark, [
        dict(state=S.PAID, sent_to_hod=True, data=doc % "2020-01-10T11:59:59Z"),
        dict(state=S.PAID, sent_to_hod=True, data=doc % "2020-01-10T12:00:00Z"),
        dict(state=S.PAID, sent_to_hod=True, data=doc % "not a date"),
    ])
    assert refs(W.retention_expired(d, AS_OF)) == [0]


def test_counts_zero_fill(spark):
    states = [S.PENDING_PAYMENT] * 3 + [S.PAID] * 2 + [S.PAYMENT_FAILED] * 5 + \
        [S.PAYMENT_CANCELLED] * 4 + [S.SUBMISSION_FAILED]
    d = _decl(spark, [dict(state=s) for s in states])
    r = M.status_summary(d).first().asDict()
    assert r == dict(pending_payment=3, payment_complete=2, payment_failed=5,
                     payment_cancelled=4, failed_submission=1)
    r0 = M.status_summary(_decl(spark, [dict(state=S.PAID)])).first().asDict()
    assert r0["pending_payment"] == 0 and r0["payment_complete"] == 1
    g = {x.metric: x.value for x in M.status_gauges(d).collect()}
    assert g[S.GAUGE_NAMES[S.PAYMENT_FAILED]] == 5


def test_locks(spark):
    locks = spark.createDataFrame([
        (1, AS_OF, AS_OF - dt.timedelta(seconds=10)),     # live
        (2, AS_OF, AS_OF - dt.timedelta(seconds=300)),    # expired (TTL)
        (3, AS_OF - dt.timedelta(seconds=400), None),     # legacy, older than TTL
        (4, AS_OF, None),                                  # legacy, recent
    ], S.LOCKS)
    assert sorted(r.lock_id for r in L.live_locks(locks, AS_OF).collect()) == [1, 3, 4]
    assert [r.lock_id for r in L.legacy_locks(locks, AS_OF).collect()] == [3]
    assert sorted(r.lock_id for r in L.expire_locks(locks, AS_OF).collect()) == [1, 4]
    d = _decl(spark, [dict(), dict(), dict(), dict(), dict()])
    assert refs(L.exclude_locked(d, locks, AS_OF)) == [0, 2]
    taken = L.acquire_locks(d.unionByName(d), locks, AS_OF)
    assert sorted(r.lock_id for r in taken.collect()) == [0, 2]
