"""Answers that depend on JSON types, on the order of checks, and on hot keys."""

import datetime as dt
import json

from pyspark.sql import functions as F

from passlane import schema as S
from passlane.functions.refs import encode_reference
from passlane.operators import documents as D
from passlane.operators import folds as FO
from passlane.operators import intake as I
from passlane.operators import lookup as LK
from passlane.operators import worklists as W
from passlane.plans.inputs import Inputs
from tests.conftest import SF

AS_OF = dt.datetime(1998, 1, 1)


def rows(spark, **columns):
    base = {"charge_reference": "XYPR0000000001", "ref_value": 1, "state": S.PAID, "amend_state": None, "sent_to_hod": True,
            "amend_sent_to_hod": None, "correlation_id": "c", "amend_correlation_id": None, "journey_data": "{}",
            "data": "{}", "amend_data": None, "last_updated": AS_OF}
    return spark.createDataFrame([tuple((base | columns).values())], S.DECLARATIONS)


def test_messages_need_strings(spark):
    ref = "XYPR0000000001"
    bodies = ['{"status":5,"reference":"%s"}' % ref, '{"status":"Successful","reference":"%s"}' % ref,
              '{"status":"Successful","reference":12}', '{"status":null,"reference":"x"}', "[]", "no json", None]
    raw = spark.createDataFrame([(k, AS_OF, b) for k, b in enumerate(bodies)], "event_id long, ts timestamp_ntz, raw string")
    got = {r.event_id: r.reject_reason for r in FO.intake_notifications(raw).collect()}
    assert got[1] is None and all(got[k] == "bad_shape" for k in (0, 2, 3, 4, 5, 6))


def test_view_does_not_coerce(spark):
    whole = {"euCountryCheck": "euOnly", "arrivingNICheck": True, "ageOver17": True, "privateCraft": False, "userInformation": {},
             "calculatorResponse": {"calculation": {}}, "purchasedProductInstances": [], "amendmentCount": 2}
    data = json.dumps({"simpleDeclarationRequest": {"requestDetail": {"liabilityDetails": {}}}})
    good = D.previous_declaration_view(rows(spark, journey_data=json.dumps(whole), data=data)).first()
    assert good.view_error is False and good.amendmentCount == 2 and good.isPrivateTravel is False
    odd = json.dumps(whole | {"privateCraft": "true", "amendmentCount": "2", "isUKResident": "yes"})
    bad = D.previous_declaration_view(rows(spark, journey_data=odd, data=data)).first()
    assert bad.view_error is True and bad.isPrivateTravel is None and bad.amendmentCount is None and bad.isUKResident is None
    for gone in ("euCountryCheck", "userInformation", "purchasedProductInstances", "calculatorResponse"):
        less = json.dumps({k: v for k, v in whole.items() if k != gone})
        assert D.previous_declaration_view(rows(spark, journey_data=less, data=data)).first().view_error is True


def document(**sections):
    return json.dumps({"simpleDeclarationRequest": {
        "requestCommon": {"receiptDate": "2020-12-29T12:14:08Z"} | sections.pop("common", {}),
        "requestDetail": {"contactDetails": {"emailAddress": "a@example.com"},
                          "declarationHeader": {"chargeReference": "XYPR0000000001"} | sections.pop("header", {}),
                          "liabilityDetails": {"grandTotalGBP": "1.00"}} | sections}})


def test_refused_receipts(spark):
    assert D.receipt_requests(rows(spark, data=document())).count() == 2
    for bad, why in ((document(declarationAlcohol={"totalExciseGBP": "1"}), "items"),
                     (document(common={"receiptDate": "2020-02-30T00:00:00Z"}), "receipt date"),
                     (document(header={"expectedDateOfArrival": "31/05/2018"}), "arrival date"),
                     (document(header={"timeOfEntry": "25:99"}), "arrival time")):
        row = rows(spark, data=bad)
        assert D.receipt_requests(row).count() == 0
        assert [r.receipt_error for r in D.refused_receipts(row).collect()] == [why]
    lost = rows(spark, amend_state=S.PAID, data=document())
    assert D.receipt_requests(lost).count() == 0 and D.refused_receipts(lost).first().receipt_error == "amendment document"


def test_receipts_follow_payments(spark):
    unpaid = rows(spark, state=S.PENDING_PAYMENT, data=document())
    fired = spark.createDataFrame([(7, 1), (8, 2)], "event_id long, ref_value int")
    got = D.triggered_receipts(fired, unpaid).collect()
    assert sorted((r.event_id, r.recipient) for r in got) == [(7, "copy"), (7, "passenger")]


def test_missing_amendment_document_is_an_error(spark):
    batch = rows(spark, amend_state=S.PAID).withColumn("parse_ok", F.lit(False)).withColumn("is_amendment", F.lit(True))
    response = spark.createDataFrame([("XYPR0000000001", 204, True)], "charge_reference string, http_status int, is_amendment boolean")
    assert FO.classify_responses(response, batch).first().result == "Error"
    held = batch.withColumn("amend_data", F.lit("{"))
    assert FO.classify_responses(response, held).first().result == "ParsingException"


def test_quarantine_reasons(spark):
    cases = [({"amend_data": None}, True, True, "missing document"), ({"amend_data": "{}"}, True, True, "missing correlation id"),
             ({"amend_data": "{}", "amend_correlation_id": "a"}, True, True, None), ({"data": "{}"}, False, True, None),
             ({"data": "{}"}, False, False, "payload does not parse")]
    for columns, amendment, parsed, why in cases:
        batch = rows(spark, **columns).withColumn("is_amendment", F.lit(amendment)).withColumn("parse_ok", F.lit(parsed))
        assert [r.quarantine_reason for r in FO.quarantined(batch).collect()] == ([why] if why else [])


def test_retention_ignores_the_session_zone(spark):
    doc = json.dumps({"simpleDeclarationRequest": {"requestCommon": {"receiptDate": "2020-03-29T01:30:00Z"}}})
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/London")
        assert rows(spark, data=doc).select(W.receipt_timestamp()).first()[0] == dt.datetime(2020, 3, 29, 1, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    for odd in ("2020-03-29 01:30:00Z", "2020-13-29T01:30:00Z", "2020-03-29T01:30:00"):
        text = json.dumps({"simpleDeclarationRequest": {"requestCommon": {"receiptDate": odd}}})
        assert rows(spark, data=text).select(W.receipt_timestamp()).first()[0] is None


def test_amendment_outcomes_in_order(spark):
    i = Inputs(spark, SF)
    raw = i.raw_amendments
    _, outcomes = I.accept_amendments(raw, i.declarations, i.locks, i.as_of)
    got = {r.seq: r.outcome for r in outcomes.collect()}
    from passlane.operators import locks as L

    held = {r.lock_id for r in L.live_locks(i.locks, i.as_of).collect()}
    both = [k for k in got if k % 37 == 0 and k + 1 in held and k % 35 and k % 45 and k % 53]
    assert both and all(got[k] == "locked" for k in both)
    assert {"accepted", "invalid", "locked", "no_journey_data", "not_found", "missing_correlation_id"} == set(got.values())


def test_lookup_needs_a_last_name_and_takes_json(spark):
    named = {"simpleDeclarationRequest": {"requestDetail": {"personalDetails": {"lastName": "Potter"}}}}
    table = rows(spark, data=json.dumps(named)).unionByName(
        rows(spark, charge_reference="XQPR0000000002", ref_value=2))
    asked = [("potter", "0000000"), (".*", "XQPR0000000002"), ("", "XQPR0000000002"), ("Potter", "X[A-Z]PR0000000001"),
             ("Potter", "X.PR0000000001"), ("Potter", "99999"), ("Potter", "x?ypr"), ("Potter", "0000000")]
    bodies = [json.dumps({"lastName": a, "referenceNumber": b}) for a, b in asked]
    bodies += ['{"lastName":"Potter","referenceNumber":5}', "[]", None]
    requests = spark.createDataFrame(list(enumerate(bodies)), "request_id long, raw string")
    found = {(r.request_id, r.charge_reference) for r in LK.lookup_matches(requests, table, max_broadcast=1).collect()}
    assert found == {(k, "XYPR0000000001") for k in (0, 3, 4, 6, 7)}
    refused = LK.intake_lookup_requests(requests).where("reject_reason = 'bad_shape'").collect()
    assert [r.request_id for r in refused] == [8, 9, 10]


def test_hot_payment_key_is_split(spark):
    """A key with a third of all messages: the join that carries messages is a skew join."""
    low = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
           "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
           "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
           "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in low}
    for k, v in low.items():
        spark.conf.set(k, v)
    try:
        i = Inputs(spark, SF)
        key = F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 1500 + 1).cast("int")
        notes = spark.range(60_000).select(
            F.col("id").alias("event_id"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"),
            F.lit(S.SUCCESSFUL).alias("status"), encode_reference(key).alias("reference"), key.alias("ref_value"))
        plain = FO.payment_outcomes(notes, i.declarations, i.locks, AS_OF)
        for made in (plain.select("event_id", "http_status"), FO.apply_payments(plain, i.declarations, AS_OF).select("ref_value")):
            made.collect()
            plan = made._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin(skew=true)" in plan
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_numbering_moves_documents_once(spark):
    docs = spark.range(2000).select("id", F.repeat(F.lit("x"), 50).alias("doc"))
    got = I.assign_references(docs, 10, ["id"])
    assert sorted((r.id, r.ref_value) for r in got.collect()) == [(k, 11 + k) for k in range(2000)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan  # only the keys were dealt, before the checkpoint
