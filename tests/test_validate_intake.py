import json

from pyspark.sql import functions as F

from passlane.operators import intake as I
from passlane.operators import validate as V


def _errors(spark, docs, ref=None):
    df = spark.createDataFrame([(d,) for d in docs], "raw string")
    if ref:
        df = df.withColumn("ref", F.lit(ref))
    out = V.validate_documents(df, "raw", "ref" if ref else None).collect()
    return [[(e.path, e.rule, e.message) for e in r.errors] for r in out]


def test_missing_required_text(spark):
    doc = {"simpleDeclarationRequest": {"requestCommon": {}, "requestDetail": {}}}
    errs = _errors(spark, [json.dumps(doc)], ref="XYPR0000000001")[0]
    msgs = [m for p, r, m in errs if p == "/simpleDeclarationRequest/requestCommon"]
    assert msgs == ['object has missing required properties (["receiptDate","requestParameters"])']


def test_type_pattern_additional(spark):
    doc = {"simpleDeclarationRequest": {"requestDetail": {
        "customerReference": {"idType": "p", "idValue": "1", "ukResident": "yes"},
        "liabilityDetails": {"grandTotalGBP": "12.345", "extra": 1}}}}
    errs = _errors(spark, [json.dumps(doc)])[0]
    rules = {(p.rsplit("/", 1)[-1], r) for p, r, _ in errs}
    assert ("ukResident", "type") in rules
    assert ("grandTotalGBP", "pattern") in rules
    assert ("liabilityDetails", "additionalProperties") in rules


def test_not_json_and_not_object(spark):
    errs = _errors(spark, ["nope", "[1]"])
    assert errs[0][0][1] == "parse" and errs[1][0][1] == "type"


def test_bridge_documents_are_valid(spark):
    from passlane.plans.inputs import Inputs
    from tests.conftest import SF
    d = Inputs(spark, SF).declarations
    v = V.validate_documents(d, "data")
    assert v.where(F.size("errors") > 0).count() == 0


def test_numbering_is_gap_free_and_ordered(spark):
    df = spark.range(0, 5000).select((F.col("id") * 3).alias("seq")).repartition(7)
    out = I.assign_references(df, 100, ["seq"], partitions=5)
    rows = sorted((r.seq, r.ref_value) for r in out.collect())
    assert [v for _, v in rows] == list(range(101, 5101))


def test_rejected_documents_burn_numbers(spark):
    good = json.dumps({"journeyData": {}, "simpleDeclarationRequest": {}})
    raw = spark.createDataFrame([(1, "c1", good), (2, "c2", "[]"), (3, "c3", good), (4, None, good)],
                                "seq long, correlation_id string, raw string")
    v = I.validated_submissions(raw, 10)
    nums = sorted((r.seq, r.ref_value) for r in v.collect())
    # array body and missing correlation id never reach the counter
    assert nums == [(1, 11), (3, 12)]
    rej = {r.seq: r.errors[0] for r in I.rejected_submissions(raw, v).collect()}
    assert rej[2] == "not_an_object" and rej[4] == "Missing X-Correlation-ID header"


def test_dispatch_slots_cap_per_interval(spark):
    df = spark.range(1, 6).withColumnRenamed("id", "seq")
    out = I.dispatch_slots(df, elements=2, per_seconds=30).orderBy("seq").collect()
    assert [r.slot for r in out] == [0, 0, 1, 1, 2]
    assert [r.offset_seconds for r in out] == [0, 0, 30, 30, 60]
