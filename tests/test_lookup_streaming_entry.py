import json

from pyspark.sql import functions as F

from passlane import schema as S
from passlane.operators import lookup as LK
from passlane.session import ensure_checkpoint_dir
from tests.conftest import SF


def _decl(spark, rows):
    out = []
    for ref, last, state, amend in rows:
        data = json.dumps({"simpleDeclarationRequest": {"requestDetail": {
            "personalDetails": {"firstName": "Harry", "lastName": last}}}})
        out.append((ref, 1, state, amend, True, None, "c", None, "{}", data, None, None))
    schema = S.DECLARATIONS
    return spark.createDataFrame(out, schema.simpleString().replace("timestamp_ntz", "timestamp_ntz"))


def test_lookup_lanes(spark):
    d = _decl(spark, [("XYPR0000000001", "Potter", S.PAID, None),
                      ("XQPR0000000002", "Potter", S.PAID, S.SUBMISSION_FAILED),
                      ("XSPR0000000003", "Weasley", S.PAID, S.PENDING_PAYMENT)])
    reqs = spark.createDataFrame([
        (1, "POTTER", "xypr0000000001"),       # exact lane, case-insensitive
        (2, "potter", "0000000002"),           # gram lane: failed amendment hides the row
        (3, "WEASLEY", "X[A-Z]PR0+3"),         # index lane (a real regex; the last name is rare)
        (4, "Potter", "X(YPR"),                # does not compile: refused
    ], "request_id long, lastName string, referenceNumber string")
    got = {r.request_id: r.charge_reference
           for r in LK.first_match(LK.lookup_matches(reqs, d, max_broadcast=1)).collect()}
    assert got == {1: "XYPR0000000001", 3: "XSPR0000000003"}
    bad = LK.intake_lookup_requests(reqs).where(F.col("reject_reason").isNotNull())
    assert [r.request_id for r in bad.collect()] == [4]


def test_any_pattern_gives_what_a_scan_gives(spark):
    names = ["Potter", "Weasley", "O'Brien", "Müller-Lüdenscheidt", "Lee", None, "Granger"]
    rows = [(f"X{'ABCDEFGH'[k % 8]}PR{k * 37:010d}", names[k % 7], S.PAID, None) for k in range(160)]
    d = _decl(spark, rows)
    asked = [("POTTER", "X[A-Z]PR0+1"), ("potter|granger", "37|74"), ("(Pot|Wea)s?", "0000"), ("Gr.nger", "X.PR0*3[0-9]+"),
             ("Gran?ger", "PR"), ("Grang{1}er", ""), ("L[e]e", "X"), ("müller", "pr0"), ("O'Brien", "^XA"), ("nobody", "."),
             ("a|", "X[B-D]PR"), ("Weas+ley", "0+7$"), ("\\\\QLee\\\\E", "X"), ("Pot+e?r", "X[^A]PR"), ("[[a-c]x]", "."), ("ley", "X"), ("potter", "00037"), ("lee", "0148")]
    asked = [(a.replace("\\\\", "\\"), b) for a, b in asked]
    reqs = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(asked)], "request_id long, lastName string, referenceNumber string")
    got = {(r.request_id, r.charge_reference) for r in LK.lookup_matches(reqs, d).collect()}
    rx = F.expr("regexp_like(charge_reference, concat('(?i)', referenceNumber)) AND regexp_like(last_name, concat('(?i)', lastName))")
    want = {(r.request_id, r.charge_reference) for r in LK.eligible_declarations(d).crossJoin(reqs).where(rx).collect()}
    assert got == want and len({k for k, _ in want}) > 9


def test_patterns_with_rare_grams_need_no_nested_loop(spark):
    rows = [(f"XAPR{k:010d}", f"Name{chr(97 + k % 26)}{chr(97 + k // 26)}x", S.PAID, None) for k in range(200)]
    reqs = spark.createDataFrame([(1, "NAMEBBX", "X[A-Z]PR0+2"), (2, "namec[ab]x|namedax", "X[A-Z]PR0+"), (3, "e", "XAPR0+19+")],
                                 "request_id long, lastName string, referenceNumber string")
    d = _decl(spark, rows)
    plan = lambda r: LK.lookup_matches(r, d)._jdf.queryExecution().optimizedPlan().toString()
    few = reqs.where("request_id = 1")
    assert "regexp" in plan(few).lower() and "BroadcastNestedLoopJoin" not in LK.lookup_matches(few, d)._jdf.queryExecution().executedPlan().toString()
    rare = F.array_sort(F.flatten(LK.must_hold(F.col("referenceNumber"))))
    assert reqs.select(rare).collect()[0][0] == ["PR0"]
    assert reqs.select(LK.must_hold(F.col("lastName"))).collect()[1][0] == [["NAM", "AME", "MEC"], ["NAM", "AME", "MED", "EDA", "DAX"]]


def test_stream_payments_equals_batch(spark):
    import __spark_entry__ as E
    q = E.queries()
    stream = {tuple(r) for r in q["stream_payments"](spark, SF).collect()}
    batch = {tuple(r) for r in q["payment_outcomes"](spark, SF).collect()}
    assert stream == batch and len(batch) > 0


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0 and "charge_reference" in df.columns
    from passlane.plans import oracle, queries
    assert set(oracle.oracle_sql()) == set(queries.queries())
    assert set(E.oracle_sql()) <= set(E.queries())


def test_stream_intake_counter_continues_across_batches(spark):
    from passlane.plans.inputs import Inputs
    from passlane.plans.queries import counter_start
    from passlane.streaming import jobs as ST
    i = Inputs(spark, SF)
    start = counter_start(i)
    root = ST.stream_root(spark, "intake-test")
    src = f"{root}/in"
    i.raw_submissions.repartition(3).write.parquet(src)
    out = ST.stream_intake(spark, src, start, i.as_of, root, max_files_per_trigger=1)
    assert spark.read.parquet(out).select("batch").distinct().count() > 1
    accepted = spark.read.parquet(out)
    import __spark_entry__ as E
    in_batch = E.queries()["accept_submissions"](spark, SF)
    # same documents accepted; numbers unique and drawn from one gap-free counter run
    assert {r.correlation_id for r in accepted.collect()} == \
        {r.correlation_id for r in in_batch.collect()}
    refs = sorted(r.ref_value for r in accepted.collect())
    assert len(refs) == len(set(refs)) and refs[0] > start
    numbered = spark.read.parquet(f"{root}/accepted").count() + spark.read.parquet(
        f"{root}/rejected").where("ref_value IS NOT NULL").count()
    assert max(refs) <= start + numbered


def test_index_takes_long_grams_where_short_ones_are_common(spark):
    spark.sparkContext.setCheckpointDir(ensure_checkpoint_dir(spark))
    decl = spark.range(1024).select(F.concat(F.lit("XKPR"), F.lpad(F.bin("id"), 10, "0")).alias("charge_reference"), F.lit("Azz").alias("last_name"))
    asked = spark.createDataFrame([("zz", "X[A-Z]PR+0110100101")], "lastName string, referenceNumber string")
    found, chosen = LK._index_lane(asked, decl)
    assert chosen.count() == 1  # every short gram is held by more than one row in eight: it was scanned for
    assert [r.charge_reference for r in found.collect()] == ["XKPR0110100101"]
