"""The flat predicate of the validation: true only without a violation, and errors are as without it."""

import copy
import json
import random

from pyspark.sql import functions as F

from passlane.operators import documents as D
from passlane.operators import validate as V
from passlane.plans.inputs import Inputs
from tests.conftest import SF

VALUES = [None, 5, 1.5, True, "", "x", "x" * 300, "nullify", {}, [], {"a": {"b": 1}}, [None], [{}], ["a"], [{"paramName": None}],
          "2020-01-01", "2020-13-01T00:00:00Z", "12.345", "-1.2", "GB", {"simpleDeclarationRequest": {}}]


def paths(node, at=()):
    yield at
    for k, v in node.items() if isinstance(node, dict) else enumerate(node) if isinstance(node, list) else ():
        yield from paths(v, (*at, k))


def edited(rng, doc):
    doc = copy.deepcopy(doc)
    for _ in range(rng.choice([0, 1, 1, 2])):
        at = rng.choice([p for p in paths(doc) if p] or [()])
        if not at:
            return doc
        parent = doc
        for k in at[:-1]:
            parent = parent[k]
        how = rng.random()
        if how < 0.3:
            del parent[at[-1]]
        elif how < 0.8:
            parent[at[-1]] = rng.choice(VALUES)
        elif isinstance(parent, dict):
            parent[rng.choice(["extra", "a b", "zz", "portOfEntryName", "z9"])] = rng.choice(VALUES)
        else:
            parent.append(rng.choice(VALUES))
    return doc


def stamped(doc):
    doc["simpleDeclarationRequest"]["requestCommon"]["acknowledgementReference"] = "XAPR00000000010"
    doc["simpleDeclarationRequest"]["requestDetail"]["declarationHeader"]["chargeReference"] = "XAPR0000000001"
    return doc


def test_errors_are_the_same_with_and_without_it(spark, monkeypatch):
    rng = random.Random(7)
    raw = [r.raw for r in Inputs(spark, SF).raw_submissions.where("seq % 31 <> 0").limit(60).collect()]
    texts = [json.dumps(edited(rng, stamped(json.loads(rng.choice(raw))))) for _ in range(700)]
    texts += ["", "null", "[]", "{}", "no json", "5", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "seq int, raw string").withColumn(
        "ref", F.lit("XAPR0000000001")).repartition(8).persist()
    for schema, ref in ((V.REQUEST_SCHEMA, "ref"), (V.REQUEST_SCHEMA, None), (D.PAYLOAD_SCHEMA, None)):
        fast, sound = V._with_verdict(V.with_document(docs, "raw", ref, keep_parsed=True), V.SchemaCompiler(schema), "raw", ref is not None)
        settled = {r.seq for r in fast.where(sound).select("seq").collect()}
        quick = {r.seq: r.errors for r in V.validate_documents(docs, "raw", ref, schema).select("seq", "errors").collect()}
        with monkeypatch.context() as m:
            m.setattr(V.FastCheck, "columns", lambda *a: None)
            full = {r.seq: r.errors for r in V.validate_documents(docs, "raw", ref, schema).select("seq", "errors").collect()}
        assert quick == full
        assert len(settled) > 100 and not [s for s in settled if full[s]]


def test_a_document_is_parsed_once(spark):
    d = Inputs(spark, SF).declarations
    for df, texts in ((D.goods_items(d), 1), (D.receipt_parameters(D.amendment_or_original(d)), 1), (D.previous_declaration_view(d), 2),
                      (D.refine_payload(d, "data"), 1)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == texts


def test_the_age_filter_reaches_the_scan(spark):
    from passlane.operators import worklists as W

    i = Inputs(spark, SF)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = W.retention_expired(i.declarations, i.as_of)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "LessThan(receipt_at" in plan and "get_json_object" not in plan
    bare = W.retention_expired(i.declarations.drop("receipt_at"), i.as_of)
    assert {r.ref_value for r in bare.collect()} == {r.ref_value for r in W.retention_expired(i.declarations, i.as_of).collect()}
