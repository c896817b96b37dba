"""What the checks of documents carry along, and what they settle by the text alone."""

import json

from pyspark.sql import functions as F

from passlane.operators import validate as V
from passlane.plans import queries as Q
from passlane.plans.inputs import Inputs
from tests.conftest import SF


def nodes(plan):
    yield plan
    below = plan.children()
    for k in range(below.size()):
        yield from nodes(below.apply(k))


def names(plan):
    out = plan.output()
    return {out.apply(k).name() for k in range(out.size())}


def document(spark):
    body = json.loads(Inputs(spark, SF).raw_amendments.where("seq % 53 <> 0 AND raw LIKE '%declarationItemOther%'").first().raw)
    return body, body["simpleDeclarationRequest"]["requestDetail"]


def test_levels_and_rules_are_no_columns(spark):
    v = V.validate_documents(Inputs(spark, SF).raw_amendments, "raw").select("seq", F.size("errors").alias("n"))
    made = set().union(*(names(p) for p in nodes(v._jdf.queryExecution().optimizedPlan())))
    assert not {n for n in made if n.startswith(("__lvl", "__rules"))}


def test_whole_documents_of_any_form_and_length_are_settled(spark):
    body, detail = document(spark)
    items = detail["declarationOther"]["declarationItemOther"]
    turned = lambda x: {k: turned(x[k]) for k in reversed(x)} if isinstance(x, dict) else x
    texts = [json.dumps(turned(body), indent=1)]
    detail["declarationOther"]["declarationItemOther"] = items[:1] * 20_000
    detail["personalDetails"]["lastName"] = 'a "b" \\ c'
    texts.append(json.dumps(body))
    detail["declarationOther"]["declarationItemOther"] = items[:1] * 20_000 + [{"quantity": 5}]
    texts.append(json.dumps(body))
    docs = spark.createDataFrame(list(enumerate(texts)), "seq int, raw string")
    sound, _ = V._with_verdict(V.with_variant(docs, "raw", "__parsed"), V.SchemaCompiler(V.REQUEST_SCHEMA), "raw", False)
    assert [r[0] for r in sound.orderBy("seq").select("__sound").collect()] == [True, True, False]


def test_parts_without_a_violation_are_settled_by_themselves(spark):
    body, detail = document(spark)
    detail["declarationHeader"]["portOfEntri"] = "x"
    detail["customerReference"] = json.dumps(detail["customerReference"])  # the text of an object is none
    docs = V.with_variant(spark.createDataFrame([(json.dumps(body),)], "raw string"), "raw", "__parsed")
    check = V.FastCheck(V.SchemaCompiler(V.REQUEST_SCHEMA))
    at = "/simpleDeclarationRequest/requestDetail/"
    found = set(docs.select(F.expr(check.settled_sql("__parsed", "raw"))).first()[0])
    assert {at + "declarationOther", at + "liabilityDetails"} <= found
    assert not {at + "declarationHeader", at + "customerReference"} & found
    errors = V.validate_documents(docs.drop("__parsed"), "raw").first().errors
    assert [(e.path, e.rule) for e in errors] == [(at + "customerReference", "type"), (at + "declarationHeader", "additionalProperties")]


def test_no_document_meets_the_locks_or_the_responses(spark):
    plan = Q.REGISTRY["classify_responses"](spark, SF)._jdf.queryExecution().optimizedPlan()
    joined = [names(p.children().apply(k)) for p in nodes(plan) if p.nodeName() == "Join" for k in (0, 1)]
    assert joined and not [n for n in joined if n & {"data", "amend_data", "journey_data", "__parsed", "__doc"}]
