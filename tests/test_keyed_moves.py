"""Changes of a keyed table write the rows that change, and move no others."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from passlane.operators import intake as I
from passlane.plans import queries as Q
from passlane.plans.inputs import Inputs
from passlane.sources import keyed
from passlane.sources.keyed import KeyedTable, names_in
from passlane.streaming import jobs as ST
from tests.conftest import SF
from tests.test_document_cost import names, nodes

SCHEMA = "ref_value int, state string, data string"


def table_of(spark, rows, buckets=4):
    table = KeyedTable(spark, f"{ST.stream_root(spark, 'keyed')}/t", "ref_value", buckets)
    table.create(spark.createDataFrame(rows, SCHEMA).repartition(3))
    return table


def rows_of(df):
    return sorted(tuple(r) for r in df.select("ref_value", "state", "data").collect())


def stored(table, version):
    return table.spark.read.parquet(f"{table.path}/data/v={version}").count()


def test_rows_that_stay_are_not_written_again(spark):
    rows = [(k, "paid", f"d{k}") for k in range(200)]
    table = table_of(spark, rows)
    table.delete(spark.createDataFrame([(k,) for k in range(0, 40)], "ref_value int"))
    assert stored(table, 1) == 40 and table.read().count() == 160
    table.replace(spark.createDataFrame([(k, "sent", "x") for k in range(30, 50)], SCHEMA))
    assert stored(table, 2) == 10
    assert rows_of(table.read()) == sorted([(k, "sent", "x") for k in range(40, 50)] + [r for r in rows if r[0] >= 50])
    assert rows_of(table.insert(spark.createDataFrame([(3, "new", "n"), (60, "new", "n")], SCHEMA))) == [(3, "new", "n")]
    assert rows_of(table.read(0)) == rows and table.read(1).count() == 160


def test_a_table_that_changes_often_is_written_anew_now_and_then(spark, monkeypatch):
    monkeypatch.setattr(keyed, "FOLD_AFTER", 3)
    table, want = table_of(spark, [(k, "a", "b") for k in range(60)], buckets=2), {k: (k, "a", "b") for k in range(60)}
    for n in range(10):
        gone = table.delete(spark.createDataFrame([(n,), (59 - n,)], "ref_value int"))
        assert {r.ref_value for r in gone.collect()} == {n, 59 - n}
        table.replace(spark.createDataFrame([(30, "r", str(n)), (31, "r", str(n))], SCHEMA))
        want = {k: v for k, v in want.items() if k not in (n, 59 - n)} | {30: (30, "r", str(n)), 31: (31, "r", str(n))}
        assert rows_of(table.read()) == sorted(want.values())
        held, marks = table.held(table.version()), table.marks(table.version())
        assert all(len(v) + len(marks.get(b, [])) <= 5 for b, v in held.items())
    table.vacuum(table.version())
    assert rows_of(table.read()) == sorted(want.values())
    assert [n for n in names_in(spark, f"{table.path}/commits") if n.endswith(".json")] == [f"{table.version()}.json"]


@pytest.mark.parametrize("change", ["create", "delete", "replace", "insert"])
def test_documents_are_written_by_the_task_that_has_them(spark, change, monkeypatch):
    table = table_of(spark, [(k, "paid", f"d{k}") for k in range(50)])
    plans, write = [], KeyedTable._write
    monkeypatch.setattr(KeyedTable, "_write", lambda self, rows, *a, **b: plans.append(
        rows._jdf.queryExecution().executedPlan().toString()) or write(self, rows, *a, **b))
    path = f"{ST.stream_root(spark, 'keyed')}/new"
    table.read().write.parquet(path)
    new = spark.read.parquet(path)
    if change == "create":
        KeyedTable(spark, f"{path}-table", "ref_value", 4).create(new)
    elif change == "insert":
        table.insert(new.withColumn("ref_value", F.col("ref_value") + 100))
    else:
        getattr(table, change)(new)
    assert plans
    for plan in plans:
        assert not any("data#" in line and ("hashpartitioning" in line or "REBALANCE" in line or "Sort [" in line) for line in plan.splitlines())


def test_jobs_that_change_a_table_do_not_store_it_twice(spark, tmp_path):
    folder = tmp_path / "sf"
    shutil.copytree(SF, folder)
    for name in ("delete_rows", "replaced_images", "stream_timeouts"):
        Q.REGISTRY[name](spark, str(folder)).count()
    assert Inputs(spark, str(folder))._finished("declarations") is None


def test_amendments_are_accepted_without_moving_their_documents(spark):
    plan = Q.REGISTRY["accept_amendments"](spark, SF)._jdf.queryExecution().optimizedPlan()
    joined = [names(p.children().apply(k)) for p in nodes(plan) if p.nodeName() == "Join" for k in (0, 1)]
    assert joined and not [n for n in joined if n & {"raw", "data", "amend_data", "journey_data", "__journey_data", "__data", "__parsed", "__doc"}]


def test_the_last_amendment_of_a_key_wins(spark):
    def body(n):
        return json.loads(raw[0]) | {"journeyData": {"n": n}}

    i = Inputs(spark, SF)
    good = i.raw_amendments.where("seq % 35 <> 0 AND seq % 53 <> 0 AND seq % 45 <> 0 AND seq % 37 <> 0 AND seq % 13 = 1").limit(1).collect()[0]
    raw = [good.raw]
    rows = spark.createDataFrame([(7, "a", json.dumps(body(1))), (9, "b", json.dumps(body(2))), (8, "c", json.dumps(body(3)))],
                                 "seq long, correlation_id string, raw string")
    after, _ = I.accept_amendments(rows, i.declarations, i.locks.limit(0), i.as_of)
    got = after.select("amend_correlation_id", "journey_data").collect()
    assert [tuple(r) for r in got] == [("b", '{"n":2}')]
