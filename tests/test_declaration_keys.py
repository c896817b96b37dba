"""Jobs that read no document work on declarations stored without them: the same rows, and no document is made."""

import datetime as dt

import pytest

import __spark_entry__ as entry
from passlane.plans.inputs import Inputs

ORDERS = ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string")
LINES = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
         "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Every state, a customer that is missing, null dates and rows that come twice."""
    d, day = tmp_path_factory.mktemp("tables"), dt.datetime(1996, 1, 2, 3, 4, 5)
    orders = [(k, k % 7, "O", 100.0 + k, None if k % 29 == 0 else day + dt.timedelta(days=9 * k), "5-LOW") for k in range(240)]
    lines = [(k, 3 * k + n, n, n, 2.0, 10.5 * n, 0.05, 0.02, "N", "O", day) for k in range(240) for n in range(1, 3)]
    customers = [(k, f"Customer#{k:09d}", k, 5.0, "X") for k in range(6)]
    events = [(k, day + dt.timedelta(seconds=k), k % 40, ("purchase", "error", "click", "view")[k % 4], 1.0, "{}") for k in range(300)]
    for name, rows, schema in (("orders", [*orders, *orders[:20]], ORDERS), ("lineitem", lines, LINES),
                               ("customer", customers, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
                               ("events", events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["apply_payments", "payment_outcomes", "remove_expired", "remove_stale_amendments", "stream_payments",
                                  "stream_status", "amend_join", "held_locks"])
def test_no_document_is_made(spark, folder, name):
    assert entry.queries()[name](spark, folder).count() > 0
    assert Inputs(spark, folder)._finished("declarations") is None and Inputs(spark, folder)._finished("declaration_keys")


def test_the_same_rows_as_with_documents(spark, folder):
    i = Inputs(spark, folder, store=False)
    bare, whole = i.declaration_keys, i.declarations
    assert set(whole.columns) - set(bare.columns) == {"journey_data", "data", "amend_data"}
    rows = lambda df: sorted(map(str, df.select(*bare.columns).collect()))
    assert rows(bare) == rows(whole) and bare.count() > 200
    assert bare.where("receipt_at IS NULL").count() > 0


def test_audit_shuffles_no_document(spark, folder):
    plan = entry.queries()["submitted_audit"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" not in plan
