"""Building the stand-in tables shuffles bare columns, never item structs or documents."""

import pytest
from pyspark.sql import functions as F

from passlane.plans.inputs import Inputs
from passlane.sources import bridge
from passlane.sources.tables import DriverTables

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["declarations", "raw_submissions", "raw_amendments"])
def test_no_document_below_a_shuffle_or_sort(spark, name):
    plan = getattr(bridge, name)(DriverTables(spark, SF))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in plan]
    moves = [k for k, line in enumerate(plan) if "Repartition" in line or "Sort [" in line or " Join " in line]
    assert moves
    for k in moves:
        below = [line for line, d in zip(plan[k + 1:], depth[k + 1:], strict=True) if d > depth[k]]
        assert not any("to_json" in line or "commodityDescription" in line for line in below)


def test_items_are_in_line_order_with_nulls_and_repeated_lines(spark):
    ship = "timestamp_ntz'1997-01-02 00:00:00'"
    spark.sql(f"""SELECT * FROM VALUES (1L, 3L, 2L, 2, 5.0D, 100.0D, 0.05D, 0.02D, {ship}), (1L, 4L, 1L, 1, 6.0D, 50.5D, 0.1D, 0.0D, {ship}),
        (1L, 4L, 1L, 1, 6.0D, 50.5D, 0.1D, 0.0D, {ship}), (1L, NULL, 1L, 3, 6.0D, 10.0D, NULL, 0.0D, {ship}), (NULL, 1L, 1L, 1, 1.0D, 1.0D, 0.1D, 0.1D, {ship})
        AS t(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate)""").createOrReplaceTempView("lines_here")

    class Tables:
        lineitem = spark.table("lines_here")

    made = bridge.with_items(bridge.order_items(Tables()).withColumnRenamed("l_orderkey", "o_orderkey")).where("o_orderkey = 1").first()
    assert [x.commodityDescription for x in made.items_alcohol] == ["Part 3"]
    assert [x.commodityDescription for x in made.items_tobacco] == ["Part 4", "Part 4"]
    assert made.items_other == [] and [x.iid for x in made.products] == ["1-3", "1-2", "1-1", "1-1"]
    assert (str(made.total_excise), str(made.excise_1), str(made.vat_0)) == ("15.10", "10.10", "2.00")


def test_stored_documents_are_compressed_well(spark):
    found = Inputs(spark, SF).raw_submissions.inputFiles()
    assert found and all(".zstd." in f for f in found)


def test_a_task_holds_a_bounded_number_of_lines_however_small_their_bytes(spark):
    """600,000 lines are under 64 MB when shuffled: put together by bytes alone they were one task, whose
    sorts grow with the table until they spill."""
    n, by_bytes = 600_000, "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    lines = spark.range(n).selectExpr(
        "id DIV 4 AS l_orderkey", "id % 20000 AS l_partkey", "id % 1000 AS l_suppkey", "CAST(id % 4 AS INT) AS l_linenumber", "1.0D AS l_quantity",
        "9.5D AS l_extendedprice", "0.1D AS l_discount", "0.0D AS l_tax", "timestamp_ntz'1997-01-02 00:00:00' AS l_shipdate")

    class Tables:
        lineitem = lines
        orders = spark.range(n // 4).selectExpr("id AS o_orderkey", "id % 100 AS o_custkey", "timestamp_ntz'1997-01-01 00:00:00' AS o_orderdate",
                                                "'1-URGENT' AS o_orderpriority", "5.0D AS o_totalprice")
        customer = spark.range(100).selectExpr("id AS c_custkey", "'Customer#000000001' AS c_name", "1 AS c_nationkey", "1.0D AS c_acctbal")

    spark.conf.set(by_bytes, "false")
    try:
        held = bridge.base_rows(Tables()).groupBy(F.spark_partition_id().alias("task")).agg(
            F.sum(F.size("lines")).alias("lines"), F.count("*").alias("orders")).collect()
    finally:
        spark.conf.unset(by_bytes)
    assert sum(x.lines for x in held) == n and sum(x.orders for x in held) == n // 4
    assert max(x.lines for x in held) < 300_000
