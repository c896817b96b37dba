"""Numbers find their rows without moving documents, for any order keys."""

import random

import pytest
from pyspark.sql import functions as F

from passlane.operators import intake as I


def numbered(spark, keys, kind="long", partitions=7):
    rows = spark.createDataFrame([(k, f"document {k}") for k in keys], f"seq {kind}, raw string").repartition(partitions)
    return I.assign_references(rows, 100, ["seq"])


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["int", "long"])
def test_documents_stay_where_they_are_read(spark, kind):
    dice = random.Random(1)
    keys = sorted({*dice.sample(range(-70_000, 200_000), 3000), -32769, -32768, -1, 0, 7, 8, 32767, 32768, 65535, 65536})
    got = numbered(spark, keys, kind)
    assert got.columns == ["seq", "raw", "ref_value"] and got.schema["ref_value"].dataType.simpleString() == "int"
    assert {r.seq: r.ref_value for r in got.collect()} == {k: 101 + n for n, k in enumerate(keys)}
    lines = plan_of(got).splitlines()
    assert not any("raw#" in line and ("Sort [" in line or "hashpartitioning" in line) for line in lines)


def test_keys_far_apart_are_numbered_too(spark, monkeypatch):
    keys = [k * 10**9 for k in range(-20, 20)]
    assert {r.seq: r.ref_value for r in numbered(spark, keys).collect()} == {k: 101 + n for n, k in enumerate(keys)}
    monkeypatch.setattr(I, "MOST_BLOCKS", 39)
    got = numbered(spark, keys)
    assert "hashpartitioning" in plan_of(got)
    assert {r.seq: r.ref_value for r in got.collect()} == {k: 101 + n for n, k in enumerate(keys)}


def test_keys_that_repeat_or_are_null_are_joined_as_before(spark):
    got = sorted((r.seq, r.ref_value) for r in numbered(spark, [5, 9, 5, 7]).collect())
    assert got == [(5, 101), (5, 101), (5, 102), (5, 102), (7, 103), (9, 104)]
    got = [(r.seq, r.ref_value) for r in numbered(spark, [5, None, 7]).orderBy("ref_value").collect()]
    assert got == [(None, 101), (5, 102), (7, 103)]
    assert numbered(spark, []).where("seq > 0").collect() == []


def test_bodies_are_looked_at_once_for_their_numbers(spark):
    seen = spark.sparkContext.accumulator(0)
    look = F.udf(lambda s: seen.add(1) or s, "string")
    rows = spark.createDataFrame([(k, "x") for k in range(500)], "seq long, raw string").repartition(3)
    got = I.assign_references(rows.where(look.asNondeterministic()("raw") == "x"), 0, ["seq"])
    assert seen.value == 500
    assert got.agg(F.max("ref_value")).first()[0] == 500
