from pyspark.sql import functions as F

from passlane.functions.refs import decode_reference, encode_reference

CHECK = {1: "Y", 2: "Q", 3: "S", 4: "Z", 5: "W", 6: "B", 7: "D", 8: "F", 9: "H", 10: "P",
         30: "V", 50: "E", 70: "K", 80: "N", 14: "A", 15: "C", 17: "G", 18: "X", 27: "J",
         28: "L", 37: "M", 47: "P", 48: "R", 49: "T", 58: "Z"}


def test_check_characters(spark):
    df = spark.createDataFrame([(k,) for k in CHECK], "v int")
    got = {r.v: r.r for r in df.select("v", encode_reference(F.col("v")).alias("r")).collect()}
    assert {k: v[1] for k, v in got.items()} == CHECK
    assert got[1] == "XYPR0000000001"


def test_format(spark):
    r = spark.range(1).select(encode_reference(F.lit(1234567890)).alias("r")).first().r
    assert r == "XHPR1234567890"


def test_rejected_forms(spark):
    bad = ["1234567890123", "123456789012345", "XAXR1234567890", "XAPX1234567890",
           "XAPRX000000001", "XAPR0000000001", "XAPR9999999999", "xypr0000000001", None]
    df = spark.createDataFrame([(s,) for s in bad], "s string")
    assert [r.v for r in df.select(decode_reference(F.col("s")).alias("v")).collect()] == [None] * len(bad)
    ok = spark.createDataFrame([("XYPR0000000001",)], "s string")
    assert ok.select(decode_reference(F.col("s")).alias("v")).first().v == 1


def test_round_trip_property(spark):
    """decode(encode(v)) == v over a spread of values up to the 32-bit limit."""
    df = spark.range(0, 200_000).select(
        ((F.col("id") * 10_737) % 2_147_483_647).cast("int").alias("v"))
    rt = df.select("v", decode_reference(encode_reference(F.col("v"))).alias("back"))
    assert rt.where(F.col("back").isNull() | (F.col("back") != F.col("v"))).count() == 0
