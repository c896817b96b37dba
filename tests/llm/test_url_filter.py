from pyspark.sql import functions as F

from passlane.llm import url_filter as U

ENTRIES = "entry_id long, kind string, key string, action string, at long"


def keys_of(spark, url):
    r = spark.createDataFrame([(url,)], "url string").select(U.keys(F.col("url")).alias("k")).first()
    return None if r.k is None else {(x.kind, x.key) for x in r.k}


def test_keys(spark):
    assert keys_of(spark, "HTTPS://u:p@A.b.Example.com:80/x/y.html?q=/z#f") == {
        ("url", "a.b.example.com/x/y.html?q=/z"), ("host", "a.b.example.com"), ("prefix", "a.b.example.com/"),
        ("prefix", "a.b.example.com/x/"), ("domain", "a.b.example.com"), ("domain", "b.example.com"), ("domain", "example.com")}
    assert keys_of(spark, "http://localhost") == {
        ("url", "localhost/"), ("host", "localhost"), ("prefix", "localhost/"), ("domain", "localhost")}
    assert keys_of(spark, None) is None and keys_of(spark, "no url") is None


def test_as_of(spark):
    entries = [(1, "domain", "bad.com", "add", 100), (2, "domain", "bad.com", "remove", 10_000_000),
               (3, "domain", "bad.com", "add", 90_000_000), (4, "prefix", "ok.com/x/", "add", 50), (5, "host", "ok.com", "add", 60),
               (6, "host", "ok.com", "remove", 60), (7, "host", "ok.com", None, 70), (4, "prefix", "ok.com/x/", "add", 50)]
    captures = [(1, "http://a.bad.com/p", 99), (2, "http://a.bad.com/p", 100), (3, "http://a.bad.com/p", 9_999_999),
                (4, "http://a.bad.com/p", 10_000_000), (5, "http://bad.com/", 95_000_000), (6, "http://ok.com/x/y", 80),
                (7, "http://ok.com/z", 80), (8, None, 80), (9, "http://bad.com/", None), (2, "http://a.bad.com/p", 100),
                (None, "http://bad.com", 100)]
    frame = spark.createDataFrame(captures, "page_id long, url string, fetched_at long").withColumn("kind", F.lit("x"))
    rows = U.filter_captures(frame, spark.createDataFrame(entries, ENTRIES).withColumn("url", F.lit(1))).collect()
    got = sorted((str(r.page_id), r.blocked, r.n_active, r.rule, r.since) for r in rows)
    assert got == sorted([
        ("1", False, 0, None, None), ("2", True, 1, "domain:bad.com", 100), ("2", True, 1, "domain:bad.com", 100),
        ("3", True, 1, "domain:bad.com", 100), ("4", False, 0, None, None), ("5", True, 1, "domain:bad.com", 90_000_000),
        ("6", True, 1, "prefix:ok.com/x/", 50), ("7", False, 0, None, None), ("8", False, 0, None, None),
        ("9", False, 0, None, None), ("None", True, 1, "domain:bad.com", 100)])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string, fetched_at long")
    log = spark.createDataFrame([], ENTRIES)
    assert U.filter_captures(none, log).count() == 0
    one = spark.createDataFrame([(1, "http://a.com/", 5)], none.schema)
    assert [r.blocked for r in U.filter_captures(one, log).collect()] == [False]
