import zlib
from collections import defaultdict

from passlane.llm import sharding as S


def test_longest_first_goes_to_the_least_loaded():
    assert S.longest_first([7, 5, 4, 3, 1], 2) == [0, 1, 1, 0, 1]


def check(rows, docs, shards):
    texts = sorted((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) if r.doc_id is not None
                   else (-1, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    got = sorted((-1 if r.doc_id is None else r.doc_id, r["size"], r.text_crc32) for r in rows)
    assert got == texts
    slots, home = defaultdict(list), defaultdict(set)
    for r in rows:
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        home[r.text_crc32, r["size"]].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in home.values())


def test_edges(docs, clashing, no_docs):
    for frame in (docs, clashing):
        check(S.shard_documents(frame, shards=4).collect(), docs, 4)
    assert S.shard_documents(no_docs, shards=4).count() == 0


def test_sizes_are_near_equal(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = S.shard_documents(docs, shards=24, resolution=20).collect()
    check(rows, docs, 24)
    load = defaultdict(int)
    for r in rows:
        load[r.shard] += r["size"]
    assert len(load) == 24 and max(load.values()) < 1.02 * min(load.values())


def test_slots_of_a_large_shard_are_gapless(spark):
    from pyspark.sql import functions as F

    from passlane.llm.common import cut, number_rows

    rows = cut(spark.range(5000).select((F.col("id") % 3 == 0).alias("k"), "id"))
    got = number_rows(rows, ["k"], ["id"], "n", rows_per_slice=300).groupBy("k").agg(
        F.min("n"), F.max("n"), F.count_distinct("n"), F.count("*")).collect()
    assert all((r[1], r[2] + 1, r[3]) == (0, r[4], r[4]) for r in got)
