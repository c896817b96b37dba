import hashlib
import re

from pyspark.sql import functions as F

from passlane.llm import exact_dedup as X


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((doc_id, text or ""))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(d, keep, len(members), d == keep, sha) for d, _ in members]
    return sorted(out, key=repr)


def test_copies_match_brute_force(docs, clashing):
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    for frame in (docs, clashing):
        assert sorted((tuple(r) for r in X.copies(frame).collect()), key=repr) == want


def test_whole_table_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted((tuple(r) for r in X.copies(docs).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_hash_collisions_do_not_merge(docs):
    weak = lambda c: F.substring(F.md5(c), 1, 0).cast("binary")  # noqa: E731  all texts collide
    assert sorted(map(repr, X.copies(docs, weak).collect())) == sorted(map(repr, X.copies(docs).collect()))
    assert X.drop_copies(docs, weak).count() == X.drop_copies(docs).count()


def test_one_row_of_each_class_stays(docs, clashing, no_docs):
    kept = X.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([2, 6, 7, 8, 9, None, 10], key=str)
    assert X.drop_copies(clashing).columns == clashing.columns
    assert X.drop_copies(no_docs).count() == 0 and X.copies(no_docs).count() == 0
