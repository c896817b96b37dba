import zlib

import numpy as np
from pyspark.sql import functions as F

from passlane.llm import language as L


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = L.identify(docs, L.learn(docs, per_language=40)).where(L.held_out(docs["doc_id"])).collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_forward_backward_against_all_paths():
    r = np.random.Generator(np.random.PCG64(3))
    scores, moves = r.normal(size=(1, 4, 3)), r.normal(size=(3, 3))
    want, total = np.zeros((4, 3)), 0.0
    for path in np.ndindex(3, 3, 3, 3):
        p = np.exp(sum(scores[0, t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += p
        for t, y in enumerate(path):
            want[t, y] += p
    got, expected = L.marginals(scores, np.array([4]), moves)
    assert np.allclose(got[0], want / total) and np.isclose(expected.sum(), 3)
    assert np.allclose(L.marginals_only(scores, np.array([4]), moves)[0], want / total)


def test_padded_chains_do_not_change_marginals():
    r = np.random.Generator(np.random.PCG64(4))
    scores, moves = r.normal(size=(2, 5, 3)), r.normal(size=(3, 3))
    both = L.marginals_only(scores, np.array([5, 3]), moves)
    assert np.allclose(both[1, :3], L.marginals_only(scores[1:, :3], np.array([3]), moves)[0])
    assert np.allclose(L.marginals(scores, np.array([5, 3]), moves)[0][1, :3], both[1, :3])


SAMPLES = [("en", "the dog and the cat went to the house with this man and that woman " * 3),
           ("de", "der Hund und die Katze gingen in das Haus mit einem Mann und einer Frau " * 3)]


def test_code_switched_text_is_labelled_by_word(spark):
    frame = spark.createDataFrame([(1, "the cat and the woman; der Mann und die Katze")], "doc_id long, text string")
    spans = L.identify(frame, L.fit(SAMPLES), spans=True).first().lang_spans
    assert [(s.start, s.end, s.lang) for s in spans] == [(0, 21, "en"), (23, 45, "de")]


def test_edges(spark, docs, clashing, no_docs):
    model = L.fit(SAMPLES)
    for frame in (docs, clashing):
        got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(frame, model).collect()}
        assert all(got[k] == ("und", 0.0) for k in (4, 5, 6, 8)) and got[1][0] == "en" and got[9][0] == "de"
    assert L.learn(no_docs) is None
    assert {r.lang_pred for r in L.identify(docs, None).collect()} == {"und"}
    kept = L.keep_identified(clashing)
    assert kept.columns == clashing.columns and {r.score for r in kept.collect()} <= {0}
    assert not {4, 5, 6, 8} & {r.doc_id for r in kept.collect()}
    assert L.keep_identified(no_docs).count() == 0


def test_held_out_rule(spark):
    rows = spark.range(50).select("id", L.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)


MIXED = [("en", "the dog and the cat went to the house with this man and that woman "),
         ("de", "der Hund und die Katze gingen in das Haus mit einem Mann und einer Frau "),
         ("fr", "le chien et le chat sont dans une maison avec cet homme et cette femme "),
         ("es", "el perro y el gato fueron a la casa con este hombre y aquella mujer ")]


def test_documents_of_several_languages_and_unlabelled_tables_stay(spark):
    rows = [(100 * k + i, text * 5, lang) for k, (lang, text) in enumerate(MIXED) for i in range(12)]
    rows += [(1000, "\n".join(text * 3 for _, text in MIXED), None), (1001, "12 34", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    mixed = L.identify(frame, L.learn(frame)).where("doc_id = 1000").first()
    kept = {r.doc_id for r in L.keep_identified(frame).collect()}
    assert mixed.score < 0.4 and 1000 in kept and 1001 not in kept
    unlabelled = frame.withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in L.keep_identified(unlabelled).collect()} == {r[0] for r in rows} - {1001}
