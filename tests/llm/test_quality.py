import math
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from passlane.llm import quality as Q


def brute_measure(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            len(lines), sum(bool(re.search("[A-Z]", w)) and not re.search("[a-z]", w) for w in words))


@pytest.mark.parametrize("seed", range(20))
def test_measures_match_brute_force(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(Q, "PIECE", rng.choice([1, 7, 1 << 20]))
    parts = ["a", "b", "ab", "É", "NO!!", "x#", "|", "😀", "\x1c", " ", " "]
    text = "".join(rng.choice(parts) + rng.choice([" ", "  ", "\n", "\t", "\r\n", "\x0b", "\n\n", ""]) for _ in range(rng.choice([0, 4, 9, 60, 200])))
    assert Q.measure(text) == brute_measure(text)


def test_odd_texts():
    assert Q.measure(None) == Q.measure("") == (0,) * 7
    assert Q.measure(" \n\t") == (0,) * 7
    assert Q.measure("w" * 3_000_000)[:2] == (1, 3_000_000)
    assert Q.measure("one two three four five " * 3)[4] == 15
    assert Q.measure("a a a a a a")[4] == 6


def exact_tail(k, n, p):
    p = Fraction(p)
    return float(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


@pytest.mark.parametrize("k,n,p", [(0, 10, 0.05), (0, 1000, 0.005), (2, 900, 0.01), (40, 1000, 0.05), (3, 5000, 0.005)])
def test_binomial_tail_is_exact(k, n, p):
    assert Q.binomial_tail(k, n, p) == pytest.approx(exact_tail(k, n, p), rel=1e-9)
    assert Q.binomial_tail(n, n, p) == 1.0
    assert 0 < Q.binomial_tail(4_999_000_000, 1_000_000_000_000, 0.005) < 1e-9


def test_cutoff_respects_the_bound():
    # steps from strict to lenient; 2000 clean documents, level 0.01: at most 2 may be rejected at a risk of 0.5 %
    assert Q.choose([30, 3, 2, 0], [90, 60, 50, 10], 2000, 0.005, 0.01) == 2
    assert Q.choose([0, 0], [9, 5], 100, 0.005, 0.01) is None  # too few labels for any claim
    assert Q.choose([0, 0, 0], [5, 5, 2], 5000, 0.005, 0.01) == 1  # the most lenient of equal gain
    assert Q.choose([1, 0], [0, 0], 5000, 0.005, 0.01) is None


def corpus(spark, n=6000):
    rng = random.Random(1)
    words = ["alpha", "river", "stone", "green", "walks", "under"]
    docs, labels = [], []
    for i in range(n):
        poor = i % 10 == 0
        text = " ".join(rng.choice(words) + str(rng.randrange(900)) + ("#" if poor and rng.random() < 0.8 else "") for _ in range(30))
        docs.append((i, text, rng.choice(["en", "en", "de"]) if i % 500 else None))
        if i % 3:
            labels.append((i, 0 if poor else 1))
    return (spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4),
            spark.createDataFrame(labels, "doc_id long, quality int"))


def test_poor_documents_go_and_clean_ones_stay(spark):
    docs, labels = corpus(spark)
    rows = Q.judge(docs, labels, risk=0.01).collect()
    kept = {r.doc_id: r.kept for r in rows}
    lang = {r.doc_id: r.stratum for r in rows}
    poor = [d for d in kept if d % 10 == 0 and lang[d] is not None]
    clean = [d for d in kept if d % 10]
    assert len(rows) == 6000 and sum(kept[d] for d in poor) == 0
    assert sum(not kept[d] for d in clean) <= 0.01 * len(clean)
    assert all(r.kept for r in rows if r.stratum is None and not r.base_failed)  # no claim without enough labels


def test_labels_decide(spark):
    docs, labels = corpus(spark, 1500)
    assert Q.judge(docs, labels.where("false")).where("not kept and not base_failed").count() == 0
    odd = labels.withColumn("quality", F.lit(None).cast("int")).unionByName(
        spark.createDataFrame([(None, 1)], "doc_id long, quality int"))
    assert Q.judge(docs, odd).where("not kept and not base_failed").count() == 0
    # of several labels the best counts: all clean, so nothing gains
    both = labels.unionByName(labels.withColumn("quality", F.lit(1)))
    assert Q.judge(docs, both, risk=0.05).where("not kept and not base_failed").count() == 0


def test_every_row_has_an_answer(docs, clashing, no_docs, spark):
    labels = spark.createDataFrame([(1, 1), (7, 0)], "doc_id long, quality int")
    for frame in (docs, clashing.withColumn("stratum", F.lit(1)).withColumn("n_words", F.lit(5))):
        rows = Q.judge(frame, labels).collect()
        assert len(rows) == docs.count()
        want = {r.doc_id: brute_measure(r.text) for r in docs.where("doc_id != 7").collect()}
        for r in rows:
            if r.doc_id in want and r.doc_id is not None:
                assert tuple(r[m] for m in Q.MEASURES) == want[r.doc_id]
                assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
                assert r.kept != r.base_failed
    assert Q.judge(no_docs, labels).count() == 0
