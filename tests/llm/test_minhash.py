import random

import numpy as np
import pytest

from passlane.llm import minhash as M
from passlane.llm.components import connected


def sets_of(rows, words):
    out = []
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        k = min(len(w), words)
        out.append((doc_id, frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else frozenset()))
    return out


def brute(rows, words, percent):
    """(doc_id, set size, smallest doc_id reachable) by comparing all pairs."""
    sets = sets_of(rows, words)
    top = list(range(len(sets)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, (_, s) in enumerate(sets):
        for j in range(i):
            t = sets[j][1]
            if s and t and min(len(s), len(t)) * 100 >= percent * max(len(s), len(t)):
                both = len(s & t)
                if 100 * both >= percent * (len(s) + len(t) - both):
                    top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(s), least.get(find(i))) for i, (d, s) in enumerate(sets)), key=repr)


def found(frame, *args):
    rows = M.near_duplicates(frame, *args).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=repr)


def edited(r, base, n):
    out = list(base)
    for _ in range(n):
        out[r.randrange(len(out))] = f"new{r.random()}"
    return " ".join(out)


def test_edges(docs, clashing, no_docs):
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 3, 85)
    assert found(docs, 3, 85, 5) == want == found(clashing, 3, 85, 5)
    assert found(no_docs, 3, 85, 5) == []
    kept = M.drop_near_copies(clashing)
    assert kept.columns == clashing.columns
    # the rows of doc 1 are one set; documents without shingles stay
    assert {r.doc_id for r in kept.collect()} == {1, 4, 5, 6, 7, 8, 9, None, 10}


@pytest.mark.parametrize(("words", "percent", "rows"), [(3, 85, 5), (5, 80, 4)])
def test_chains_of_near_copies(spark, words, percent, rows):
    """Groups around the threshold, drifting chains, and a passage that many documents share."""
    r = random.Random(words)
    texts, passage = [], " ".join(f"p{k}" for k in range(60))
    for g in range(12):
        base = [f"w{r.randrange(900)}" for _ in range(120)]
        texts += [edited(r, base, r.randrange(6)) for _ in range(12)]
        last = base
        for _ in range(8):  # each differs little from the one before
            last = edited(r, last, 2).split()
            texts.append(" ".join(last))
        texts += [passage + " " + " ".join(f"u{r.random()}" for _ in range(r.randrange(5, 60))) for _ in range(4)]
    data = list(enumerate(texts))
    r.shuffle(data)
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    assert found(frame, words, percent, rows) == brute(data, words, percent)


def test_estimate_is_near_the_similarity(spark):
    a, b = M._coefficients(140)
    x = M.mix(np.arange(1, 2001, dtype=np.uint64))
    rows = [(*(M.pack(M.minima(s, a, b), 2).tolist() for s in (x[:1000], x[k:1000 + k])), (1000 - k) / (1000 + k))
            for k in (0, 50, 200, 500, 1000)]
    frame = spark.createDataFrame(rows, "p array<long>, q array<long>, s double")
    for got, want in frame.select(M.estimate(frame.p, frame.q, 140, 2), "s").collect():
        assert abs(got - want) < 0.2


def test_components(spark):
    r = random.Random(4)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(500, 560)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    got = {(r.node, r.component) for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(x, find(x)) for a, b in links if a != b for x in (a, b)}
