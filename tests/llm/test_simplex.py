import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from passlane.llm import simplex as S


def brute(rows, k=8, rounds=10, size=64, scale=1024):
    """The same clustering with every distance in Python integers."""
    kept = []
    for vec_id, x in rows:
        if x is not None and len(x) == size and all(c is not None and math.isfinite(c) for c in x):
            kept.append((vec_id, S.whole(x, scale)))
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in first[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        member = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            own = [v for (_, v), m in zip(kept, member) if m == j]
            if own:
                centroids[j] = [sum(c) // len(own) for c in zip(*own)]
    at = [(i, *near(v)) for i, v in kept]
    total = {}
    for _, d, j in at:
        total[j] = total.get(j, 0) + d
    long = lambda x: x if x <= S.LONG else None
    every = sum(total.values())
    return sorted((i, j, long(d), long(total[j]), long(every), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest())
                  for i, d, j in at)


def got(df):
    return sorted(tuple(r) for r in df.drop("n_compared").collect())


SCHEMA = "vec_id long, embedding array<double>, cluster int, apex string, code int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 0, "a", 1) for i, v in rows], SCHEMA).repartition(parts)


def test_given_table_matches_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert got(S.cluster(rows)) == brute([(r.vec_id, r.embedding) for r in rows.collect()])


def test_clustered_vectors_skip_comparisons(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=64) * 0.02 + (i % 8 == np.arange(64) % 8)).tolist()) for i in range(600)]
    answer = S.cluster(frame(spark, rows)).cache()
    assert got(answer) == brute(rows)
    assert answer.agg(F.avg("n_compared")).first()[0] < 3


@pytest.mark.parametrize("scale", [1e-3, 1e6])
def test_ties_copies_and_flat_pivots(spark, scale):
    rng = np.random.default_rng(2)
    basis = rng.integers(-3, 4, size=(3, 64))  # all vectors in a space of three dimensions
    rows = [(i, (scale * (rng.integers(-2, 3, size=3) @ basis)).tolist()) for i in range(150)]
    rows += [(i, rows[0][1]) for i in range(200, 260)] + [(3, rows[3][1])] * 5 + [(300, [0.0] * 64)]
    assert got(S.cluster(frame(spark, rows), rounds=4)) == brute(rows, rounds=4)


def test_odd_vectors(spark):
    ok = [0.5] * 64
    nan, inf = float("nan"), float("inf")
    rows = [(1, ok), (2, None), (3, []), (4, [1.0] * 63), (5, [1.0] * 65), (6, [nan] + ok[1:]), (7, [inf] + ok[1:]),
            (8, [None] + ok[1:]), (9, [-0.0004] * 64), (10, [0.25] * 64)]
    assert got(S.cluster(frame(spark, rows), rounds=2)) == brute(rows, rounds=2)


def test_huge_components_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=64) * 10.0 ** (i % 9 + 1)).tolist()) for i in range(40)]
    rows += [(100, [1e17] * 64), (101, [-1e300] + [0.0] * 63), (102, [2.0**53 + 2] + [0.0] * 63)]
    assert got(S.cluster(frame(spark, rows), rounds=4)) == brute(rows, rounds=4)


def test_few_and_no_vectors(spark):
    rows = [(1, [0.1] * 64), (2, [0.9] * 64), (2, [0.9] * 64)]
    assert got(S.cluster(frame(spark, rows), rounds=2)) == brute(rows, rounds=2)
    empty = S.cluster(frame(spark, []))
    assert empty.count() == 0 and empty.columns == S.cluster(frame(spark, rows), rounds=0).columns


def test_bounds_hold():
    rng = np.random.default_rng(5)
    points = [rng.integers(-1000, 1000, size=64) for _ in range(40)]
    simplex = S.Simplex(points[:20], 16)
    assert len(simplex.pivots) == 16
    rows, centroids = np.stack(points), np.stack(points[25:33])
    a, c = simplex.place(rows), simplex.place(centroids)
    true = np.stack([S.squared(rows, x) for x in centroids], axis=1).astype(float)
    inside = ((a[:, None, :-1] - c[None, :, :-1]) ** 2).sum(axis=2)
    assert (inside + (a[:, -1:] - c[None, :, -1]) ** 2 <= true + 1).all()
    assert (inside + (a[:, -1:] + c[None, :, -1]) ** 2 >= true - 1).all()
    assert simplex.possible(a, c)[np.arange(40), true.argmin(axis=1)].all()
