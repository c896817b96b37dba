import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from passlane.llm import ann

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, every, k):
    """Nearest others of each usable vector, by exact inner products."""
    x = {i: np.asarray(v, np.float64) for i, v in rows}
    out = {}
    for q in x:
        if q % every == 0:
            scored = sorted((-float(v @ x[q]), i) for i, v in x.items() if i != q)[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


def answers(frame, every, **kw):
    out = {}
    for r in ann.nearest(frame, F.pmod(F.col("vec_id"), F.lit(every)) == 0, **kw).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_on_the_whole_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    # small cells and a small beam, so that the graph has to do the work
    got, want = answers(frame, 20, cell=60, trees=4, degree=16, beam=128), brute(rows, 20, 20)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    x = dict(rows)
    for q, found in got.items():
        assert len(found) == 20 and found == sorted(found, key=lambda a: (-a[1], a[0]))
        for i, s in found:
            assert abs(s - float(np.dot(np.asarray(x[q], np.float64), np.asarray(x[i], np.float64)))) < 1e-12


def test_copies_ties_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(k, [1.0, 0.0, 0.5]) for k in range(0, 60)] + [(k, [0.0, float(k - 59), 0.25]) for k in range(60, 70)]
    odd = [(100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0, nan, 0.0]), (103, [inf, 0.0, 0.0]), (104, [1.0, None, 0.0]),
           (105, [1.0]), (106, []), (None, [1.0, 1.0, 1.0]), (0, [1.0, 0.0, 0.5])]
    frame = spark.createDataFrame(good + odd, SCHEMA).withColumn("score", F.lit(0)).withColumn("node", F.lit(1))
    got, want = answers(frame, 5), brute(good, 5, 20)
    assert {q: [i for i, _ in a] for q, a in got.items()} == {q: [i for i, _ in a] for q, a in want.items()}


def test_few_and_no_rows(spark):
    assert answers(spark.createDataFrame([], SCHEMA), 1) == {}
    assert answers(spark.createDataFrame([(0, [1.0, 2.0])], SCHEMA), 1) == {}
    two = [(0, [1.0, 2.0]), (1, [3.0, 1.0])]
    assert answers(spark.createDataFrame(two, SCHEMA), 1) == {0: [(1, 5.0)], 1: [(0, 5.0)]}


def test_batches_of_queries_agree(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(200)
    assert answers(frame, 10, batch=7, block_size=64) == answers(frame, 10)


def test_search_goes_on_while_anything_is_open(spark):
    """A path of 16 nodes whose scores grow along it takes 15 hops."""
    near = [(k, [j for j in (k - 1, k + 1) if 0 <= j < 16]) for k in range(16)]
    graph = spark.createDataFrame([(k, j, [0.0] * len(j)) for k, j in near], ann.LISTS)
    nodes = spark.createDataFrame([(k, np.array([1.0 + k]).tobytes()) for k in range(16)], "node long, vec binary").select(
        "node", ann._block(F.col("node"), 2).alias("block"), "vec")
    queries = spark.createDataFrame([(0,)], "query long")
    best = ann.search(queries, graph, nodes, blocks=2, degree=2, beam=2, batch=10).first()
    assert np.frombuffer(best["ids"], "<i8").tolist() == [15, 14]


def unit_vectors(n):
    x = np.random.Generator(np.random.PCG64(5)).normal(size=(n, 64)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def recall(spark, n, every, **kw):
    x = unit_vectors(n)
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": list(x)})).repartition(8)
    got, hits = answers(frame, every, **kw), 0
    asked = np.arange(0, n, every)
    for part in np.array_split(asked, -(-len(asked) // 200)):  # blocked brute force
        s = x[part] @ x.T
        s[np.arange(len(part)), part] = -np.inf
        for q, best in zip(part, np.argpartition(-s, 20, axis=1)[:, :20], strict=True):
            hits += len({i for i, _ in got[int(q)]} & set(best.tolist()))
    return hits / (20 * len(asked))


def test_cells_beyond_the_sample_are_split_by_place():
    r = np.random.Generator(np.random.PCG64(1))
    x = unit_vectors(3000)
    leaves = list(ann._leaves(x, 100, r))
    assert sorted(np.concatenate(leaves).tolist()) == list(range(3000)) and max(map(len, leaves)) <= 100
    inside = np.mean([(x[k] @ x[k].T).sum() / len(k) ** 2 for k in leaves])
    assert inside > 0.05  # of random groups: 1 / len(k), about 0.01


def test_recall_of_production_defaults_on_many_flat_vectors(spark):
    assert recall(spark, 50_000, 100) >= 0.9
