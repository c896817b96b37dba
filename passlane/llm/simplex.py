"""Centroid clustering in exact integers, with centroids filtered by n-simplex projection.

Vectors become integers ``floor(scale * x)``; starts are the rows with the smallest salted
hashes of their ids; every round assigns each vector to the nearest centroid and moves each
non-empty centroid to the floor of its members' exact mean.

N-simplex projection. A few pivots span a simplex. The distances of a vector to the pivots are
taken once; with the pivots' own distances they fix the vector's place as the apex of a larger
simplex: coordinates inside the pivots' span and one altitude above it. For two apexes the
Euclidean distance with altitudes on the same side is a lower bound of the true distance, and
with altitudes on opposite sides an upper bound. Apexes are stored with the vectors, so a round
needs the apexes of its centroids alone; centroids whose lower bound exceeds the least upper
bound are left out, the others (if more than one) are compared in exact integers.
Bounds are in double precision and widened by more than their rounding error, so that they
never leave out a nearest centroid; pivots that lie almost in the span of earlier ones are not
taken, which keeps that error small.

On Spark: a round is one pass over the stored vectors; tasks add up their members in whole
numbers and a tree of reductions brings together one small state of k sums. Centroids and
pivots (k and at most 16 vectors) travel with the tasks. Nothing else reaches the driver.

Defined results: vectors of another length, null, or holding null or non-finite components take
no part; repeated rows are vectors each, equal starts are centroids each (ties go to the
smaller number, an empty centroid stays); rows without an id are clustered, but start no
centroid unless there are too few others; fewer vectors than centroids give fewer centroids;
components of any size are exact, and a distance or sum beyond a long is null; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passlane.llm.common import cut, ship

#: Components under this size have exact squared distances in 64 bits (up to 128 components).
NARROW = 1 << 27
LONG = (1 << 63) - 1
#: A pivot's altitude above the span of earlier ones, as a part of its distance, at least.
LEAST_ALTITUDE = 0.1
#: Bounds are widened by this part of the largest squared distance at hand.
MARGIN = 1e-4


def whole(x, scale: int) -> list[int]:
    """floor(scale * x) of each component as exact integers."""
    return [math.floor(scale * v) if abs(v) < 2**53 else scale * int(v) for v in map(float, x)]


def packed(rows: DataFrame, size: int, scale: int) -> DataFrame:
    """vec_id, code (components as 32-bit integers) or wide (as decimals, if one is too large)."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            code, wide = [], []
            for x in b["embedding"]:
                v = np.array([np.nan if c is None else c for c in x], np.float64) if x is not None and len(x) == size else None
                ok = v is not None and np.isfinite(v).all()
                small = ok and (np.abs(v) < (NARROW - 1) / scale).all()
                code.append(np.floor(scale * v).astype("<i4").tobytes() if small else None)
                wide.append(",".join(map(str, whole(v, scale))) if ok and not small else None)
            yield pd.DataFrame({"vec_id": b["vec_id"], "code": code, "wide": wide})

    kind = rows.schema["vec_id"].dataType.simpleString()
    out = rows.select("vec_id", "embedding").mapInPandas(run, f"vec_id {kind}, code binary, wide string")
    return out.where(F.col("code").isNotNull() | F.col("wide").isNotNull())


def unpacked(code: bytes | None, wide: str | None) -> np.ndarray:
    """Components as 64-bit integers, or as Python integers if one is too large."""
    return np.frombuffer(code, "<i4").astype(np.int64) if code is not None else np.array([int(c) for c in wide.split(",")], object)


def is_narrow(v: np.ndarray) -> bool:
    return v.dtype != object


def narrowed(v: np.ndarray) -> np.ndarray:
    return v.astype(np.int64) if all(abs(int(c)) < NARROW for c in v) else v.astype(object)


def squared(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row to ``one``."""
    d = rows - one if is_narrow(rows) and is_narrow(one) else rows.astype(object) - one.astype(object)
    return (d * d).sum(axis=1)


class Simplex:
    """A base simplex of pivots; places vectors as apexes over it."""

    def __init__(self, candidates: list[np.ndarray], most: int):
        self.pivots: list[np.ndarray] = []
        self.side = np.empty((0, 0))  # lower triangle: each pivot over the span of the earlier ones
        self.far = 0.0
        for v in candidates:
            if not is_narrow(v) or len(self.pivots) >= most:
                continue
            if not self.pivots:
                self.pivots = [v]
                continue
            apex = self.place(v[None, :])[0]
            reach = float(squared(v[None, :], self.pivots[0])[0])
            if reach == 0 or apex[-1] < LEAST_ALTITUDE * math.sqrt(reach):
                continue
            grown = np.zeros((len(apex), len(apex)))
            grown[:-1, :-1], grown[-1] = self.side, apex
            if np.linalg.cond(grown / math.sqrt(reach)) > 1e3:
                continue
            self.side, self.far = grown, max(self.far, reach)
            self.pivots.append(v)

    def place(self, rows: np.ndarray) -> np.ndarray:
        """Apexes from the distances to the pivots: coordinates in their span, then the altitude."""
        near = [squared(rows, p).astype(np.float64) for p in self.pivots]
        length = (self.side ** 2).sum(axis=1)
        inner = np.stack([(near[0] + length[j] - d) / 2 for j, d in enumerate(near[1:])], axis=1) \
            if len(near) > 1 else np.empty((len(rows), 0))
        inside = np.linalg.solve(self.side, inner.T).T if inner.size else inner
        up = np.sqrt(np.maximum(near[0] - (inside ** 2).sum(axis=1), 0))
        return np.concatenate([inside, up[:, None]], axis=1)

    def possible(self, apexes: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """Which centroids (columns) may be nearest to which vectors (rows), given all apexes."""
        inside = ((apexes[:, None, :-1] - centroids[None, :, :-1]) ** 2).sum(axis=2)
        up, top = apexes[:, -1:], centroids[None, :, -1]
        low, high = inside + (up - top) ** 2, inside + (up + top) ** 2
        reach = np.maximum((apexes ** 2).sum(axis=1), max(self.far, (centroids ** 2).sum(axis=1).max()))
        return low <= (high.min(axis=1) + MARGIN * reach)[:, None]


def assign(simplex: Simplex, centroids: list[np.ndarray], vectors: np.ndarray, apexes: np.ndarray,
           measure: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid, its squared distance (if ``measure`` or compared) and centroids compared."""
    n = len(vectors)
    may = np.ones((n, len(centroids)), bool)
    flat = [j for j, c in enumerate(centroids) if is_narrow(c)]
    if is_narrow(vectors) and simplex.pivots and flat:
        may[:, flat] = simplex.possible(apexes, simplex.place(np.stack([centroids[j] for j in flat])))
    compared = may.sum(axis=1)
    one = (compared == 1) & (not measure)
    nearest = np.where(one, may.argmax(axis=1), -1)
    best = np.zeros(n, object)
    for j, c in enumerate(centroids):
        at = np.flatnonzero(may[:, j] & ~one)
        if len(at):
            d = squared(vectors[at], c)
            closer = (nearest[at] < 0) | (d < best[at]).astype(bool)
            nearest[at[closer]], best[at[closer]] = j, d[closer].astype(object)
    return nearest, best, compared


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, pd.DataFrame]]:
    """Vectors, apexes and rows: narrow rows together, then wide ones."""
    for b in batches:
        flat = b["code"].notna()
        if flat.any():
            f = b[flat]
            yield (np.frombuffer(b"".join(f["code"]), "<i4").reshape(len(f), -1).astype(np.int64),
                   np.frombuffer(b"".join(f["apex"]), "<f8").reshape(len(f), -1), f)
        if not flat.all():
            f = b[~flat]
            yield np.stack([unpacked(None, w) for w in f["wide"]]), np.empty((len(f), 0)), f


def _place(stored: DataFrame, simplex: Simplex) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            apex = [None] * len(b)
            flat = np.flatnonzero(b["code"].notna())
            if len(flat) and simplex.pivots:
                rows = np.frombuffer(b"".join(b["code"].iloc[flat]), "<i4").reshape(len(flat), -1).astype(np.int64)
                for k, a in zip(flat, simplex.place(rows), strict=True):
                    apex[k] = a.astype("<f8").tobytes()
            yield b.assign(apex=[b"" if a is None else a for a in apex])

    kind = stored.schema["vec_id"].dataType.simpleString()
    return stored.mapInPandas(run, f"vec_id {kind}, code binary, wide string, apex binary")


def _sums(placed: DataFrame, simplex: Simplex, centroids: list[np.ndarray]) -> tuple[list[int], list[np.ndarray]]:
    """Members and exact component sums of every centroid's vectors."""
    k, size = len(centroids), len(centroids[0])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, total = [0] * k, [np.zeros(size, object) for _ in range(k)]
        for vectors, apexes, _ in _batches(batches):
            nearest = assign(simplex, centroids, vectors, apexes, measure=False)[0]
            for j in np.unique(nearest):
                own = vectors[nearest == j]
                count[j] += len(own)
                total[j] = total[j] + own.sum(axis=0).astype(object)
        yield pd.DataFrame({"state": [pickle.dumps((count, total))]})

    def add(a: tuple, b: tuple) -> tuple:
        return [x + y for x, y in zip(a[0], b[0], strict=True)], [x + y for x, y in zip(a[1], b[1], strict=True)]

    states = placed.mapInPandas(run, "state binary").rdd.map(lambda r: pickle.loads(bytes(r["state"])))
    return states.treeAggregate(([0] * k, [np.zeros(size, object) for _ in range(k)]), add, add)


def cluster(rows: DataFrame, k: int = 8, rounds: int = 10, salt: str = "3:", size: int = 64, scale: int = 1024,
            pivots: int = 16) -> DataFrame:
    """Per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, n_compared."""
    spark = rows.sparkSession
    stored = cut(packed(rows, size, scale))
    order = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    first = stored.orderBy(order.asc_nulls_last(), "code", "wide").limit(max(k, 4 * pivots)).collect()
    starts = [unpacked(r["code"] if r["code"] is None else bytes(r["code"]), r["wide"]) for r in first]
    kind = stored.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, cluster int, distance long, n_compared int"
    if not starts:
        return spark.createDataFrame([], f"{schema.replace(', n_compared int', '')}, cluster_inertia long, inertia long, "
                                         "centroid_sha256 string, n_compared int")
    simplex, centroids = Simplex(starts, pivots), starts[:k]
    placed = cut(_place(stored, simplex))
    for _ in range(rounds):
        count, total = _sums(placed, simplex, centroids)
        centroids = [narrowed(np.array([int(s) // n for s in t], object)) if n else c
                     for c, n, t in zip(centroids, count, total, strict=True)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for vectors, apexes, b in _batches(batches):
            nearest, best, compared = assign(simplex, centroids, vectors, apexes, measure=True)
            yield pd.DataFrame({"vec_id": b["vec_id"].to_numpy(), "cluster": nearest.astype(np.int32),
                                "distance": pd.array([int(d) if d <= LONG else None for d in best], "Int64"),
                                "n_compared": compared.astype(np.int32)})

    answer = cut(placed.mapInPandas(run, schema))
    # at most k rows: what a cluster's distances sum up to, null where one is no long
    own = {r["cluster"]: r["total"] if r["n"] == r["known"] else None for r in answer.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), F.count("*").alias("n"),
        F.count("distance").alias("known")).collect()}
    every = None if None in own.values() else sum(map(int, own.values()))
    as_long = lambda x: int(x) if x is not None and int(x) <= LONG else None
    facts = spark.createDataFrame(
        [(j, as_long(own[j]), as_long(every), hashlib.sha256(",".join(str(int(c)) for c in centroids[j]).encode()).hexdigest())
         for j in sorted(own)], "_cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return (answer.join(F.broadcast(facts), F.col("cluster") == F.col("_cluster"))
            .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_compared"))


def oracle(k: int = 8, rounds: int = 10, salt: str = "3:", size: int = 64, scale: int = 1024) -> str:
    """DuckDB SQL for the registered query: every distance, round after round."""
    def assigned(n: int) -> str:
        return f"""
a{n} AS MATERIALIZED (SELECT r, vec_id, v, j, d FROM (
  SELECT x.r, vec_id, v, j, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x, c{n})
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, j) = 1)"""

    def moved(n: int) -> str:
        return f"""
s{n} AS MATERIALIZED (SELECT j, i, sum(v[i]) AS s, count(*) AS n FROM a{n}, range(1, {size + 1}) AS z(i) GROUP BY j, i),
m{n} AS MATERIALIZED (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{n} GROUP BY j),
c{n + 1} AS MATERIALIZED (SELECT o.j, coalesce(m.c, o.c) AS c FROM c{n} o LEFT JOIN m{n} m ON o.j = m.j)"""

    steps = ",".join(f"{assigned(n)},{moved(n)}" for n in range(rounds))
    return f"""
WITH x AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda e: isfinite(e))) = {size}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{salt}' || vec_id), v) - 1 AS j, v AS c FROM x
  QUALIFY j < {k}),{steps},{assigned(rounds)}
SELECT vec_id, CAST(a.j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.j = c.j
"""
