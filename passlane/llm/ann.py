"""Approximate nearest neighbours by inner product: NN-descent and greedy graph search.

Index. Equal vectors are one node (with its smallest ids), so copies cost nothing. A first
graph comes from exact search inside the cells of a few random projection trees (the upper
levels from a sample, the lower ones inside the task that has the cell); then rounds join every
node's neighbours (and a bounded number of nodes that name it) with their vectors, compare them
with each other and offer each what it lacks, neighbours of neighbours, until a round changes
hardly any edge. Edges are new in the round after they were found and old from then on; two old
ones were compared before, so only pairs with a new one are compared, and nodes without a new
edge send nothing: a round costs what the one before it changed. Vectors travel as bytes there,
whose products are exact sums, so that lists only ever get better; scores of the search are in
double precision.

Search. A query starts at its own node and keeps a beam of the best nodes found. Each hop
expands what the beam has not expanded yet, scores the neighbours where their vectors are
(nodes lie in blocks of bounded size; a request carries the query's vector and the score to
reach), until nothing is left to expand for any query. Queries run together.

Every row is in the index. The degree, the beam and the reverse neighbours are bounds of the
approximate method; the numbers of levels, rounds and hops follow from the data. Recall against
brute force is measured in the tests.

Defined results: vectors that are null, zero, of another length than most, or that hold null,
NaN or infinite numbers take no part; rows repeated with one vec_id count once (of different
vectors under one id the first in byte order); a query with fewer candidates gets them all;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passlane.llm.common import cut, ship

SEED = 11


def best_of(node: np.ndarray, other: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best distinct others of each node, by node, best first."""
    order = np.lexsort((other, node))
    node, other, score = node[order], other[order], score[order]
    new = np.ones(len(node), bool)
    new[1:] = (node[1:] != node[:-1]) | (other[1:] != other[:-1])
    new &= node != other
    node, other, score = node[new], other[new], score[new]
    order = np.lexsort((other, -score, node))
    node, other, score = node[order], other[order], score[order]
    first = np.flatnonzero(np.diff(node, prepend=node[0] - 1)) if len(node) else np.empty(0, np.int64)
    rank = np.arange(len(node)) - np.repeat(first, np.diff(np.append(first, len(node))))
    keep = rank < k
    return node[keep], other[keep], score[keep]


def _arrays(values: list[np.ndarray]) -> pd.Series:
    """A column of arrays, of that kind when empty too."""
    out = np.empty(len(values), object)
    out[:] = values
    return pd.Series(out)


def _lists(node: np.ndarray, other: np.ndarray, score: np.ndarray) -> pd.DataFrame:
    """Sorted triples to one row per node."""
    first = np.flatnonzero(np.diff(node, prepend=node[0] - 1)) if len(node) else np.empty(0, np.int64)
    cuts = np.append(first, len(node))
    return pd.DataFrame({
        "node": node[first],
        "ids": _arrays([other[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]),
        "scores": _arrays([score[a:b].astype(np.float32) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])})


LISTS = "node long, ids array<long>, scores array<float>"


def _triples(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = list(frame["ids"])
    return (np.repeat(frame["node"].to_numpy(np.int64), [len(x) for x in ids]), np.concatenate([*ids, np.empty(0, np.int64)]),
            np.concatenate([*frame["scores"], np.empty(0, np.float32)]))


def _codes_of(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Codes as numbers whose inner products are exact, and their scales."""
    x = _matrix(g["code"], "i1")
    return x.astype(np.float32 if x.shape[1] << 14 < 1 << 24 else np.float64), g["scale"].to_numpy(np.float32)


def _products(x: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Inner products of all pairs; -inf of a vector with itself."""
    s = ((x @ x.T) * np.outer(scale, scale)).astype(np.float32)
    np.fill_diagonal(s, -np.inf)
    return s


def _matrix(column: pd.Series, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype).reshape(len(column), -1) if len(column) else np.empty((0, 1), dtype)


def _block(node: Column, blocks: int) -> Column:
    """Nodes are numbered in no order of theirs, so that blocks are of one size."""
    return F.pmod(node, F.lit(blocks)).cast("int")


# -- nodes

def vectors(rows: DataFrame) -> DataFrame:
    """Usable rows: vec_id, vec (packed doubles), one for each vec_id."""
    ship(rows.sparkSession)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            packed = []
            for x in b["embedding"]:
                try:
                    v = np.asarray(x, np.float64)
                except (TypeError, ValueError):
                    v = np.empty(0)
                packed.append((v + 0.0).tobytes() if v.ndim == 1 and v.size and np.isfinite(v).all() and v.any() else None)
            yield pd.DataFrame({"vec_id": b["vec_id"], "vec": packed})

    whole = rows.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    found = (whole.mapInPandas(pack, "vec_id long, vec binary").where(F.col("vec").isNotNull())
             .groupBy("vec_id").agg(F.min("vec").alias("vec")))
    found = cut(found)
    usual = found.groupBy(F.octet_length("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return found.where(F.octet_length("vec") == (usual["n"] if usual else 0))


def _codes(vec: pd.Series) -> tuple[list[bytes], np.ndarray]:
    x = _matrix(vec, "<f8")
    scale = np.abs(x).max(axis=1) / 127
    return [c.tobytes() for c in np.rint(x / scale[:, None]).astype(np.int8)], scale


def nodes_of(found: DataFrame, answers: int, block_size: int, least_blocks: int) -> tuple[DataFrame, int, int]:
    """Distinct vectors as nodes: node, block, vec, code, scale, members (smallest ids); their number, the blocks.

    ``least_blocks`` keeps small tables in as many tasks as a node has edges: with fewer blocks
    every block would offer something to every node."""
    by_vector = Window.partitionBy("vec").orderBy("vec_id")
    least = found.withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= answers + 1)

    @F.pandas_udf("code binary, scale double")
    def code(vec: pd.Series) -> pd.DataFrame:
        codes, scale = _codes(vec)
        return pd.DataFrame({"code": codes, "scale": scale})

    distinct = cut(least.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("members")))
    n = distinct.count()
    blocks = max(least_blocks, -(-n // block_size))
    nodes = (distinct.withColumn("node", F.monotonically_increasing_id()).withColumn("c", code("vec"))
             .select("node", _block(F.col("node"), blocks).alias("block"), "vec", "c.code", "c.scale", "members"))
    return cut(nodes), n, blocks


# -- graph

def _trees(nodes: DataFrame, n: int, trees: int, cell: int, sample: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Random directions by level, and the medians of a bounded sample at every inner node; cells
    that are still too large are split further by the task that has them."""
    taken = nodes.select("node", "vec").orderBy(F.xxhash64("node")).limit(sample).select("vec").toPandas()
    x = _matrix(taken["vec"], "<f8")
    r = np.random.Generator(np.random.PCG64(SEED))
    levels = int(min(np.ceil(np.log2(max(1, n / cell))), np.log2(max(1, len(x) / 8))))
    out = []
    for _ in range(trees):
        directions = r.normal(size=(levels, x.shape[1]))
        medians, at = np.zeros(1 << levels), np.ones(len(x), np.int64)
        for level in range(levels):
            p = x @ directions[level]
            for k in range(1 << level, 2 << level):
                inside = p[at == k]
                medians[k] = np.median(inside) if len(inside) else 0.0
            at = 2 * at + (p > medians[at])
        out.append((directions, medians))
    return out


def _leaves(x: np.ndarray, most: int, r: np.random.Generator) -> Iterator[np.ndarray]:
    """Rows of ``x`` in cells of at most ``most``, halved at medians along random directions."""
    todo = [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            yield rows
        else:
            rows = rows[np.argsort(x[rows] @ r.normal(size=x.shape[1]).astype(x.dtype), kind="stable")]
            todo += [rows[:len(rows) // 2], rows[len(rows) // 2:]]


def first_graph(nodes: DataFrame, n: int, blocks: int, degree: int, trees: int, cell: int, sample: int) -> DataFrame:
    spark = nodes.sparkSession
    shared = spark.sparkContext.broadcast(_trees(nodes, n, trees, cell, sample))

    @F.pandas_udf("array<int>")
    def cells(vec: pd.Series) -> pd.Series:
        x, found = _matrix(vec, "<f8"), []
        for directions, medians in shared.value:
            at = np.ones(len(x), np.int64)
            for d in directions:
                at = 2 * at + (x @ d > medians[at])
            found.append(at)
        return pd.Series(list(np.stack(found, 1).astype(np.int32)))

    placed = nodes.select("node", "code", "scale", F.posexplode(cells("vec")).alias("tree", "cell"))

    def inside(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("node", kind="stable")
        x, scale = _codes_of(g)
        node, found = g["node"].to_numpy(np.int64), []
        for rows in _leaves(x * scale[:, None], 2 * cell, np.random.Generator(np.random.PCG64([SEED, *g[["tree", "cell"]].iloc[0]]))):
            if len(rows) < 2:
                continue
            s = _products(x[rows], scale[rows])
            m = min(degree, len(rows) - 1)
            top = np.argpartition(-s, m - 1, axis=1)[:, :m]
            found.append(best_of(np.repeat(node[rows], m), node[rows][top].ravel(), np.take_along_axis(s, top, 1).ravel(), m))
        return _joined(found)

    return _merged(None, placed.groupBy("tree", "cell").applyInPandas(inside, LISTS), blocks, degree)


def _joined(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    if not found:
        return _lists(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))
    return _lists(*(np.concatenate(c) for c in zip(*found, strict=True)))


GRAPH = f"{LISTS}, new array<boolean>, fresh long"


def _merged(graph: DataFrame | None, offers: DataFrame, blocks: int, degree: int) -> DataFrame:
    """Lists of one node to its best ``degree`` neighbours, which of them ``graph`` lacks, and how many;
    blocks are merged as arrays."""
    def merge(g: pd.DataFrame) -> pd.DataFrame:
        node, other, score = best_of(*_triples(g), degree)
        out = _lists(node, other, score)
        before = dict(zip(g["node"][g["held"]], g["ids"][g["held"]], strict=True))
        none = np.empty(0, np.int64)
        new = [~np.isin(x, before.get(n, none)) for n, x in zip(out["node"], out["ids"], strict=True)]
        return out.assign(new=_arrays(new), fresh=[int(x.sum()) for x in new])

    rows = offers.withColumn("held", F.lit(False))
    if graph is not None:
        rows = graph.select("node", "ids", "scores", F.lit(True).alias("held")).unionByName(rows)
    return cut(rows.withColumn("block", _block(F.col("node"), blocks)).groupBy("block").applyInPandas(merge, GRAPH))


def _around(graph: DataFrame, degree: int) -> DataFrame:
    """(at, near, old): each node's neighbours, and at most ``degree`` nodes that name it, the nearest;
    those of them that were there before."""
    named = graph.select(F.col("node").alias("at"), F.inline(F.arrays_zip("ids", "scores", "new"))).toDF(
        "at", "node", "score", "new")
    nearest = Window.partitionBy("node").orderBy(F.desc("score"), "at")
    back = named.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= degree)
    both = named.select("at", "node", "new").unionByName(
        back.select(F.col("node").alias("at"), F.col("at").alias("node"), "new"))
    # at most 2 * degree of a node
    return both.groupBy("at").agg(F.collect_set("node").alias("near"),
                                  F.collect_set(F.when(~F.col("new"), F.col("node"))).alias("old"))


def descend(graph: DataFrame, nodes: DataFrame, blocks: int, degree: int, held: int = 1 << 20) -> DataFrame:
    """One round: neighbours of a node are compared with each other, where one of the two is new;
    each is offered all that is better than its last. A task reduces its offers when it holds ``held``."""
    none = F.lit(float("-inf")).cast("float")
    least = graph.select(F.col("node").alias("l_node"), F.when(
        F.size("scores") >= degree, F.element_at("scores", -1)).otherwise(none).alias("least"))
    facts = nodes.select("node", "code", "scale").join(least, F.col("node") == F.col("l_node"), "left").select(
        "node", "code", "scale", F.coalesce("least", none).alias("least"))
    todo = (_around(graph, degree).where(F.size("near") > F.size("old")).select("at", "old", F.explode("near").alias("node"))
            .select("at", "node", (~F.array_contains("old", F.col("node"))).alias("new")))
    around = todo.join(facts, "node").withColumn("block", _block(F.col("at"), blocks))

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("at", kind="stable")
        at, node = g["at"].to_numpy(np.int64), g["node"].to_numpy(np.int64)
        x, scale = _codes_of(g)
        least, new = g["least"].to_numpy(np.float32), g["new"].to_numpy(bool)
        cuts = np.append(np.flatnonzero(np.diff(at, prepend=at[0] - 1)), len(at))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            s = _products(x[a:b], scale[a:b])
            row, col = np.nonzero((s > least[a:b, None]) & (new[a:b, None] | new[a:b]))
            found.append((node[a:b][row], node[a:b][col], s[row, col]))
            size += len(row)
            if size > held:
                found = [best_of(*(np.concatenate(c) for c in zip(*found, strict=True)), degree)]
                size = 0
        return _joined([best_of(*(np.concatenate(c) for c in zip(*found, strict=True)), degree)])

    return _merged(graph, around.groupBy("block").applyInPandas(compare, LISTS), blocks, degree)


# -- search

STATE = "query long, vec binary, ids binary, scores binary, shut array<long>"


def _by_block(ids: np.ndarray, blocks: int) -> Iterator[tuple[int, bytes]]:
    """``ids`` packed by their block, as ``_block`` has it."""
    block = ids % blocks
    order = np.argsort(block, kind="stable")
    ids, block = ids[order], block[order]
    cuts = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(ids))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(block[a]), ids[a:b].astype("<i8").tobytes()


def search(queries: DataFrame, graph: DataFrame, nodes: DataFrame, blocks: int, degree: int, beam: int,
           batch: int) -> DataFrame:
    """``queries`` (query: a node) to (query, ids, scores): the best ``beam`` nodes found, best first.

    Queries run together, or in waves of at least ``batch`` and a 64th of the nodes: what one
    block is asked is bounded so, and the number of waves does not grow with the table."""
    around = _around(graph.select("node", "ids", "scores", F.transform("ids", lambda _: F.lit(False)).alias("new")), degree)
    near = cut(around.select(F.col("at").alias("node"), "near"))
    place = nodes.select("block", "node", "vec")
    waves = max(1, -(-queries.count() // max(batch, nodes.count() // 64)))
    asking = queries.join(nodes.select("node", "vec"), F.col("query") == F.col("node")).select("query", "vec")
    out = None
    for k in range(waves):
        done = _wave(asking.where(F.pmod(F.xxhash64("query"), F.lit(waves)) == k), near, place, blocks, beam)
        out = done if out is None else out.unionByName(done)
    return out


def _wave(asking: DataFrame, near: DataFrame, place: DataFrame, blocks: int, beam: int) -> DataFrame:
    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A query's beam is its own node."""
        for b in batches:
            x = _matrix(b["vec"], "<f8")
            yield b.assign(ids=[int(q).to_bytes(8, "little") for q in b["query"]],
                           scores=[s.astype("<f8").tobytes() for s in np.einsum("ij,ij->i", x, x)],
                           shut=_arrays([np.array([q]) for q in b["query"]]))

    def want(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Neighbours that are not in the beam, by block, with the score that they have to reach."""
        for b in batches:
            rows = []
            for q, vec, ids, scores, found in zip(b["query"], b["vec"], b["ids"], b["scores"], b["found"], strict=True):
                fresh = np.setdiff1d(np.concatenate(list(found)), np.frombuffer(ids, "<i8"))
                least = float(np.frombuffer(scores, "<f8")[-1]) if len(scores) >= 8 * beam else -np.inf
                rows += [(block, q, vec, least, part) for block, part in _by_block(fresh, blocks)]
            yield pd.DataFrame(rows, columns=["block", "query", "vec", "least", "ids"])

    def score(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        """Best nodes of this block for each query that asks for some."""
        rows = []
        if len(asked) and len(block):
            order = block["node"].to_numpy(np.int64).argsort()
            names, x = block["node"].to_numpy(np.int64)[order], _matrix(block["vec"], "<f8")[order]
            vecs, least = _matrix(asked["vec"], "<f8"), asked["least"].to_numpy(np.float64)
            row = np.repeat(np.arange(len(asked)), [len(i) // 8 for i in asked["ids"]])
            node = np.frombuffer(b"".join(asked["ids"]), "<i8")
            col, got = np.searchsorted(names, node), np.empty(len(node))
            for k in range(0, len(node), 65_536):
                got[k:k + 65_536] = np.einsum("ij,ij->i", vecs[row[k:k + 65_536]], x[col[k:k + 65_536]])
            good = got >= least[row]
            row, node, got = row[good], node[good], got[good]
            by = np.lexsort((node, -got, row))
            row, node, got = row[by], node[by], got[by]
            cuts, query = np.append(np.flatnonzero(np.diff(row, prepend=-1)), len(row)), asked["query"].to_numpy(np.int64)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                rows.append((query[row[a]], node[a:min(b, a + beam)].astype("<i8").tobytes(),
                             got[a:min(b, a + beam)].astype("<f8").tobytes()))
        return pd.DataFrame(rows, columns=["query", "ids", "scores"])

    def keep_best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A query's old beam, opened now, and its new nodes to its new beam."""
        for b in batches:
            rows = []
            for q, vec, ids, scores, parts in zip(b["query"], b["vec"], b["ids"], b["scores"], b["parts"], strict=True):
                parts, old = [] if parts is None else list(parts), len(ids) // 8
                ids = np.concatenate([np.frombuffer(i, "<i8") for i in [ids, *[p["ids"] for p in parts]]])
                scores = np.concatenate([np.frombuffer(s, "<f8") for s in [scores, *[p["scores"] for p in parts]]])
                order = np.lexsort((ids, -scores))[:beam]
                rows.append((q, vec, ids[order].astype("<i8").tobytes(), scores[order].astype("<f8").tobytes(),
                             ids[order[order >= old]]))
            yield pd.DataFrame(rows, columns=["query", "vec", "ids", "scores", "shut"])

    state = cut(asking.mapInPandas(begin, STATE))
    while not state.where(F.size("shut") > 0).isEmpty():  # a beam only gets better, so this ends
        asked = state.select("query", F.explode("shut").alias("node"))
        # at most one list for each node of a beam, one row for each block
        found = asked.join(near, "node").groupBy("query").agg(F.collect_list("near").alias("found"))
        wanted = state.select("query", "vec", "ids", "scores").join(found, "query").mapInPandas(
            want, "block int, query long, vec binary, least double, ids binary")
        scored = wanted.groupBy("block").cogroup(place.groupBy("block")).applyInPandas(
            score, "query long, ids binary, scores binary")
        parts = scored.groupBy("query").agg(F.collect_list(F.struct("ids", "scores")).alias("parts"))
        state = cut(state.select("query", "vec", "ids", "scores").join(parts, "query", "left").mapInPandas(keep_best, STATE))
    return state.select("query", "ids", "scores")


def nearest(rows: DataFrame, is_query: Column, answers: int = 20, degree: int = 32, trees: int = 8, cell: int = 400,
            settled: float = 0.001, beam: int = 256, block_size: int = 4096, least_blocks: int = 64, sample: int = 20_000,
            batch: int = 20_000) -> DataFrame:
    """For each row of (vec_id, embedding) that ``is_query`` picks, its ``answers`` nearest others:
    query_id, rank, vec_id, score. The graph is done when a round changes at most the share
    ``settled`` of its edges."""
    found = vectors(rows)
    nodes, n, blocks = nodes_of(found, answers, block_size, least_blocks)
    graph = first_graph(nodes, n, blocks, degree, trees, cell, sample)
    fresh = n
    while fresh:
        graph = descend(graph, nodes, blocks, degree)
        fresh = graph.where(F.col("fresh") > 0).agg(F.sum("fresh")).first()[0] or 0
        if fresh <= settled * n * degree:
            break
    asking = cut(found.where(is_query).join(nodes.select("node", F.col("vec").alias("n_vec")), F.col("vec") == F.col("n_vec"))
                 .select(F.col("vec_id").alias("query_id"), F.col("node").alias("query")))
    best = search(asking.select("query").distinct(), graph, nodes, blocks, degree, beam, batch)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = [np.frombuffer(x, "<i8")[:answers + 1] for x in b["ids"]]
            yield pd.DataFrame({
                "query": np.repeat(b["query"].to_numpy(np.int64), [len(x) for x in ids]), "node": np.concatenate(ids),
                "score": np.concatenate([np.frombuffer(x, "<f8")[:answers + 1] for x in b["scores"]])})

    # The best answers + 1 nodes hold the answers, as each node has a member.
    hits = best.mapInPandas(unpack, "query long, node long, score double")
    members = nodes.select("node", F.explode("members").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    named = hits.join(members, "node").withColumn("n", F.row_number().over(order)).where(F.col("n") <= answers + 1)
    mine = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (asking.join(named.select("query", "vec_id", "score"), "query").where(F.col("vec_id") != F.col("query_id"))
            .withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= answers)
            .select("query_id", "rank", "vec_id", "score"))
