"""Prefix trie of conversations, with subtree totals by the Euler-tour technique.

Conversations are rebuilt (a shared head of another conversation, then the own rest); every
distinct sequence of first turns is a node of the trie. Subtree sums come without recursion:

1. Turns are named by SHA-256 of role and text; a prefix by the sum over its turns of four
   32-bit hashes of (position, name). Sums add up over slices, so a conversation with a third
   of all rows is numbered and summed in the slices of a range partitioning. Every node checks
   that all its prefixes have one parent and one last turn; if two ever shared a name, the job
   fails rather than merge them.
2. Each node has an enter and an exit arc, linked to the arc before it in the tour (its
   parent's enter, the exit of the child before, its own last child's exit or own enter).
3. List ranking: in each round every arc flips a coin (a hash of arc and round); arcs with
   heads whose predecessor has tails leave the list, and arcs after them are linked past them.
   A quarter goes in each round, with one join on the predecessor (each arc has one at most, so
   no key is hot). At most ``most`` arcs that remain are walked in one task; then the rounds
   are undone, every arc taking its place from the arc it left behind.
4. Leaves and savings of the enter arcs are summed along the tour (blocks, then inside blocks);
   what a subtree holds is the sum at its exit less the sum before its enter.

Children of one parent are put in order by a range partitioning, never by a window over the
parent. The ids that end at a node are joined to text in bounded chunks; a hash runs over a
node's chunks as a stream, so only its state is held.

Defined results: turns are ordered by turn (null first), equal ones by their SHA-256; null role
or text counts as empty; rows without a conv_id belong to no conversation and are ignored;
repeated rows are turns each; an empty table gives no nodes; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passlane.llm.common import cut, ship

#: Prefix sums (of this node, and of its parent).
P, Q = ["p0", "p1", "p2", "p3"], ["q0", "q1", "q2", "q3"]
#: Arcs ranked in one task, conversation ids in a chunk, blocks of the tour.
MOST, CHUNK, BLOCKS = 8192, 4096, 2000


def head_turns(conv_id: Column, most: int = 6) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % most


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, content, n_chars, in slices (``slice``) of a range partitioning by place."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    named = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("content"),
        F.length(text).alias("n_chars"))
    return cut(named.repartitionByRange("conv_id", "turn", "content").withColumn("slice", F.spark_partition_id()))


def _before(df: DataFrame, value: str) -> Column:
    """Sum of ``value`` over the earlier slices of a conversation."""
    w = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def rebuilt(conversations: DataFrame, group: int = 100, most_head: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): conv_id, slice, pos, content, n_chars; and conv_id, own, head, length.

    Conversation c gets the first h turns of c - c % group, then its own after its first h.
    """
    turns = _turns(conversations)
    sliced = turns.groupBy("conv_id", "slice").count()
    offsets = sliced.select("conv_id", "slice", _before(sliced, "count").alias("before"))
    place = Window.partitionBy("conv_id", "slice").orderBy(F.col("turn").asc_nulls_first(), "content")
    ranked = cut(turns.withColumn("n", F.row_number().over(place)).join(offsets, ["conv_id", "slice"])
                 .select("conv_id", "slice", (F.col("n") + F.col("before")).alias("n"), "content", "n_chars"))
    # of each conversation that others start with, its first turns: less than most_head of them
    heads = (ranked.where((F.col("conv_id") % group == 0) & (F.col("n") < most_head))
             .groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("n", "content", "n_chars"))).alias("first")))
    convs = (sliced.groupBy("conv_id").agg(F.sum("count").alias("own"))
             .withColumn("h", head_turns(F.col("conv_id"), most_head)).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
             .join(heads, "base", "left").withColumn("first", F.slice(F.coalesce("first", F.array()), 1, F.col("h")))
             .withColumn("head", F.size("first"))
             .withColumn("length", F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))))
    convs = cut(convs.select("conv_id", "h", "head", "length", "first"))
    begun = convs.select("conv_id", F.lit(-1).alias("slice"), F.explode("first").alias("x")).select(
        "conv_id", "slice", F.col("x.n").alias("pos"), "x.content", "x.n_chars")
    rest = (ranked.join(convs.select("conv_id", "h", "head"), "conv_id").where(F.col("n") > F.col("h"))
            .select("conv_id", "slice", (F.col("head") + F.col("n") - F.col("h")).alias("pos"), "content", "n_chars"))
    return begun.unionByName(rest), convs.select("conv_id", "length")


def prefixes(turns: DataFrame) -> DataFrame:
    """Every prefix of every conversation: conv_id, depth, n_chars, content, its sums and its parent's."""
    own = [f"o{k}" for k in range(4)]
    hashed = turns.select("*", *[F.shiftrightunsigned(F.xxhash64(F.lit(k), "pos", "content"), 32).alias(own[k]) for k in range(4)])
    sums = hashed.groupBy("conv_id", "slice").agg(*[F.sum(o).alias(o) for o in own])
    before = sums.select("conv_id", "slice", *[_before(sums, o).alias(f"b_{o}") for o in own])
    upto = Window.partitionBy("conv_id", "slice").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    summed = hashed.select("conv_id", "slice", "pos", "content", "n_chars", *own, *[F.sum(o).over(upto).alias(f"s_{o}") for o in own])
    return cut(summed.join(before, ["conv_id", "slice"]).select(
        "conv_id", F.col("pos").cast("long").alias("depth"), "content", "n_chars",
        *[(F.col(f"s_{o}") + F.col(f"b_{o}")).alias(p) for o, p in zip(own, P, strict=True)],
        *[(F.col(f"s_{o}") + F.col(f"b_{o}") - F.col(o)).alias(q) for o, q in zip(own, Q, strict=True)]))


def nodes_of(found: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node: nid, depth, conv_id, n_convs, saved (of its own), its sums and its parent's."""
    same = F.xxhash64(*Q, "content", "n_chars")
    grown = found.groupBy("depth", *P).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("n_chars").cast("long").alias("n_chars"),
        *[F.min(q).alias(q) for q in Q], F.min(same).alias("_low"), F.max(same).alias("_high"))
    grown = grown.withColumn("n_convs", F.when(F.col("_low") == F.col("_high"), F.col("n_convs")).otherwise(
        F.raise_error(F.lit("two prefixes share a name")).cast("long")))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0").select(
        zero.alias("depth"), *[zero.alias(c) for c in P], "n_convs", "conv_id", zero.alias("n_chars"), *[zero.alias(c) for c in Q])
    return cut(grown.select(root.columns).unionByName(root).select(
        F.monotonically_increasing_id().alias("nid"), "depth", "conv_id", "n_convs",
        ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved"), *P, *Q))


def linked(nodes: DataFrame) -> DataFrame:
    """Every node with its parent, the sibling before it, its last child and number of children (null: none)."""
    up = nodes.select(F.col("nid").alias("parent"), F.col("conv_id").alias("parent_conv_id"),
                      (F.col("depth") + 1).alias("depth"), *[F.col(p).alias(q) for p, q in zip(P, Q, strict=True)])
    kids = nodes.where("depth > 0").select("nid", "conv_id", "depth", *Q).join(up, ["depth", *Q]).select(
        "nid", "conv_id", "parent", "parent_conv_id")
    kids = cut(kids.repartitionByRange("parent", "conv_id").withColumn("slice", F.spark_partition_id()))
    w = Window.partitionBy("slice").orderBy("parent", "conv_id")
    # the last child of a slice precedes the first of the next one: one row for each slice
    ends = kids.groupBy("slice").agg(F.max(F.struct("parent", "conv_id", "nid")).alias("end"))
    ends = ends.select(F.col("slice").alias("_slice"), F.lag("end").over(Window.orderBy("slice")).alias("_end"))
    ordered = kids.select("*", F.lag(F.struct("parent", "conv_id", "nid")).over(w).alias("_last"))
    ordered = ordered.join(F.broadcast(ends), F.col("slice") == F.col("_slice")).withColumn("_last", F.coalesce("_last", "_end"))
    before = ordered.select("nid", "parent", "parent_conv_id",
                            F.when(F.col("_last.parent") == F.col("parent"), F.col("_last.nid")).alias("sibling"))
    family = kids.groupBy(F.col("parent").alias("nid")).agg(F.count("*").alias("n_children"), F.max_by("nid", "conv_id").alias("last_child"))
    return cut(nodes.select("nid", "depth", "conv_id", "n_convs", "saved", *P).join(before, "nid", "left").join(family, "nid", "left"))


def tour(nodes: DataFrame) -> DataFrame:
    """Enter (2 * nid) and exit (2 * nid + 1) arcs: id, pred (the arc before; null for the first), steps from it."""
    enter = F.when(F.col("sibling").isNotNull(), 2 * F.col("sibling") + 1).otherwise(2 * F.col("parent"))
    leave = F.when(F.col("last_child").isNotNull(), 2 * F.col("last_child") + 1).otherwise(2 * F.col("nid"))
    arcs = F.array(F.struct((2 * F.col("nid")).alias("id"), enter.alias("pred")),
                   F.struct((2 * F.col("nid") + 1).alias("id"), leave.alias("pred")))
    return nodes.select(F.explode(arcs).alias("a")).select("a.id", "a.pred", F.lit(1).cast("long").alias("steps"))


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Places of a short list, from its first element on."""
    after, steps, at = {}, {}, None
    for b in batches:
        for i, p, s in zip(b["id"].tolist(), b["pred"].tolist(), b["steps"].tolist(), strict=True):
            after[None if p != p or p is None else int(p)] = i
            steps[i] = s
    ids, places, place = [], [], 0
    while at in after:
        at, first = after[at], at is None
        place += 0 if first else steps[at]
        ids.append(at)
        places.append(place)
    yield pd.DataFrame({"id": ids, "place": places}, dtype="int64")


def list_ranks(arcs: DataFrame, most: int = MOST) -> DataFrame:
    """id, place: how many steps each element of a linked list is from its first.

    An element and the one after it meet as two rows of one key in an aggregate: keys are
    unique on both sides, so that is a join without Spark's estimate of a join's size, which
    would multiply from round to round.
    """
    nothing = F.lit(None).cast("long")
    arcs, left = cut(arcs), []
    while arcs.count() > most:
        heads = lambda c, r=len(left): F.xxhash64(c, F.lit(r)) % 2 == 0
        leaves = F.col("pred").isNotNull() & heads(F.col("id")) & ~heads(F.col("pred"))
        gone = arcs.where(leaves)
        left.append(gone)
        met = arcs.where(~leaves).select(F.col("pred").alias("key"), "id", "steps", nothing.alias("past"), nothing.alias("more"))
        met = met.unionByName(gone.select(F.col("id").alias("key"), nothing.alias("id"), nothing.alias("steps"),
                                          F.col("pred").alias("past"), F.col("steps").alias("more")))
        arcs = cut(met.groupBy("key").agg(*[F.max(c).alias(c) for c in ("id", "steps", "past", "more")])
                   .where(F.col("id").isNotNull()).select("id", F.coalesce("past", "key").alias("pred"),
                                                          (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")))
    places = cut(arcs.repartition(1).mapInPandas(_walk, "id long, place long"))
    for gone in reversed(left):
        met = places.select(F.col("id").alias("key"), "place", nothing.alias("back"), nothing.alias("steps")).unionByName(
            gone.select(F.col("pred").alias("key"), nothing.alias("place"), F.col("id").alias("back"), "steps"))
        met = met.groupBy("key").agg(*[F.max(c).alias(c) for c in ("place", "back", "steps")])
        both = F.array(F.struct(F.col("key").alias("id"), "place"),
                       F.struct(F.col("back").alias("id"), (F.col("place") + F.col("steps")).alias("place")))
        places = cut(met.select(F.inline(both)).where(F.col("id").isNotNull()))
    return places


def subtree_sums(nodes: DataFrame, places: DataFrame) -> DataFrame:
    """s_nid, n_leaves, saved_tokens: differences of prefix sums at a node's two arcs."""
    weight = nodes.select(F.col("nid").alias("s_nid"), F.col("n_children").isNull().cast("long").alias("leaf"), "saved")
    arcs = places.select(F.shiftright("id", 1).alias("a_nid"), (F.col("id") % 2 == 0).alias("enters"), "place")
    arcs = arcs.join(weight, F.col("a_nid") == F.col("s_nid")).select(
        "s_nid", "enters", "place", *[F.when(F.col("enters"), F.col(c)).otherwise(0).alias(c) for c in ("leaf", "saved")])
    per_block = max(2048, -(-places.count() // BLOCKS))
    arcs = cut(arcs.withColumn("block", F.floor(F.col("place") / per_block)))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # over BLOCKS rows at most, or few
    blocks = arcs.groupBy(F.col("block").alias("_block")).agg(F.sum("leaf").alias("l"), F.sum("saved").alias("s"))
    blocks = blocks.select("_block", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"before_{c}") for c in "ls"])
    inside = Window.partitionBy("block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    summed = arcs.select("*", F.sum("leaf").over(inside).alias("l"), F.sum("saved").over(inside).alias("s")).join(
        F.broadcast(blocks), F.col("block") == F.col("_block"))
    upto = {c: F.col(c) + F.col(f"before_{c}") for c in "ls"}
    difference = lambda c, w: F.sum(F.when(F.col("enters"), F.col(w) - upto[c]).otherwise(upto[c]))
    return summed.groupBy("s_nid").agg(difference("l", "leaf").alias("n_leaves"), difference("s", "saved").alias("saved_tokens"))


def ends_hashes(found: DataFrame, convs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """depth, sums of a node, ends_sha256 of the ids that end there, for nodes where any do."""
    ship(found.sparkSession)
    key, zero = ["depth", *P], F.lit(0).cast("long")
    last = found.select("conv_id", *key).join(convs, "conv_id").where(F.col("depth") == F.col("length")).select(*key, "conv_id")
    none = convs.where("length = 0").select(*[zero.alias(c) for c in key], "conv_id")

    def rows(batches: Iterator[pd.DataFrame], value: str) -> Iterator[tuple[tuple, object]]:
        for b in batches:
            yield from zip(zip(*[b[k].tolist() for k in key], strict=True), b[value].tolist(), strict=True)

    def frames(found: Iterator[tuple], columns: list[str], most: int) -> Iterator[pd.DataFrame]:
        held = []
        for r in found:
            held.append(r)
            if len(held) >= most:
                yield pd.DataFrame(held, columns=columns)
                held = []
        if held:
            yield pd.DataFrame(held, columns=columns)

    def chunked(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        now, ids = None, []
        for k, c in rows(batches, "conv_id"):
            if ids and (k != now or len(ids) >= chunk):
                yield *now, ids[0], ",".join(map(str, ids))
                ids = []
            now = k
            ids.append(c)
        if ids:
            yield *now, ids[0], ",".join(map(str, ids))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        now, state = None, None
        for k, text in rows(batches, "ids"):
            if k != now:
                if state is not None:
                    yield *now, state.hexdigest()
                now, state = k, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.encode())
        if state is not None:
            yield *now, state.hexdigest()

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from frames(chunked(batches), [*key, "first", "ids"], 100)

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from frames(hashed(batches), [*key, "ends_sha256"], 5000)

    longs = ", ".join(f"{c} long" for c in key)
    chunks = (last.unionByName(none).repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")
              .mapInPandas(join, f"{longs}, first long, ids string"))
    return chunks.repartition(*key).sortWithinPartitions(*key, "first").mapInPandas(digest, f"{longs}, ends_sha256 string")


def trie(conversations: DataFrame, group: int = 100, most_head: int = 6, most: int = MOST) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, convs = rebuilt(conversations, group, most_head)
    found = prefixes(turns)
    nodes = linked(nodes_of(found, convs))
    sums = subtree_sums(nodes, list_ranks(tour(nodes), most))
    ends = ends_hashes(found, convs).select(F.col("depth").alias("e_depth"), *[F.col(p).alias(f"e_{p}") for p in P], "ends_sha256")
    at = F.col("depth") == F.col("e_depth")
    for p in P:
        at &= F.col(p) == F.col(f"e_{p}")
    nothing = hashlib.sha256(b"").hexdigest()
    return nodes.join(sums, F.col("nid") == F.col("s_nid")).join(ends, at, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


ORACLE = r"""
WITH RECURSIVE t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
    sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT c, CAST(c AS VARCHAR) AS s, 0 AS i, CAST(4294967295 AS BIGINT) AS x FROM (SELECT DISTINCT c FROM t)
  UNION ALL SELECT c, s, i + 1, CASE WHEN i % 9 = 0 THEN xor(x, CAST(ascii(s[i // 9 + 1]) AS BIGINT))
    WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM crc WHERE i < 9 * length(s)),
h AS (SELECT c, xor(x, 4294967295) % 6 AS h FROM crc WHERE i = 9 * length(s)),
b AS (SELECT h.c, t.role, t.text, 0 AS part, n FROM h JOIN t ON t.c = h.c - h.c % 100 AND n <= h
  UNION ALL SELECT h.c, t.role, t.text, 1, n FROM h JOIN t ON t.c = h.c AND n > h),
r AS (SELECT c, row_number() OVER w AS d, length(text) AS n_chars, list((role, text)) OVER (w ROWS UNBOUNDED PRECEDING) AS p
  FROM b WINDOW w AS (PARTITION BY c ORDER BY part, n)),
m AS (SELECT c, d, n_chars, min(c) OVER (PARTITION BY d, p) AS v FROM r
  UNION ALL SELECT c, 0, 0, min(c) OVER () FROM h),
l AS (SELECT c, max(d) AS d FROM m GROUP BY c),
node AS (SELECT d, v, count(*) AS n_convs, (count(*) - 1) * max(n_chars) AS own FROM m GROUP BY d, v),
child AS (SELECT node.*, up.v AS pv FROM node LEFT JOIN m up ON up.c = node.v AND up.d = node.d - 1),
kids AS (SELECT d - 1 AS d, pv AS v, count(*) AS n FROM child WHERE pv IS NOT NULL GROUP BY 1, 2),
sub AS (SELECT m.d, m.v, sum(own) AS saved, count(*) FILTER (kids.n IS NULL) AS leaves
  FROM node LEFT JOIN kids USING (d, v) JOIN m ON m.c = node.v AND m.d <= node.d GROUP BY m.d, m.v),
ends AS (SELECT m.d, m.v, string_agg(CAST(m.c AS VARCHAR), ',' ORDER BY m.c) AS ids FROM m JOIN l ON l.c = m.c AND l.d = m.d GROUP BY 1, 2)
SELECT child.v AS conv_id, CAST(child.d AS BIGINT) AS depth, pv AS parent_conv_id, n_convs, coalesce(kids.n, 0) AS n_children,
  leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM child LEFT JOIN kids USING (d, v) JOIN sub USING (d, v) LEFT JOIN ends USING (d, v)
"""
