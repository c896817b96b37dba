"""Packing documents into token sequences by the linear grouping scheme.

Large lengths are rounded up inside groups of equal cardinality, the few sizes left are
packed by optimised configurations (column generation), the actual documents take the slots
of their group, and what remains is filled best-fit: documents no configuration took, then
the small ones. The plan needs only how many pieces have each length (at most ``capacity``
numbers, whatever the number of documents). It names ranges: pieces of one length with ranks
from a to b go, so many to a sequence, to sequences from s on, at one offset. Pieces are
numbered inside their length by Spark and find their range by a join with the plan.

Defined results: null or empty text is the end token alone; only documents longer than the
capacity are cut; repeated rows are packed each; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passlane.llm.common import cut, number_rows, ship
from passlane.llm.wordbpe import word_bpe

END_ID = 0


# -- the plan, from counts of lengths

def best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, Counter]:
    """Most valuable multiset of ``sizes`` (ascending) that fits: a knapsack, by number of items."""
    worth, took = [np.zeros(capacity + 1)], []
    for _ in range(capacity // int(sizes[0])):
        now, best = worth[-1].copy(), np.full(capacity + 1, -1)
        for k, (s, v) in enumerate(zip(sizes.tolist(), values.tolist(), strict=True)):
            if v > 0:
                with_it = worth[-1][:capacity + 1 - s] + v
                better = with_it > now[s:] + 1e-12
                now[s:][better] = with_it[better]
                best[s:][better] = k
        worth.append(now)
        took.append(best)
    found, c = Counter(), capacity
    for best in reversed(took):
        if best[c] >= 0:
            found[int(best[c])] += 1
            c -= int(sizes[best[c]])
    return float(worth[-1][capacity]), found


def optimise(sizes: np.ndarray, demand: np.ndarray, capacity: int, most_steps: int = 4000) -> list[tuple[Counter, int]]:
    """Configurations (multisets of positions in ``sizes``) and how often to use each.

    Column generation over the fractional covering problem, rounded down; so up to one
    sequence for each size is left to the best-fit step.
    """
    n = len(sizes)
    columns = [Counter({k: capacity // int(sizes[k])}) for k in range(n)]
    inverse = np.diag([1.0 / (capacity // int(s)) for s in sizes])
    uses = inverse @ demand
    for _ in range(most_steps):
        worth, column = best_configuration(sizes, inverse.sum(axis=0), capacity)
        if worth <= 1 + 1e-7:
            break
        a = np.zeros(n)
        for k, m in column.items():
            a[k] = m
        step = inverse @ a
        ratio = np.where(step > 1e-9, uses / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        uses = uses - ratio[out] * step
        uses[out] = ratio[out]
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        columns[out] = column
    return [(c, int(u + 1e-6)) for c, u in zip(columns, uses, strict=True) if u + 1e-6 >= 1]


class Plan:
    """Ranges (length, rank_from, rank_to, seq_from, per_seq, offset) and the open sequences."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, dict(counts)
        self.next_rank: dict[int, int] = defaultdict(int)
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: (first sequence, how many)
        self.rooms: list[int] = []

    def take(self, length: int, sequences: int, first: int, per: int, offset: int) -> None:
        a = self.next_rank[length]
        self.next_rank[length] = a + sequences * per
        self.left[length] -= sequences * per
        self.rows.append((length, a, a + sequences * per, first, per, offset))

    def keep_open(self, room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            if not self.open[room]:
                insort(self.rooms, room)
            self.open[room].append((first, n))

    def new(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def configure(self, slots: list[list[tuple[int, int]]], n: int) -> None:
        """``n`` sequences; each slot lists runs (length, how many) of the documents that fill it."""
        first, done = self.new(n), 0
        at = [[0, 0] for _ in slots]  # run, used of it
        while done < n:
            m = min(s[a[0]][1] - a[1] for s, a in zip(slots, at, strict=True))
            offset = 0
            for s, a in zip(slots, at, strict=True):
                length = s[a[0]][0]
                self.take(length, m, first + done, 1, offset)
                offset += length
                a[1] += m
                if a[1] == s[a[0]][1]:
                    a[0], a[1] = a[0] + 1, 0
            self.keep_open(self.capacity - offset, first + done, m)
            done += m

    def best_fit(self, length: int) -> None:
        """Each document left of this length to the sequence with the least room that holds it."""
        while (c := self.left.get(length, 0)) > 0:
            k = bisect_left(self.rooms, length)
            if k == len(self.rooms):
                per = self.capacity // length
                n = max(1, c // per)
                first, room, per = self.new(n), self.capacity, min(per, c)
            else:
                room = self.rooms[k]
                first, n = self.open[room].pop()
                if not self.open[room]:
                    self.rooms.pop(k)
                per = min(room // length, c)
                m = min(n, max(1, c // per))
                self.keep_open(room, first + m, n - m)
                n = m
            self.take(length, n, first, per, self.capacity - room)
            self.keep_open(room - per * length, first, n)


def make_plan(counts: dict[int, int], capacity: int, groups: int = 128, small_part: int = 4) -> Plan:
    """The linear grouping scheme on counts of lengths (1 to ``capacity``)."""
    plan = Plan(counts, capacity)
    if full := counts.get(capacity, 0):
        plan.take(capacity, full, plan.new(full), 1, 0)
    large = sorted((x for x, c in counts.items() if c and capacity // small_part < x < capacity), reverse=True)
    total = sum(counts[x] for x in large)
    if total:
        share, members = -(-total // groups), []  # of each group: runs (length, how many), largest first
        room = 0
        for x in large:
            c = counts[x]
            while c:
                if not room:
                    members.append([])
                    room = share
                m = min(c, room)
                members[-1].append((x, m))
                c, room = c - m, room - m
        sizes: dict[int, list[tuple[int, int]]] = {}
        for runs in members:  # groups of one size are one
            sizes.setdefault(runs[0][0], []).extend(runs)
        order = sorted(sizes)
        demand = np.array([sum(m for _, m in sizes[s]) for s in order], float)
        queue = {s: list(reversed(sizes[s])) for s in order}
        held = {s: int(d) for s, d in zip(order, demand, strict=True)}
        for config, n in optimise(np.array(order), demand, capacity):
            slots = [order[k] for k, m in sorted(config.items(), reverse=True) for _ in range(m)]
            n = min(n, *(held[order[k]] // m for k, m in config.items()))
            if n < 1:
                continue
            runs = []
            for s in slots:
                need, got = n, []
                while need:
                    length, m = queue[s].pop()
                    use = min(m, need)
                    got.append((length, use))
                    need -= use
                    if m > use:
                        queue[s].append((length, m - use))
                held[s] -= n
                runs.append(got)
            plan.configure(runs, n)
    for x in sorted(counts, reverse=True):
        plan.best_fit(x)
    return plan


# -- Spark

def cut_pieces(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """Documents to pieces: doc_id, piece, start, length, ids_crc32."""
    ship(docs.sparkSession)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok, end = word_bpe(path), np.array([END_ID], "<u4").tobytes()
        for b in batches:
            ids, rows = tok.encode(list(b["text"])), []
            for doc_id, x in zip(b["doc_id"], ids, strict=True):
                raw = x.astype("<u4").tobytes() + end
                rows += [(doc_id, k, k * capacity, (len(part) // 4), zlib.crc32(part))
                         for k in range(-(-len(raw) // (4 * capacity)))
                         for part in [raw[4 * k * capacity:4 * (k + 1) * capacity]]]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    # pandas would turn ids beside a null into floating point, so they travel as text
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(
        pieces, "doc_id string, piece int, start long, length long, ids_crc32 long").withColumn(
        "doc_id", F.col("doc_id").cast("long"))


def place_pieces(pieces: DataFrame, capacity: int = 2048, groups: int = 128) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with ``doc_id, piece, ids_crc32`` and a
    ``length`` from 1 to ``capacity``. ``pieces`` is read several times and should be stored."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    rows = make_plan(counts, capacity, groups).rows
    schema = "p_length long, rank_from long, rank_to long, seq_from long, per_seq long, at long"
    plan = spark.createDataFrame(rows, schema)
    ranked = number_rows(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "_rank")
    inside = (F.col("length") == F.col("p_length")) & (F.col("_rank") >= F.col("rank_from")) & (
        F.col("_rank") < F.col("rank_to"))
    place = F.col("_rank") - F.col("rank_from")
    # The plan grows with the capacity and the groups alone (some thousand rows).
    return (ranked.join(F.broadcast(plan), inside)
            .withColumn("sequence_id", (F.col("seq_from") + F.floor(place / F.col("per_seq"))).cast("long"))
            .withColumn("offset", (F.col("at") + place % F.col("per_seq") * F.col("length")).cast("long"))
            .drop("_rank", "p_length", "rank_from", "rank_to", "seq_from", "per_seq", "at"))


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, groups: int = 128) -> DataFrame:
    """Tokenise, cut and pack whole documents: one row per piece with its place."""
    return place_pieces(cut(cut_pieces(docs, path, capacity)), capacity, groups)
