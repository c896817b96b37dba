"""Sharding by longest processing time: groups that must stay together go, largest first,
to the least-loaded shard, kept in a heap.

The heap must not see every group of a large table, so the plan has a bounded number of
items: groups of at least ``1 / (shards * resolution)`` of all bytes are items of their own
(there are at most ``shards * resolution`` of those), and smaller groups are pooled by a hash
of the group into as many pools. Sizes are sums over all rows; no row is left out. One task
schedules the items; rows then get their shard from two joins with tables of that bound.

Defined results: null text has no bytes and stays with the empty text; equal texts stay
together even where their group is larger than a shard's share; an empty table gives no
rows; rows that are repeated are counted and placed each; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passlane.llm.common import cut, md5_of, number_rows, ship


def longest_first(sizes, shards: int) -> list[int]:
    """Shard of each item of ``sizes`` (already sorted, largest first)."""
    heap = [(0, s) for s in range(shards)]
    out = []
    for size in sizes:
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + int(size), shard))
        out.append(shard)
    return out


def schedule(items: DataFrame, shards: int) -> DataFrame:
    """``items`` (item, size), bounded by the caller, to (item, shard) in one task."""
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_items = pd.concat([pd.DataFrame({"item": pd.Series(dtype=object), "size": pd.Series(dtype="int64")}),
                               *batches])
        all_items = all_items.sort_values(["size", "item"], ascending=[False, True])
        yield pd.DataFrame({"item": all_items["item"], "shard": longest_first(all_items["size"], shards)})

    return items.coalesce(1).mapInPandas(place, "item string, shard int")


def assign_shards(rows: DataFrame, shards: int = 24, resolution: int = 1000) -> DataFrame:
    """Add ``shard`` and ``slot`` to rows with ``doc_id``, ``size`` and ``group`` (binary).

    ``rows`` is read several times and should be stored.
    """
    ship(rows.sparkSession)
    pools = shards * resolution
    groups = rows.groupBy("group").agg(F.sum("size").alias("size"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    large_from = max(1, -(-total // pools))
    pool = F.concat(F.lit("p"), F.pmod(F.xxhash64("group"), F.lit(pools)))
    large = groups.where(F.col("size") >= large_from).withColumn("item", F.concat(F.lit("g"), F.hex("group")))
    pooled = groups.where(F.col("size") < large_from).groupBy(pool.alias("item")).agg(F.sum("size").alias("size"))
    large = cut(large)  # at most `pools` rows, as they share all the bytes
    plan = cut(schedule(large.select("item", "size").unionByName(pooled), shards))  # at most 2 * pools rows
    placed = (rows.join(F.broadcast(large.select(F.col("group").alias("_group"), F.col("item").alias("_large"))),
                        F.col("group") == F.col("_group"), "left")
              .withColumn("_item", F.coalesce("_large", pool))
              .join(F.broadcast(plan), F.col("_item") == F.col("item"))
              .drop("_group", "_large", "_item", "item"))
    return number_rows(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot")


def shard_documents(docs: DataFrame, shards: int = 24, resolution: int = 1000) -> DataFrame:
    """Documents to shards of near equal bytes (UTF-8 bytes of the text plus 8 each)."""
    text = F.coalesce("text", F.lit(""))
    rows = cut(docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), md5_of(F.col("text")).alias("group")))
    return assign_shards(rows, shards, resolution).drop("group")
