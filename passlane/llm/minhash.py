"""Near-duplicate documents by b-bit MinHash.

A document is the set of its distinct shingles (64-bit hashes of word runs). Its signature
keeps ``rows * bands`` minima; the bands of full minima name buckets, and of every minimum
``bits`` low bits are retained and packed into longs. Documents that share a bucket are
candidates; a candidate passes if the similarity estimated from the packed bits (bit counts,
corrected for chance agreement of b-bit values) may reach the threshold, and is confirmed on
the full sets of both texts.

``bands`` follows from the threshold: two documents at the threshold share no bucket with a
probability below ``MISS``; the estimate may fall six standard deviations short.

Equal sets are one class from the start, so copies are never compared. Every bucket has a hub,
the class that meets most others in its buckets; each class is first compared with the hubs of
its buckets alone. Where the classes of one hub then still lie in several components, their
full sets are compared across components inside tasks of at most two blocks of ``BLOCK_ROWS``
classes, and only links come out, at most one for each two components. So no link between
components is lost, and a group of near copies never becomes rows of all its pairs.

Defined results: null, empty and blank texts have no shingles and no links; a text shorter
than a shingle is one shingle; repeated rows are one class; rows with a null doc_id take part
and never give a component its name unless it has no other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passlane.llm.common import cut, md5_of, ship
from passlane.llm.components import connected
from passlane.llm.vector import mix, word_hashes

MISS = 1e-7
SEED = 20_231
#: Classes of one hub that a task compares with as many others; and shingles it counts at a time.
BLOCK_ROWS, BLOCK_COLUMNS = 800, 8192


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; of all words if there are fewer."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    k = min(n, size)
    total = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        total = mix(total + words[i:n - k + 1 + i] + np.uint64(i + 1))
    return np.unique(total)


def bands_for(similarity: float, rows: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - similarity ** rows))


def _coefficients(k: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(SEED))
    a = r.integers(0, 1 << 63, k, np.uint64) * np.uint64(2) + np.uint64(1)
    return a, r.integers(0, 1 << 63, k, np.uint64)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 1024):
        np.minimum(low, (shingles[k:k + 1024, None] * a + b).min(axis=0), out=low)
    return low


def pack(low: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` low bits of each minimum, packed into longs (first minimum lowest)."""
    low_bits = (mix(low) & np.uint64((1 << bits) - 1))
    per = 64 // bits
    out = np.zeros(-(-len(low) // per), np.uint64)
    for i in range(per):
        part = low_bits[i::per]
        out[:len(part)] |= part << np.uint64(bits * i)
    return out.view(np.int64)


def signatures(docs: DataFrame, words: int, rows: int, bands: int, bits: int) -> DataFrame:
    """One row per document: doc_id, text_key, n_shingles, set_key, bands, packed."""
    ship(docs.sparkSession)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = _coefficients(rows * bands)
        number = np.arange(bands, dtype=np.uint64)
        for batch in batches:
            out = []
            for hashes in word_hashes(["" if t is None else t for t in batch["text"]]):
                s = shingle_set(hashes, words)
                if not len(s):
                    out.append((0, None, None, None))
                    continue
                low = minima(s, a, b)
                parts = low.reshape(bands, rows)
                band = mix(number)
                for i in range(rows):
                    band = mix(band + parts[:, i])
                out.append((len(s), hashlib.md5(s.tobytes()).digest(), band.view(np.int64), pack(low, bits)))
            found = pd.DataFrame(out, columns=["n_shingles", "set_key", "bands", "packed"], index=batch.index)
            yield pd.concat([batch[["doc_id", "text_key"]], found], axis=1)

    schema = "doc_id string, text_key binary, n_shingles long, set_key binary, bands array<long>, packed array<long>"
    return (docs.select(F.col("doc_id").cast("string").alias("doc_id"), md5_of(F.col("text")).alias("text_key"), "text")
            .mapInPandas(sign, schema).withColumn("doc_id", F.col("doc_id").cast("long")))


def estimate(p: Column, q: Column, k: int, bits: int) -> Column:
    """Similarity from packed minima, corrected for the 2**-bits of chance agreements."""
    longs = -(-k * bits // 64)
    ones = sum(1 << (bits * i) for i in range(64 // bits))
    ones -= (1 << 64) if ones >= 1 << 63 else 0

    def differ(i: int) -> Column:
        x = p[i].bitwiseXOR(q[i])
        any_bit = reduce(lambda s, j: s.bitwiseOR(F.shiftrightunsigned(x, j)), range(1, bits), x)
        return F.bit_count(any_bit.bitwiseAND(F.lit(ones)))

    same = F.lit(k) - reduce(lambda s, i: s + differ(i), range(1, longs), differ(0))
    chance = 2.0 ** -bits
    return (same / F.lit(float(k)) - chance) / (1 - chance)


def _plausible(size_a: Column, size_b: Column, p: Column, q: Column, percent: int, k: int, bits: int) -> Column:
    s, chance = percent / 100, 2.0 ** -bits
    e = chance + (1 - chance) * s
    slack = 6 * math.sqrt(e * (1 - e) / k) / (1 - chance)
    return (F.least(size_a, size_b) * 100 >= F.greatest(size_a, size_b) * percent) & (
        estimate(p, q, k, bits) >= s - slack)


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those pairs (a, b) of classes whose full sets reach the threshold."""
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok, held = [], (None, None)  # pairs of one hub come together
            for a, b, ta, tb in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"], strict=True):
                if held[0] != b:
                    held = b, shingle_set(word_hashes([tb])[0], words)
                s, t = shingle_set(word_hashes([ta])[0], words), held[1]
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * both >= percent * (len(s) + len(t) - both))
            yield batch.loc[ok, ["a", "b"]]

    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return with_b.select("a", "b", "text_a", "text_b").mapInPandas(check, "a long, b long")


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from one-hot columns of the shingles that two sets share."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = df[column] > 1
    row, column = row[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = column.argsort(kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, BLOCK_COLUMNS):
        a, b = np.searchsorted(column, (k, k + BLOCK_COLUMNS))
        hot = np.zeros((len(sets), BLOCK_COLUMNS), np.float32)
        hot[row[a:b], column[a:b] - k] = 1
        both += hot @ hot.T
    return both


def _links_across(members: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between components of one hub: ``members`` (hub, node, component, n, text),
    ``n`` the members of the hub. Exact: all pairs of classes of different components are held
    against the threshold."""
    blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    dealt = (members.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
             .select("hub", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
                     "own", "node", "component", "text"))

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("node")
        own, node, component = (g[c].to_numpy(np.int64) for c in ("own", "node", "component"))
        found = []
        if len(set(component)) > 1:
            sets = [shingle_set(h, words) for h in word_hashes(list(g["text"]))]
            size = np.array([len(s) for s in sets], np.int64)
            both = _overlaps(sets).astype(np.int64)
            ok = 100 * both >= percent * (size[:, None] + size[None, :] - both)
            ok &= component[:, None] != component[None, :]
            if g["low"].iloc[0] != g["high"].iloc[0]:
                ok &= own[:, None] != own[None, :]  # the pairs of one block have a task of their own
            top = {c: c for c in component.tolist()}
            for i, j in zip(*np.nonzero(np.triu(ok)), strict=True):
                x, y = int(component[i]), int(component[j])
                while top[x] != x:
                    x = top[x]
                while top[y] != y:
                    y = top[y]
                if x != y:
                    top[x] = y
                    found.append((node[i], node[j]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("hub", "low", "high").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, rows: int = 4, bits: int = 2) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, and text_key, rep_key.

    ``component_id`` is the smallest doc_id reachable over links of ``100 * intersection >=
    percent * union``; ``rep_key`` tells apart texts that carry that doc_id.
    """
    bands = bands_for(percent / 100, rows)
    k = rows * bands
    docs = docs.select("doc_id", "text")
    signed = cut(signatures(docs, words, rows, bands, bits))
    rep = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    classes = cut(signed.where("n_shingles > 0").groupBy("set_key").agg(
        F.min(rep).alias("rep"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"),
        F.first("packed").alias("packed"))).withColumn("node", F.monotonically_increasing_id())

    members = classes.select(F.explode("bands").alias("bucket"), "node")
    met = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = cut(members.join(met, "bucket").select("bucket", "node", "n"))
    central = members.groupBy("node").agg(F.sum("n").alias("score"))
    hubs = members.join(central, "node").groupBy("bucket").agg(
        F.max(F.struct("score", (-F.col("node")).alias("neg"))).alias("best")).select(
        "bucket", (-F.col("best.neg")).alias("hub"))
    facts = classes.select("node", "size", "packed")
    sides = lambda c: facts.select(*[F.col(x).alias(f"{x}_{c}") for x in facts.columns])
    members = cut(members.join(hubs, "bucket").select("hub", "node").distinct())
    stars = members.where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    stars = cut(stars.join(sides("a"), F.col("a") == F.col("node_a")).join(sides("b"), F.col("b") == F.col("node_b"))
                .where(_plausible(F.col("size_a"), F.col("size_b"), F.col("packed_a"), F.col("packed_b"),
                                  percent, k, bits)).select("a", "b"))

    wanted = classes.join(members.select("node").distinct(), "node").select(
        "node", F.col("rep.doc_id").alias("r_id"), F.col("rep.text_key").alias("r_key"))
    keyed = docs.select("doc_id", md5_of(F.col("text")).alias("text_key"), "text")
    texts = cut(keyed.join(wanted, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_key") == F.col("r_key")))
                .groupBy("node").agg(F.first("text").alias("text")))
    links = cut(_confirmed(stars, texts, words, percent))
    found = connected(links)

    # Hubs whose classes still lie in several components: compare across them.
    placed = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("hub").agg(F.min("component").alias("x"), F.max("component").alias("y"),
                                      F.count("*").alias("n")).where("x != y")
    apart = cut(placed.join(mixed.select("hub", "n"), "hub").select("hub", "node", "component", "n"))
    more = cut(_links_across(apart.join(texts, "node"), words, percent))
    if not more.isEmpty():
        found = connected(links.unionByName(more))

    named = (classes.select("set_key", "node", "rep").join(found, "node", "left")
             .withColumn("component", F.coalesce("component", "node")))
    best = named.groupBy("component").agg(F.min("rep").alias("best"))
    named = named.join(best, "component").select(
        F.col("set_key").alias("c_key"), F.col("best.doc_id").alias("best_id"), F.col("best.text_key").alias("rep_key"))
    alone = F.col("n_shingles") == 0
    return (signed.select("doc_id", "text_key", "n_shingles", "set_key")
            .join(named, F.col("set_key") == F.col("c_key"), "left")
            .withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("best_id")))
            .withColumn("rep_key", F.when(alone, F.col("text_key")).otherwise(F.col("rep_key")))
            .select("doc_id", "n_shingles", "component_id",
                    F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_key", "rep_key"))


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80, rows: int = 4, bits: int = 2) -> DataFrame:
    """``docs`` without documents that another of their component stands for, all columns kept."""
    gone = near_duplicates(docs, words, percent, rows, bits).where(
        ~(F.col("kept") & (F.col("text_key") == F.col("rep_key")))).select(
        F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_key")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col("_gone_id")) & (
        md5_of(docs["text"]) == F.col("_gone_key")), "left_anti")
