"""Byte-level BPE encoding by tree concatenation, and decoding.

Text is first cut where a cut can never change the result: before a space that is followed
by a character that is no white space, and around special tokens. Such a chunk is short in
ordinary prose and is merged at once. A longer chunk, and a document longer than ``spread_chars``, has no such cut that may
be used cheaply: it is cut into leaves at any character, the leaves are encoded in parallel,
and neighbours are joined in a tree. A join re-encodes a window around the seam that grows
until its first and its last piece agree with what both sides had there; inside one piece
that spans the seam the same is done on tokens. Both are exact: pre-tokenisation from an
agreed piece on depends only on what follows, and a BPE sequence is the encoding of its text
when all neighbouring tokens are.

Defined results: null counts as empty, empty text has no ids; the text of a special token
becomes that token, as in the library; ids no token has are skipped when decoding and bytes
that are no UTF-8 decode to U+FFFD; every row is encoded, repeated ones too; other columns
are kept (the new ones replace columns of the same name).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passlane.llm.common import md5_of, ship
from passlane.llm.vector import SpanIds, blocks, code_points

LEAF_CHARS = 1024
SPREAD_CHARS = 65_536
#: Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters before which a space is no safe cut (white space of either library).
BLANKS = np.array([*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                   0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
#: Distinct chunks remembered by a worker.
MEMORY = 250_000
#: A window reaches at least this far on either side, longer than any special token.
MARGIN = 32


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    out |= {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in out)}
    return [out[b] for b in range(256)]


class Codec:
    """One tokenizer file: encode to little-endian unsigned 32-bit ids, and decode."""

    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS):
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.leaf = leaf_chars
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.alphabet = byte_alphabet()
        back = {c: b for b, c in enumerate(self.alphabet)}
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.bytes_of = {
            i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in vocab.items()}
        self.flat = np.frombuffer(b"".join(self.bytes_of[i] for i in sorted(self.bytes_of)), np.uint8)
        self.lens = np.zeros(max(self.bytes_of) + 2, np.int64)  # the last stands for ids of no token
        for i, raw in self.bytes_of.items():
            self.lens[i] = len(raw)
        self.starts = np.cumsum(self.lens) - self.lens
        # The same merges without the library's overhead for each token; ids are ranks.
        self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, special_tokens={}, mergeable_ranks={
            raw: i for i, raw in self.bytes_of.items() if i not in self.special.values()})
        self.seen = SpanIds(MEMORY)

    # -- chunks

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text, little-endian unsigned 32-bit."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        out, plain = [b""] * len(texts), []
        for k, t in enumerate(texts):
            if t and any(s in t for s in self.special):
                out[k] = b"".join(
                    np.uint32(self.special[p]).tobytes() if p in self.special else self.encode(p)
                    for p in self.at_special.split(t) if p)
            elif t:
                plain.append(k)
        for first, held in blocks(texts[k] for k in plain):
            for k, ids in enumerate(self._block(held)):
                out[plain[first + k]] = ids.tobytes()
        return out

    def _block(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        units = code_points(joined)
        stops = np.cumsum([len(t) for t in texts])
        safe = np.zeros(len(units), bool)  # a chunk starts here
        spaces = np.flatnonzero(units[:-1] == 32)
        safe[spaces[~np.isin(units[spaces + 1], BLANKS)]] = True
        safe[stops[:-1] - 1] = False
        safe[0] = True
        safe[stops[:-1]] = True
        starts = np.flatnonzero(safe)
        ends = np.append(starts[1:], len(units))
        ids, stop = self.seen.ids(units, starts, ends, joined, self._new)
        return np.split(ids.astype("<u4"), np.concatenate([[0], stop])[np.searchsorted(starts, stops[:-1])])

    def _new(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks, and the number of each."""
        counts = np.zeros(len(chunks), np.int64)
        alone: dict[int, np.ndarray] = {}
        run = []
        for k, c in enumerate(chunks):
            if len(c) > self.leaf:
                alone[k] = self.tree(c).ids
            elif c[0] == " " and not c[1:2].isspace() and len(c) > 1:
                run.append(k)  # starts at a safe cut whatever stands before it
            else:
                alone[k] = self.fast.encode_to_numpy(c, disallowed_special=())
            if k in alone:
                counts[k] = len(alone[k])
        got = np.empty(0, np.uint32)
        if run:
            got = self.fast.encode_to_numpy("".join(chunks[k] for k in run), disallowed_special=())
            at = np.cumsum([len(chunks[k].encode()) for k in run])
            counts[run] = np.diff(np.searchsorted(np.cumsum(self.lens[got]), at) + 1, prepend=0)
        # the ids of a run lie behind each other: all go to their chunks' places at once
        starts, size = np.cumsum(counts) - counts, counts[run]
        ids = np.empty(int(counts.sum()), np.uint32)
        ids[np.repeat(starts[run] - (np.cumsum(size) - size), size) + np.arange(len(got))] = got
        for k, found in alone.items():
            ids[starts[k]:starts[k] + len(found)] = found
        return ids, counts

    # -- trees

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of ``text`` that join to it; a special token is one."""
        out = []
        for part in (self.at_special.split(text) if self.at_special is not None else [text]):
            if part in self.special:
                out.append(part)
            elif part:
                out += [part[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def _bpe(self, raw: bytes) -> np.ndarray:
        shown = "".join(map(self.alphabet.__getitem__, raw))
        return np.array([t.id for t in self.tok.model.tokenize(shown)], np.uint32)

    def _piece_ids(self, piece: str) -> np.ndarray:
        if piece in self.special:
            return np.array([self.special[piece]], np.uint32)
        if len(piece) <= self.leaf:
            return self._bpe(piece.encode())
        half = len(piece) // 2
        return self.join_tokens(self._piece_ids(piece[:half]), self._piece_ids(piece[half:]))

    def join_tokens(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ids of two halves of one pre-token to the ids of the whole."""
        if not len(a) or not len(b):
            return np.concatenate([a, b])
        w = 1
        while True:
            i, j = min(w, len(a)), min(w, len(b))
            got = self._bpe(b"".join(self.bytes_of[int(x)] for x in (*a[len(a) - i:], *b[:j])))
            if (i == len(a) or got[0] == a[len(a) - i]) and (j == len(b) or got[-1] == b[j - 1]):
                return np.concatenate([a[:len(a) - i], got, b[j:]])
            w *= 2

    def leaf_segment(self, text: str) -> Segment:
        pieces = self.pieces(text)
        ids = [self._piece_ids(p) for p in pieces]
        return Segment(text, np.cumsum([len(p) for p in pieces], dtype=np.int64),
                       np.array([len(x) for x in ids], np.int64), np.concatenate([np.empty(0, np.uint32), *ids]))

    def tree(self, text: str) -> Segment:
        if len(text) <= self.leaf:
            return self.leaf_segment(text)
        half = len(text) // 2
        return self.join(self.tree(text[:half]), self.tree(text[half:]))

    def join(self, a: Segment, b: Segment) -> Segment:
        """Two encoded halves to the encoded whole, exactly."""
        if not a.text or not b.text:
            return b if not a.text else a
        na, nb, w = len(a.ends), len(b.ends), 1
        while True:
            start = 0 if w >= na else int(a.ends[na - w - 1])
            end = len(b.text) if w >= nb else int(b.ends[w - 1])
            far = (not start or len(a.text) - start >= MARGIN) and (end == len(b.text) or end >= MARGIN)
            if far:
                pieces = self.pieces(a.text[start:] + b.text[:end])
                i, j = min(w, na), min(w, nb)
                left = not start or len(pieces[0]) == int(a.ends[na - i]) - start
                right = end == len(b.text) or len(pieces[-1]) == end - (int(b.ends[j - 2]) if j > 1 else 0)
                if left and right:
                    break
            w *= 2
        ids, at, seam = [], 0, len(a.text) - start
        a_piece = a.piece(na - 1)
        b_piece = b.piece(0)
        for p in pieces:
            if p not in self.special and at < seam < at + len(p) and len(p) > self.leaf and (
                    at + len(a_piece) == seam and at + len(p) == seam + len(b_piece)):
                ids.append(self.join_tokens(a.piece_ids(na - 1), b.piece_ids(0)))  # one pre-token spans the seam
            else:
                ids.append(self._piece_ids(p))
            at += len(p)
        a_kept, b_cut = int(a.counts[:na - i].sum()), int(b.counts[:j].sum())
        return Segment(
            a.text + b.text,
            np.concatenate([a.ends[:na - i], start + np.cumsum([len(p) for p in pieces], dtype=np.int64),
                            len(a.text) + b.ends[j:]]),
            np.concatenate([a.counts[:na - i], np.array([len(x) for x in ids], np.int64), b.counts[j:]]),
            np.concatenate([a.ids[:a_kept], *ids, b.ids[b_cut:]]))

    def decode(self, ids: bytes | None) -> str:
        """Text of packed ids, special tokens included."""
        at = np.frombuffer(ids or b"", "<u4").astype(np.int64)
        at[at >= len(self.lens)] = len(self.lens) - 1
        lens = self.lens[at]
        stops = np.cumsum(lens)
        total = int(stops[-1]) if len(stops) else 0
        where = np.repeat(self.starts[at] - (stops - lens), lens) + np.arange(total)
        return self.flat[where].tobytes().decode("utf-8", "replace")


class Segment:
    """Encoded text: end of each pre-token, its number of ids, and all ids."""

    def __init__(self, text: str, ends: np.ndarray, counts: np.ndarray, ids: np.ndarray):
        self.text, self.ends, self.counts, self.ids = text, ends, counts, ids

    def piece(self, k: int) -> str:
        return self.text[int(self.ends[k - 1]) if k else 0:int(self.ends[k])]

    def piece_ids(self, k: int) -> np.ndarray:
        before = int(self.counts[:k].sum())
        return self.ids[before:before + int(self.counts[k])]


@lru_cache(maxsize=4)
def codec(path: str, leaf_chars: int = LEAF_CHARS) -> Codec:
    return Codec(path, leaf_chars)


def _encode_long(long: DataFrame, path: str, leaf_chars: int, spread_chars: int) -> DataFrame:
    """Distinct long texts (key, text) to (key, ids): leaves are rows of their own, encoded by
    any task; the leaves of one text meet in one task, which joins them in a tree."""
    leaves = (long.select("key", "text", F.explode(F.sequence(
        F.lit(0), F.floor((F.length("text") - 1) / spread_chars).cast("int"))).alias("leaf"))
        .select("key", "leaf", F.expr(f"substring(text, leaf * {spread_chars} + 1, {spread_chars})").alias("text"))
        .repartition("key", "leaf"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path, leaf_chars)
        for b in batches:
            found = [c.tree(t) for t in b["text"]]
            yield pd.DataFrame({
                "key": b["key"], "leaf": b["leaf"], "text": b["text"],
                "ends": [s.ends.astype("<i8").tobytes() for s in found],
                "counts": [s.counts.astype("<i8").tobytes() for s in found],
                "ids": [s.ids.astype("<u4").tobytes() for s in found]})

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        c, g = codec(path, leaf_chars), g.sort_values("leaf")
        level = [Segment(t, np.frombuffer(e, "<i8"), np.frombuffer(n, "<i8"), np.frombuffer(i, "<u4"))
                 for t, e, n, i in zip(g["text"], g["ends"], g["counts"], g["ids"], strict=True)]
        while len(level) > 1:
            level = [c.join(*level[k:k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        return pd.DataFrame({"key": [g["key"].iloc[0]], "ids": [level[0].ids.astype("<u4").tobytes()]})

    return (leaves.mapInPandas(encode, "key binary, leaf int, text string, ends binary, counts binary, ids binary")
            .groupBy("key").applyInPandas(merge, "key binary, ids binary"))


def encode_documents(docs: DataFrame, path: str, leaf_chars: int = LEAF_CHARS,
                     spread_chars: int = SPREAD_CHARS) -> DataFrame:
    """``docs`` with ``ids``: the ids of the whole text, little-endian unsigned 32-bit."""
    ship(docs.sparkSession)

    @F.pandas_udf("binary")
    def encode(text: pd.Series) -> pd.Series:
        c = codec(path, leaf_chars)
        return pd.Series(c.encode_all(list(text)), dtype=object)

    docs = docs.drop("ids")
    is_long = F.length(F.coalesce("text", F.lit(""))) > spread_chars
    short = docs.where(~is_long).withColumn("ids", encode("text"))
    long = docs.where(is_long).withColumn("_key", md5_of(F.col("text")))
    texts = long.select(F.col("_key").alias("key"), "text").groupBy("key").agg(F.first("text").alias("text"))
    done = _encode_long(texts, path, leaf_chars, spread_chars).select(F.col("key").alias("_done"), F.col("ids").alias("ids"))
    return short.unionByName(long.join(done, F.col("_key") == F.col("_done")).drop("_key", "_done"))


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded``: the text of its ``ids``, special tokens included."""
    ship(encoded.sparkSession)

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        c = codec(path)
        return pd.Series([c.decode(i) for i in ids], dtype=object)

    return encoded.withColumn("decoded", decode("ids"))
