"""Ids of a lower-casing word BPE with word ends, for many texts at once.

The tokenizer's own steps (NFC, white space, lower case, its word pattern, merges by rank
with a word-end mark) are run over blocks of texts with array operations; each distinct word
of a block is merged once. Texts with anything unusual (special tokens, U+0000, characters
whose class differs between Unicode versions, a capital sigma) go to the tokenizers library
itself. Tests compare both on every kind of text.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np

from passlane.llm.tokenizing import byte_alphabet
from passlane.llm.vector import SpanIds, blocks, code_points

#: Words remembered by a worker; when full it starts anew.
MEMORY = 600_000
SPACE, LETTER, NUMBER, OTHER, UNSURE = range(5)
#: White_Space of Unicode, and the endings the pattern splits off after '.
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ("re", "ve", "ll")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point; UNSURE where Unicode versions disagree."""
    kind = {"L": LETTER, "N": NUMBER}
    old, new = unicodedata.ucd_3_2_0.category, unicodedata.category
    out = np.full(0x110000, UNSURE, np.uint8)
    for c in range(0x30000):
        ch = chr(c)
        a, b = old(ch)[0], new(ch)
        if b not in ("Cn", "Cs") and (k := kind.get(b[0], OTHER)) == kind.get(a, OTHER):
            out[c] = k
    out[WHITE] = SPACE
    out[[0, 0x3A3]] = UNSURE
    return out


class WordBpe:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        end, back = spec["model"]["end_of_word_suffix"], {c: b for b, c in enumerate(byte_alphabet())}
        # A word's last unit carries the mark: U+0000 after the word, merged with its last byte first.
        names = {i: bytes(back[c] for c in t.removesuffix(end)) + b"\0" * t.endswith(end)
                 for t, i in spec["model"]["vocab"].items() if t not in self.special}
        ranks, self.id_of = {}, np.zeros(len(names) + 1, np.uint32)
        for rank, (i, name) in enumerate(sorted((i, n) for i, n in names.items())):
            ranks.setdefault(name, rank)
            self.id_of[rank] = i
        self.ends = np.zeros(len(names) + 1, bool)
        for name, rank in ranks.items():
            self.ends[rank] = name.endswith(b"\0") and name != b"\0"
        self.merger = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.seen = SpanIds(MEMORY)

    def _merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ranks = self.merger.encode_to_numpy("\0".join([*words, ""]), disallowed_special=())
        return self.id_of[ranks], np.diff(np.flatnonzero(self.ends[ranks]) + 1, prepend=0)

    def _spans(self, units: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words the pattern finds."""
        n = len(units)
        first = np.empty(n, bool)
        first[0] = True
        np.not_equal(kind[1:], kind[:-1], out=first[1:])
        first |= kind == NUMBER
        quote = np.flatnonzero((units == 39) & first)
        if len(quote):
            after = lambda k: units[np.minimum(quote + k, n - 1)]
            a, b = after(1), after(2)
            two = np.isin(a, [ord(c) for c in SHORT_ENDINGS])
            three = np.zeros(len(quote), bool)
            for x, y in LONG_ENDINGS:
                three |= (a == ord(x)) & (b == ord(y))
            for hit, size in ((two, 2), (three, 3)):
                at = quote[hit]
                first[at + 1] = False
                nxt = at + size
                nxt = nxt[nxt < n]
                first[nxt] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], n)
        word = kind[starts] != SPACE
        return starts[word], ends[word]

    def _block(self, texts: list[str]) -> list[np.ndarray]:
        joined = "\n".join([*texts, ""])
        units = code_points(joined)
        starts, ends = self._spans(units, classes()[units])
        ids, stop = self.seen.ids(units, starts, ends, joined, self._merge)
        words_before = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])[:-1])
        return np.split(ids, np.concatenate([[0], stop])[words_before])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each whole text (null: none), as the library gives them without special tokens added."""
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        plain, where = [], []
        for k, t in enumerate(texts):
            if not t:
                continue
            if t.isascii():
                if any(s in t for s in self.special) or "\0" in t:
                    out[k] = self.slow(t)
                    continue
            else:
                if any(s in t for s in self.special) or self._unsure(t):
                    out[k] = self.slow(t)
                    continue
                if not unicodedata.is_normalized("NFC", t):
                    t = unicodedata.normalize("NFC", t)
            low = t.lower()
            if low.isascii() or not self._unsure(low):
                plain.append(low)
                where.append(k)
            else:
                out[k] = self.slow(t)
        for first, held in blocks(plain):
            for k, ids in enumerate(self._block(held)):
                out[where[first + k]] = ids
        return out

    def _unsure(self, t: str) -> bool:
        return bool((classes()[code_points(t)] == UNSURE).any())

    def slow(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)
