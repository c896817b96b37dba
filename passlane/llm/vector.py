"""Words of many texts at once, as numpy arrays: spans and 64-bit hashes.

A span's hash is the sum of well-mixed values of its characters *and their places in the span*,
taken from prefix sums, so that all spans of a block of texts cost a few array operations. It is
not linear in the characters, so no pattern of characters cancels out; and where a result hangs on
a span being the same (``distinct_spans``, ``SpanIds``), the characters themselves are compared.
Blocks hold a bounded number of characters, or one text if that is longer.

Defined results: no spans give no hashes; equal spans have equal hashes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

BLOCK = 1_000_000
#: Fixed value: an odd multiplier.
STEP = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of unsigned 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of units[start:end] for each span; ``units`` are well-mixed unsigned 64-bit values, spans
    are in order and do not overlap."""
    begin = np.zeros(len(units), np.int64)
    begin[starts] = starts
    place = np.arange(len(units)) - np.maximum.accumulate(begin)
    sums = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(mix(units + place.astype(np.uint64) * np.uint64(STEP)), dtype=np.uint64, out=sums[1:])
    return mix(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64))


def distinct_spans(hashes: np.ndarray, units: np.ndarray, starts: np.ndarray, ends: np.ndarray
                   ) -> tuple[np.ndarray, np.ndarray]:
    """(at, which): a span for each distinct content, and for each span which content it has.

    Spans are brought together by hash and then compared character by character (``units`` are
    the characters); only if two with one hash differ are they told apart by their content."""
    _, at, which = np.unique(hashes, return_index=True, return_inverse=True)
    size, first = ends - starts, at[which]
    if (size == size[first]).all():
        here = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())
        if (units[here] == units[here + np.repeat(starts[first] - starts, size)]).all():
            return at, which
    seen: dict[bytes, int] = {}
    which = np.array([seen.setdefault(units[s:e].tobytes(), len(seen)) for s, e in zip(starts, ends, strict=True)], np.int64)
    return np.unique(which, return_index=True)[1], which


def blocks(texts: Iterable[str], size: int = BLOCK) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``size`` characters: number of the first text, and the texts."""
    first, held, n = 0, [], 0
    for k, t in enumerate(texts):
        if held and n + len(t) > size:
            yield first, held
            first, held, n = k, [], 0
        held.append(t)
        n += len(t) + 1
    if held:
        yield first, held


_BYTE_UNITS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """For each text the hashes of its words ``[^\\x20\\x09-\\x0D]+`` in order, A-Z lower-cased."""
    out: list[np.ndarray] = []
    for _, held in blocks(texts):
        raws = [t.encode("utf-8", "surrogatepass") for t in held]
        data = _LOWER[np.frombuffer(b"\n".join([*raws, b""]), np.uint8)]
        blank = _BLANK[data]
        inner = np.empty(len(data) + 1, bool)
        inner[0] = inner[-1] = False
        np.logical_not(blank, out=inner[:-1])
        edge = np.flatnonzero(np.diff(inner.view(np.int8), prepend=0))
        starts, ends = edge[::2], edge[1::2]
        hashes = span_hashes(_BYTE_UNITS[data], starts, ends)
        at = np.cumsum([len(r) + 1 for r in raws])
        out += np.split(hashes, np.searchsorted(starts, at[:-1]))
    return out


class SpanIds:
    """Token ids of the distinct spans seen so far, found by their text; starts anew when full."""

    def __init__(self, most: int):
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.where: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.start, self.count = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def add(self, spans: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        n, m = len(self.where), len(spans)
        assert len(counts) == m
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while n + m > len(self.start):
            self.start, self.count = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.count))
        self.flat[self.used:self.used + len(ids)] = ids
        self.start[n:n + m], self.count[n:n + m] = self.used + np.cumsum(counts) - counts, counts
        self.used += len(ids)
        self.where.update(zip(spans, range(n, n + m), strict=True))

    def ids(self, units: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: str,
            encode) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all spans of ``text`` (with code points ``units``) in order, and where each span's ids stop.

        ``encode`` takes the strings of new spans, gives all their ids and the number of each.
        """
        at, which = distinct_spans(span_hashes(code_units(units), starts, ends), units, starts, ends)
        if len(self.where) + len(at) > self.most:
            self.forget()
        keys = [text[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        got = [self.where.get(k, -1) for k in keys]
        if new := [k for k, g in enumerate(got) if g < 0]:
            self.add([keys[k] for k in new], *encode([keys[k] for k in new]))
            for k in new:
                got[k] = self.where[keys[k]]
        row = np.array(got, np.int64)[which]
        count = self.count[row]
        stop = np.cumsum(count)
        total = int(stop[-1]) if len(stop) else 0
        return self.flat[np.repeat(self.start[row] - (stop - count), count) + np.arange(total)], stop


#: A well-mixed value for every code point.
_code_units: list[np.ndarray] = []


def code_units(codes: np.ndarray) -> np.ndarray:
    if not _code_units:
        _code_units.append(mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)))
    return _code_units[0][codes]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
