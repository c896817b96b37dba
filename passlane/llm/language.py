"""Language identification by a linear-chain conditional random field over words.

Every word (a run of letters) gets a language from features of its own (the word, prefixes,
suffixes, character n-grams, membership in a language's lexicon; hashed) and from learned
transitions between neighbours, by forward-backward over chains of at most ``CHAIN`` words.
So text that switches languages gets a label for each word. A document's language is the one
with the largest sum of word marginals over the whole text, its score that sum's share.

The model is fitted on a bounded sample of labelled rows (``per_language`` documents of each
language, ``sample_chars`` characters of each); a part of the training chains is spliced from
two documents, so that transitions between languages are seen. Fitted parameters go to the
executors by a broadcast whose size is ``2**HASH_BITS`` numbers for each language.

Defined results: null, empty or letterless text is ``und`` with score 0; without labelled
rows every document is ``und``; ties go to the first language in sorted order; documents of
a null doc_id are neither held out nor learned from; repeated rows are predicted each.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passlane.llm.common import ship
from passlane.llm.vector import blocks, code_points, code_units, distinct_spans, span_hashes

HASH_BITS = 17
CHAIN = 64
#: Words whose scores a worker remembers.
MEMORY = 400_000
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def word_spans(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of ``text``, and starts and ends of its runs of letters."""
    units = code_points(text)
    inner = np.zeros(len(units) + 1, np.int8)
    inner[:-1] = letters()[units]
    edge = np.flatnonzero(np.diff(inner, prepend=np.int8(0)))
    return units, edge[::2], edge[1::2]


def features(word: str, lexicon: dict[str, list[int]]) -> list[int]:
    """Hashed features of a lower-cased word."""
    w = f"<{word}>"
    names = [f"w{word}", *(f"p{word[:n]}" for n in (1, 2, 3)), *(f"s{word[-n:]}" for n in (1, 2, 3)),
             *(w[i:i + n] for n in (2, 3) for i in range(len(w) - n + 1)),
             *(f"l{k}" for k in lexicon.get(word, ()))]
    mask = (1 << HASH_BITS) - 1
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) & mask for n in names]


def lexicons(words_of: list[Counter], most: int = 2000) -> dict[str, list[int]]:
    """Words that one language uses often and mostly alone, with the numbers of such languages."""
    total = Counter()
    for c in words_of:
        total.update(c)
    out: dict[str, list[int]] = {}
    for k, c in enumerate(words_of):
        for w, n in c.most_common(most):
            if n >= 3 and n >= 0.8 * total[w]:
                out.setdefault(w, []).append(k)
    return out


class Scores:
    """Emission scores of words, by features and weights."""

    def __init__(self, weights: np.ndarray, lexicon: dict[str, list[int]]):
        self.weights, self.lexicon = weights, lexicon

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [features(w, self.lexicon) for w in words]
        counts = np.array([len(f) for f in found], np.int64)
        flat = np.fromiter((x for f in found for x in f), np.int64, int(counts.sum()))
        return np.add.reduceat(self.weights[flat], np.cumsum(counts) - counts, axis=0), flat, counts


def marginals(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over chains.

    ``scores`` (chains, longest, languages), padded; gives the marginals of the same shape and
    the expected transitions, summed.
    """
    n, longest, k = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    step = np.exp(transitions - transitions.max())
    forward, backward = np.empty_like(e), np.ones_like(e)
    forward[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, longest):
        a = forward[:, t - 1] @ step * e[:, t]
        forward[:, t] = a / a.sum(axis=1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        b = (backward[:, t + 1] * e[:, t + 1]) @ step.T
        b /= b.sum(axis=1, keepdims=True)
        backward[:, t] = np.where((t + 1 < lengths)[:, None], b, 1.0)
    both = forward * backward
    both /= both.sum(axis=2, keepdims=True)
    inside = (np.arange(longest) < lengths[:, None])
    moves = np.zeros((k, k))
    for t in range(1, longest):
        x = forward[:, t - 1, :, None] * step * (e[:, t] * backward[:, t])[:, None, :]
        x /= x.sum(axis=(1, 2), keepdims=True)
        moves += x[inside[:, t]].sum(axis=0)
    return both * inside[:, :, None], moves


def _chains(rows: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows of padded chains; what lies beyond a chain repeats its last word."""
    longest = int(lengths.max())
    at = starts[:, None] + np.minimum(np.arange(longest), lengths[:, None] - 1)
    return rows[at]


def fit(samples: list[tuple[str, str]], rounds: int = 30, seed: int = 7) -> dict | None:
    """Model from (language, text): languages, weights, transitions, lexicon."""
    languages = sorted({lang for lang, _ in samples})
    texts = [(languages.index(lang), [w for w in _words(text)]) for lang, text in samples]
    texts = [(k, w) for k, w in texts if w]
    if not texts:
        return None
    n = len(languages)
    words_of = [Counter() for _ in languages]
    for k, w in texts:
        words_of[k].update(w)
    lexicon = lexicons(words_of)
    number: dict[str, int] = {}
    pieces = [(k, np.array([number.setdefault(x, len(number)) for x in w[i:i + CHAIN]]))
              for k, w in texts for i in range(0, len(w), CHAIN)]
    r = np.random.Generator(np.random.PCG64(seed))
    chains = []
    for k, words in pieces:
        labels = np.full(len(words), k)
        if r.random() < 0.25:
            j, other = pieces[int(r.integers(len(pieces)))]
            a, b = int(r.integers(1, len(words) + 1)), int(r.integers(1, len(other) + 1))
            words = np.concatenate([words[:a], other[:b]])[:CHAIN]
            labels = np.concatenate([labels[:a], np.full(b, j)])[:CHAIN]
        chains.append((words, labels))
    lengths = np.array([len(w) for w, _ in chains])
    starts = np.cumsum(lengths) - lengths
    flat_words, flat_labels = (np.concatenate([c[i] for c in chains]) for i in (0, 1))
    _, feats, counts = Scores(np.zeros((1 << HASH_BITS, 1), np.float32), lexicon).of(list(number))
    first = np.cumsum(counts) - counts
    rows, labels = _chains(flat_words, starts, lengths), _chains(flat_labels, starts, lengths)
    inside = np.arange(rows.shape[1]) < lengths[:, None]
    gold = np.eye(n)[labels] * inside[:, :, None]
    seen_moves = np.zeros((n, n))
    follows = inside[:, 1:]
    np.add.at(seen_moves, (labels[:, :-1][follows], labels[:, 1:][follows]), 1)
    weights, transitions = np.zeros((1 << HASH_BITS, n)), np.zeros((n, n))
    squares, move_squares = np.full_like(weights, 1e-6), np.full((n, n), 1e-6)
    total = len(flat_words)
    for _ in range(rounds):
        emission = np.add.reduceat(weights[feats], first, axis=0)
        found, moves = marginals(emission[rows], lengths, transitions)
        gap = (found - gold)[inside]
        by_word = np.stack([np.bincount(flat_words, gap[:, c], len(number)) for c in range(n)], 1)
        spread = np.repeat(by_word, counts, axis=0)
        grad = np.stack([np.bincount(feats, spread[:, c], len(weights)) for c in range(n)], 1) / total + 1e-6 * weights
        squares += grad ** 2
        weights -= 0.3 * grad / np.sqrt(squares)
        move_grad = (moves - seen_moves) / total + 1e-4 * transitions
        move_squares += move_grad ** 2
        transitions -= 0.3 * move_grad / np.sqrt(move_squares)
    return {"languages": languages, "weights": weights.astype(np.float32), "transitions": transitions, "lexicon": lexicon,
            "key": zlib.crc32(weights.tobytes())}


def _words(text: str) -> list[str]:
    _, starts, ends = word_spans(text)
    return [text[s:e].lower() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


_kept: dict[int, Labeller] = {}


def labeller_of(model: dict) -> Labeller:
    """The worker's labeller of this model; that of another model is dropped."""
    if model["key"] not in _kept:
        _kept.clear()
        _kept[model["key"]] = Labeller(model)
    return _kept[model["key"]]


class Labeller:
    """Marginals of the words of many texts; scores of distinct words are remembered."""

    def __init__(self, model: dict):
        self.scores = Scores(model["weights"], model["lexicon"])
        self.languages, self.transitions = model["languages"], model["transitions"]
        self.forget()

    def forget(self) -> None:
        self.where: dict[str, int] = {}
        self.rows = np.empty((1 << 12, len(self.languages)), np.float32)

    def _rows(self, units: np.ndarray, text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        at, which = distinct_spans(span_hashes(code_units(units), starts, ends), units, starts, ends)
        if len(self.where) + len(at) > MEMORY:
            self.forget()
        keys = [text[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        if new := [k for k in keys if k not in self.where]:
            scores = self.scores.of([k.lower() for k in new])[0]
            n = len(self.where)
            while n + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
            self.rows[n:n + len(new)] = scores
            self.where.update((k, n + i) for i, k in enumerate(new))
        return np.array([self.where[k] for k in keys], np.int64)[which]

    def label(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text: starts and ends of its words, and the marginals (words, languages)."""
        for _, held in blocks(texts):
            joined = "\n".join([*held, ""])
            units, starts, ends = word_spans(joined)
            stops = np.cumsum([len(t) + 1 for t in held])
            bounds = np.searchsorted(starts, np.concatenate([[0], stops]))
            if len(starts):
                rows = self._rows(units, joined, starts, ends)
                per = np.diff(bounds)
                n = -(-per // CHAIN)
                first = np.repeat(bounds[:-1], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * CHAIN
                lengths = np.minimum(CHAIN, np.repeat(bounds[1:], n) - first)
                chains = _chains(rows, first, lengths)
                inside = np.arange(chains.shape[1]) < lengths[:, None]
                found = marginals_only(self.rows[chains], lengths, self.transitions)[inside]
            else:
                found = np.empty((0, len(self.languages)))
            for k in range(len(held)):
                a, b = bounds[k], bounds[k + 1]
                shift = stops[k - 1] if k else 0
                yield starts[a:b] - shift, ends[a:b] - shift, found[a:b]


def marginals_only(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """The marginals of ``marginals``, without expected transitions."""
    longest = scores.shape[1]
    e = np.exp(scores - scores.max(axis=2, keepdims=True)).transpose(1, 0, 2).copy()
    step = np.exp(transitions - transitions.max()).astype(e.dtype)
    forward = np.empty_like(e)
    forward[0] = e[0]
    for t in range(1, longest):
        a = forward[t - 1] @ step * e[t]
        forward[t] = a / a.sum(axis=1, keepdims=True)
    b = np.ones_like(e[0])
    for t in range(longest - 2, -1, -1):
        b = (b * e[t + 1]) @ step.T
        b /= b.sum(axis=1, keepdims=True)
        b[t + 1 >= lengths] = 1.0
        forward[t] *= b
    out = forward.transpose(1, 0, 2)
    return out / out.sum(axis=2, keepdims=True)


# -- Spark

def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, per_language: int = 80, sample_chars: int = 20_000) -> dict | None:
    """Fit on at most ``per_language`` labelled documents of each language that are not held out."""
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()
                        & ~held_out(F.col("doc_id")))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = (usable.select("lang", "doc_id").withColumn("n", F.row_number().over(order))
              .where(F.col("n") <= per_language).select(F.col("lang").alias("l"), F.col("doc_id").alias("d")).distinct())
    rows = (usable.join(F.broadcast(picked), (F.col("lang") == F.col("l")) & (F.col("doc_id") == F.col("d")))
            .groupBy("lang", "doc_id").agg(F.min(F.substring("text", 1, sample_chars)).alias("text"))
            .orderBy("lang", "doc_id").collect())  # at most per_language rows a language
    return fit([(r["lang"], r["text"]) for r in rows])


def _identified(docs: DataFrame, model: dict | None, spans: bool, out: str) -> DataFrame:
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, certainty double, lang_spans array<struct<start:int,end:int,lang:string>>")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        labeller = labeller_of(model) if model else None
        for text in parts:
            rows = [(UNKNOWN, 0.0, 0.0, [] if spans else None)] * len(text)
            if labeller is not None:
                whole = ["" if t is None else t for t in text]
                for k, (starts, ends, found) in enumerate(labeller.label(whole)):
                    if len(found):
                        total = found.sum(axis=0, dtype=np.float64)
                        best = int(total.argmax())
                        runs = None
                        if spans:
                            labels = found.argmax(axis=1)
                            first = np.flatnonzero(np.diff(labels, prepend=-1))
                            last = np.append(first[1:], len(labels)) - 1
                            runs = [{"start": int(starts[a]), "end": int(ends[b]), "lang": labeller.languages[labels[a]]}
                                    for a, b in zip(first, last, strict=True)]
                        certainty = float(found.max(axis=1).mean(dtype=np.float64))
                        rows[k] = labeller.languages[best], min(1.0, float(total[best] / len(found))), certainty, runs
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "certainty", "lang_spans"])

    return docs.withColumn(out, predict("text"))


def identify(docs: DataFrame, model: dict | None, spans: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; with ``spans`` also ``lang_spans`` (runs of words
    of one language: start, end in code points, language). They replace columns of those names."""
    new = ["lang_pred", "score", *["lang_spans"] * spans]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    return _identified(docs, model, spans, "_language").select(*kept, *[F.col(f"_language.{c}") for c in new])


def keep_identified(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """``docs`` without those that have no words or whose words' labels are uncertain (the mean of
    each word's largest marginal is under ``least``), all columns kept. Where nothing is labelled
    no language can be judged, and all documents with letters stay."""
    model = learn(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = _identified(docs, model, False, "_language")
    return found.where((F.col("_language.lang_pred") != UNKNOWN) & (F.col("_language.certainty") >= least)).drop("_language")
