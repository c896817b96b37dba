import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from passlane.llm import packing as P
from passlane.llm.wordbpe import WordBpe

PATH = "/opt/tokenizers/word_bpe_49k.json"


@pytest.fixture(scope="module")
def words():
    return WordBpe(PATH)


def test_word_ids_agree_with_the_library(words):
    r = random.Random(2)
    alphabet = ["a", "B", "The", " ", "  ", "\n", "'", "re", "'S", "'ll", "<|endoftext|>", "É", "é", "漢", "1", "23", "!",
                "\x1c", " ", "Σ", "İ", "😀", "ß", "́", "ŉ", "ſ", "K", "ǅ", "²", "½", "٣", "​", "_", "ａ", "\0"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(5000)]
    texts += [t.replace("</w>", " ") for t in list(words.tok.get_vocab())[::7]]
    for t, got in zip(texts, words.encode(texts), strict=True):
        assert got.tolist() == words.slow(t).tolist(), repr(t)


@pytest.mark.parametrize("lengths", [
    [random.Random(k).randint(1, 64) for k in range(3000)], [64] * 10, [33] * 7, [1], [], [20, 21, 22, 23] * 100])
def test_plan_places_every_piece_once(lengths):
    counts = Counter(lengths)
    plan = P.make_plan(counts, 64, groups=8)
    taken, fill, spots = defaultdict(list), Counter(), defaultdict(list)
    for length, a, b, first, per, offset in plan.rows:
        taken[length] += range(a, b)
        for k in range(b - a):
            s = first + k // per
            fill[s] += length
            spots[s].append((offset + k % per * length, length))
    assert {x: sorted(r) for x, r in taken.items()} == {x: list(range(n)) for x, n in counts.items() if n}
    assert all(v <= 64 for v in fill.values()) and len(fill) == plan.sequences
    for parts in spots.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length


def test_few_sequences():
    r = random.Random(1)
    lengths = [min(2048, max(1, int(r.lognormvariate(6.5, 1)))) for _ in range(20_000)]
    assert P.make_plan(Counter(lengths), 2048, groups=48).sequences <= 1.015 * -(-sum(lengths) // 2048)


def test_documents(words, docs, clashing, no_docs):
    want = []
    for r in docs.collect():
        ids = np.append(words.slow(r.text or "") if r.text else np.empty(0, np.uint32), 0).astype("<u4")
        want += [(str(r.doc_id), k, k * 128, len(ids[k * 128:(k + 1) * 128]), zlib.crc32(ids[k * 128:(k + 1) * 128].tobytes()))
                 for k in range(-(-len(ids) // 128))]
    for frame in (docs, clashing):
        rows = P.pack_documents(frame, PATH, capacity=128, groups=8).collect()
        assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
        sequences = defaultdict(list)
        for r in rows:
            sequences[r.sequence_id].append((r.offset, r.length))
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 128
    assert P.pack_documents(no_docs, PATH).count() == 0
