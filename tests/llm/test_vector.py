import numpy as np
import pytest

from passlane.llm import language, minhash, vector
from passlane.llm.queries import TOKENIZERS
from passlane.llm.tokenizing import Codec
from passlane.llm.wordbpe import word_bpe


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[bin(k).count("1") % 2] for k in range(n))


PAIRS = [(thue_morse(n), thue_morse(n, "b", "a")) for n in (1024, 2048, 4096)]


@pytest.mark.parametrize("one,two", PAIRS)
def test_complementary_patterns_have_different_hashes(one, two):
    (a,), (b,) = vector.word_hashes([one, two])
    assert a != b
    got = [set(minhash.shingle_set(h, 3).tolist()) for h in vector.word_hashes([f"x {one} y", f"x {two} y"])]
    assert not got[0] & got[1]


def test_equal_spans_have_equal_hashes_anywhere():
    hashes = vector.word_hashes(["alpha beta alpha", "\n beta\talpha", "", "ALPHA"])
    assert hashes[0][0] == hashes[0][2] == hashes[1][1] == hashes[3][0] and hashes[0][1] == hashes[1][0]
    assert len(hashes[2]) == 0


def encoders():
    byte, word = Codec(f"{TOKENIZERS}/byte_bpe_50k.json"), word_bpe(f"{TOKENIZERS}/word_bpe_49k.json")
    return [(lambda ts: [np.frombuffer(x, "<u4").tolist() for x in byte.encode_all(ts)], byte.tok),
            (lambda ts: [x.tolist() for x in word.encode(ts)], word.tok)]


@pytest.mark.parametrize("every_hash_alike", [False, True])
def test_ids_never_hang_on_a_hash(monkeypatch, every_hash_alike):
    if every_hash_alike:
        monkeypatch.setattr(vector, "span_hashes", lambda units, starts, ends: np.zeros(len(starts), np.uint64))
    texts = [x for pair in PAIRS for x in pair] + [" ".join(PAIRS[0]), "the cat sat on the mat, the mat", "cat", "dog", "", "tac"]
    for encode, tok in encoders():
        want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
        assert encode(texts) == want and encode(texts[::-1]) == want[::-1]


def test_word_scores_never_hang_on_a_hash(monkeypatch, spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de")] * 3,
                                 "doc_id long, text string, lang string")
    docs = docs.selectExpr("row_number() over (order by lang) as doc_id", "text", "lang")
    model = language.learn(docs)
    texts = ["the cat", "der Hund und", "dog " * 5]
    want = [[x.tolist() for x in parts] for parts in language.Labeller(model).label(texts)]
    monkeypatch.setattr(language, "span_hashes", lambda units, starts, ends: np.zeros(len(starts), np.uint64))
    assert [[x.tolist() for x in parts] for parts in language.Labeller(model).label(texts)] == want


def test_no_spans():
    none = np.empty(0, np.int64)
    at, which = vector.distinct_spans(np.empty(0, np.uint64), np.empty(0, np.uint32), none, none)
    assert len(at) == len(which) == 0
