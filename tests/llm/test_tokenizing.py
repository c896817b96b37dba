import random

import numpy as np
import pytest

from passlane.llm import tokenizing as T

PATH = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_trees_agree_with_the_library(tok):
    small, r = T.Codec(PATH, leaf_chars=8), random.Random(5)
    alphabet = ["a", "the", " ", "  ", "\n", "'", "re", "'s", "<|", "endoftext", "|>", "<|endoftext|>", "é", "漢", "12",
                "!", "\x1c", " ", "aaaa", "ſ", "²", "​", " \n"]
    for _ in range(3000):
        s = "".join(r.choice(alphabet) for _ in range(r.randint(0, 50)))
        want = tok.encode(s, add_special_tokens=False).ids
        assert ids(small.encode(s)) == want
        if s:
            assert small.tree(s).ids.tolist() == want
        assert small.decode(small.encode(s)) == tok.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 5000, "漢字" * 3000, "ab" * 4000 + "c", "!?" * 2000, " " * 3000, "\n " * 900 + "x"])
def test_long_unsplit_texts(tok, text):
    assert T.Codec(PATH).tree(text).ids.tolist() == tok.encode(text, add_special_tokens=False).ids


def test_decoding_skips_unknown_ids():
    c = T.Codec(PATH)
    assert c.decode(np.array([60000, 64, 4_000_000_000], "<u4").tobytes()) == "a"


def test_documents(tok, docs, clashing, no_docs):
    want = sorted((str(r.doc_id), tok.encode(r.text or "", add_special_tokens=False).ids, r.text or "") for r in docs.collect())
    for frame in (docs, clashing):
        done = T.decode_documents(T.encode_documents(frame, PATH, spread_chars=5000), PATH)
        assert sorted((str(r.doc_id), ids(r.ids), r.decoded) for r in done.collect()) == want
    assert T.decode_documents(T.encode_documents(no_docs, PATH), PATH).count() == 0
