"""New chunks are encoded together and their ids placed together, not as one array for each chunk."""

import numpy as np
import public_tokenizers

from passlane.llm import tokenizing as T


def test_ids_of_new_chunks_are_placed_at_once(monkeypatch):
    c = T.Codec(public_tokenizers.path("byte_bpe_50k.json"), leaf_chars=64)
    chunks = ["First", " second", " \n", " third,", "x" * 200, " fünf", "\ttab", " last"]

    def refuse(*a, **k):
        raise AssertionError("an array for each chunk")

    with monkeypatch.context() as m:
        m.setattr(T.np, "split", refuse)
        ids, counts = c._new(chunks)
    found = np.split(ids, np.cumsum(counts)[:-1])
    assert [x.tolist() for x in found] == [c.tok.encode(x, add_special_tokens=False).ids for x in chunks]
    only = c._new(["A"])
    assert only[0].tolist() == c.tok.encode("A", add_special_tokens=False).ids and only[1].tolist() == [1]
