"""Findings of round 3: memory of the workers that encode."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
import tokenizers

from cinderpath.llm.token_output import ChunkEncoder


def test_encoder_holds_one_model(monkeypatch):
    """A worker reads the tokenizer's file once, and its exchanged steps leave the ids as the tokenizer's own."""
    path = public_tokenizers.path("word_bpe_49k.json")
    real = tokenizers.Tokenizer
    plain, read = real.from_file(path), []

    class Counted:
        @staticmethod
        def from_file(name):
            read.append(name)
            return real.from_file(name)

    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    encoder = ChunkEncoder(path, 2)
    assert len(read) == 1
    texts = ["Plain words, again: words!", "Ünïcode ΣΑΣ d'été 42nd", "", "x_y <b>z</b> naïve\tété.", "Plain Ünïcode again"]
    for _ in range(2):
        ids, n = encoder(pa.array(texts, pa.large_string()))
        want = [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in texts]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
