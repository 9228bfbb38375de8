"""Pieces that the library encodes together have the tokens that they have alone."""

import random

from vanewright.llm import pieces
from vanewright.llm.bpe import vocabulary_path


def test_joined_pieces_have_their_own_tokens(monkeypatch):
    rng, asked = random.Random(3), []
    ends = ["'s", "'", "ll", "12", "!?", "it's", "x1", "<|endoftext", "|>", "été", "日本", "naïve.", "'re", "​", "a b"]
    made = list({f"{gap}{rng.choice(ends)}{''.join(rng.choice('abcxyz01') for _ in range(rng.randint(0, 4)))}{rng.choice(ends)}".encode() for _ in range(4000) for gap in [rng.choice([" ", "  ", "\n", "\t ", "\r\n\n", "", " \n "])]})
    encoder = pieces.PieceEncoder(vocabulary_path("byte_bpe_50k.json"))
    want = dict(zip(made, encoder.by_library(made)))
    plain = encoder.by_library
    monkeypatch.setattr(encoder, "by_library", lambda texts: asked.append(len(texts)) or plain(texts))
    assert encoder.tokens_of(made) == [want[p] for p in made]
    joined = sum(p[:1].isspace() and p[-1] < 127 for p in made)
    assert sum(asked) < len(made) - joined // 2
