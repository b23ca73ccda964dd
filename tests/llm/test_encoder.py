"""The token files' encoder: remembered pieces, however few, give the ids of whole texts; new pieces go to the tokenizer in few calls."""

import random

import numpy as np
import pytest
from docloom.llm import tokenfiles
from docloom.llm.queries import vocabulary

ODD = ["", " ", "\n \n x", "a  b   c", "<|endoftext|>", "x<|endoftext|> y", "<|endoftext", "<|endoftext|", "|>", "control \x1c b", "K 🙂 naïve ſtraße　z", " ", "don't  stop\r\n\r\n1234,5"]


def texts(rnd, n):
    return ODD + ["".join(rnd.choice([" ", "  ", "\n", "a", "Wort", "<", "|>", "<|end", "é", "7", ".", "🙂", "\t", f"x{rnd.randrange(300)}"]) for _ in range(rnd.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("memo", [0, 40, 700_000])
def test_ids_are_those_of_whole_texts(memo):
    enc, rnd = tokenfiles.Encoder(vocabulary(), memo), random.Random(memo)
    for _ in range(6):
        some = texts(rnd, 150)
        expected = [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in some]
        assert [np.frombuffer(b, enc.dtype).tolist() for b in enc(some)] == expected


class Counted:
    def __init__(self, tokenizer):
        self.tokenizer, self.calls = tokenizer, []

    def encode_batch_fast(self, some, **more):
        self.calls.append(list(some))
        return self.tokenizer.encode_batch_fast(some, **more)


def test_new_pieces_go_together_and_frequent_ones_stay():
    enc = tokenfiles.Encoder(vocabulary(), 2000)
    enc.tokenizer = counted = Counted(enc.tokenizer)
    for k in range(20):
        enc([f"start{i} often again" for i in range(k * 200, k * 200 + 200)])
        assert len(enc.memo) + len(enc.older) <= 2000 + 2 * 202
    assert sum(map(len, counted.calls)) <= 2 * len(counted.calls) <= 60
    assert sum(" often" in t for c in counted.calls for t in c) == 1
