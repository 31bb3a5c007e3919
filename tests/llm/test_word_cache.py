"""The word table of the packing stage: bounded memory, and the whole tokenizer's ids whatever it forgets."""

from __future__ import annotations

import tracemalloc
from itertools import islice, product

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from terrapanel.llm import packing

LETTERS = "abcdefghijklmnop"


def texts(n, per_text=1000):
    """``n`` different words, so many a text."""
    words = map("".join, product(LETTERS, repeat=5))
    while part := list(islice(words, min(n, per_text))):
        n -= len(part)
        yield " ".join(part)


def test_known_words_take_bounded_memory():
    ids = packing.WordIds(public_tokenizers.path(packing.VOCABULARY))
    tracemalloc.start()
    try:
        for t in texts(600_000):
            for _ in ids([t]):
                pass
        held, _ = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert held < 90e6, f"{held / 1e6:.0f} MB"


def test_forgotten_words_get_the_same_ids(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 40)
    path = public_tokenizers.path(packing.VOCABULARY)
    ids, whole = packing.WordIds(path), Tokenizer.from_file(path)
    odd = ["It's don't we'll", "x1y22 a.b,c ..'' 'S", "été Ünï 漢字  x", "<|endoftext|> a<|b", "q" * 90 + " end", "", "a\x1cb \x1f", "the The THE the."]
    odd += [f"{a}{c}{b}" for c in map(chr, range(0xA0, 0x180)) for a, b in (("", ""), ("ab", "'s"), ("'", "."), ("É9", "e\u0301 x"))]
    rows = [w for pair in zip(texts(20 * len(odd), 20), odd, strict=True) for w in pair] + odd
    got = list(ids(rows))
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in got] == [whole.encode(t, add_special_tokens=False).ids for t in rows]
    assert all(len(w) <= packing.CACHED_LENGTH for w in ids.known)
