from __future__ import annotations

import random
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexitab.llm import _encoder
from lexitab.llm._encoder import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("plain", [False, True])
def test_equals_the_library(plain, monkeypatch):
    """Also with so little memory that generations change all the time."""
    own, rnd = Tokenizer.from_file(PATH), random.Random(2)
    own.encode_special_tokens = plain
    pools = [range(32, 127), range(97, 123), range(0x00, 0x21), range(0x7F, 0x250), range(0x370, 0x530), range(0x2000, 0x2070), range(0x4E00, 0x4F00), [32, 32, 10, 9, 39, 0x85, 0xA0, 0x1C, 0xB2, 0xBD], [ord(c) for c in "'sdtmlrve "]]
    texts = ["".join(chr(rnd.choice(rnd.choice(rnd.choice([pools, pools[:4]])))) for _ in range(rnd.randrange(70))) for _ in range(3000)]
    texts += ["<|endoftext|>", "a <|endoftext|> b", "", " ", "x" * 5000, "it's we'll I'd ' s", "é" * 300, "İi ǅ ʰ ª º"]
    want = [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]
    for remembered in (250_000, 7):
        monkeypatch.setattr(_encoder, "REMEMBERED", remembered)
        found = Encoder(PATH, plain)
        assert found.cuts and found.dtype == np.uint16
        assert [np.frombuffer(found.encode(t), found.dtype).tolist() for t in texts] == want


def test_settled_characters_one_by_one():
    """Every settled character between letters, digits and spaces is cut as the library cuts it."""
    own, found = Tokenizer.from_file(PATH), Encoder(PATH, False)
    points = [p for low, high in _encoder._SETTLED for p in range(low, high + 1)]
    assert all(unicodedata.category(chr(p)) != "Cn" for p in points)
    for p in points:
        text = f"a{chr(p)}b 1{chr(p)}2 {chr(p)} {chr(p)}{chr(p)}x'{chr(p)}"
        assert np.frombuffer(found.encode(text), found.dtype).tolist() == own.encode(text, add_special_tokens=False).ids


def test_other_kinds_go_to_the_library_whole():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, found = Tokenizer.from_file(path), Encoder(path, False)
    assert not found.cuts
    assert np.frombuffer(found.encode("Some Words"), found.dtype).tolist() == own.encode("Some Words", add_special_tokens=False).ids
