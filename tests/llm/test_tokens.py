import random
import sys

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillgraph.llm import tokens

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ODD = ["", " ", "a", " a", "a ", "a  b", "a\nb", "a\n\nb", "a \n b", "a\tb", "don't WE'LL x's '' 're'", "é é İstanbul ΣΣ", "123 45,6!! ***", "<|endoftext|> x", "a <|endoftext|> b<|startoftext|>"]
ODD += ["a\xa0b\xadc", "x\x1cy\x85", "日本語 テスト", "a" * 5000, "\U0001f600 ok", None, "ü\nß Ω", "Ⅷ x² ½", "\u0301a", "a \u0301b", " " * 3000 + "x", "b " * 900 + "a" * 1500, "Ɓ Ⱥ ǅ ŉ"]


@pytest.mark.parametrize("name", FILES)
def test_equals_a_fresh_library(name):
    enc, library = tokens.Encoder(name), Tokenizer.from_file(public_tokenizers.path(name))
    rnd = random.Random(3)
    letters = "abcde fghij. \n XYZ é'1 !*\tЖ中"
    texts = ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randrange(80))) for _ in range(2000)]
    texts += ["".join(chr(rnd.randrange(32, 0x3000)) for _ in range(30)) for _ in range(500)]
    got = [np.frombuffer(x, dtype="<u4").tolist() for x in enc.encode(texts)]
    for t, g, e in zip(texts, got, library.encode_batch([t or "" for t in texts], add_special_tokens=False), strict=True):
        assert g == e.ids, t


@pytest.mark.parametrize("name", FILES)
def test_every_character(name):
    enc = tokens.Encoder(name)
    texts = [f"a{c}b {c}{c} 1{c}'s Z{c}, {c}9 it'll{c} don't. '{c}'re" for c in map(chr, range(32, sys.maxunicode + 1, 7)) if c.isprintable()]
    fast = [enc._one(t) for t in texts]
    for t, f, w in zip(texts, fast, enc.whole(texts), strict=True):
        assert f is None or f == w, t
    assert sum(f is None for f in fast) < len(texts) / 50


@pytest.mark.parametrize("name", FILES)
def test_vocabulary_encodes_to_itself(name):
    assert tokens.Encoder(name).unreachable() == []


def test_long_stretches():
    n = tokens.LONGEST
    assert not tokens._long("a" * n) and tokens._long("a" * (n + 1)) and tokens._long(("b " * n) + "a" * (n + 1) + " c")
    assert not tokens._long(("a" * (n - 1) + " ") * 20)


def test_a_difference_raises(monkeypatch):
    enc = tokens.Encoder(FILES[0])
    monkeypatch.setattr(enc, "_fast", lambda t: b"\0\0\0\0")
    with pytest.raises(ValueError):
        enc.encode(["some text"])
