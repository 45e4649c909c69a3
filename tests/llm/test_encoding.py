import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from recollect.llm.encoding import Encoder, cut_points

PATH = P.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)
ENC = Encoder(PATH)


def ids(x):
    return np.frombuffer(x, "<u4").tolist()


ODD = ["", " ", "I'm you'RE it's 'd", "a\x1cb c", "x<|endoftext|>y <|startoftext|> z", "İstanbul Σας ΣΑΣ", "é é ́x", "漢字 かな ١٢٣", "a b c᠎d​e", "12345 3.14...", "﻿abc", "ﬁne ﬀ", "a\u0085b"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert ids(next(ENC.encode([text]))) == LIB.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_any_text(texts):
    assert [ids(x) for x in ENC.encode(texts, 16)] == [LIB.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_text_is_cut_at_white_space():
    text = "Some words, and 'more' words. " * 3000 + "x" * 5000 + " end"
    assert "".join(cut_points(text, 1000)) == text and len(cut_points(text, 1000)) > 50
    assert ids(next(ENC.encode([text], 1000))) == LIB.encode(text, add_special_tokens=False).ids


def test_other_files():
    b = Encoder(P.path("byte_bpe_50k.json"))
    assert not b.wordwise and ids(next(b.encode(["Hello  world"]))) == Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode("Hello  world").ids
    s = Encoder(P.path("piece_bpe_32k.model"))
    assert len(ids(next(s.encode(["Hello world"])))) > 1 and zlib.crc32(b"") == 0
