"""Token ids against the library's own encoder."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm.tokens import BYTE_BPE_50K, encoder, token_ids

tokenizers = pytest.importorskip("tokenizers")
pytestmark = pytest.mark.skipif(not os.path.exists(BYTE_BPE_50K), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(BYTE_BPE_50K.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


TEXTS = ["", " ", "\n\n  x", "hello world", "<|endoftext|> [CLS] <s>", "I'll can't WON'T it'S", "안녕하세요 세계", "a" * 5000, "é" * 300, "​﻿\u0000 z", "🙂🙃" * 50, "x" * 95 + "yz" * 400, "The  quick\tbrown\r\nfox 12345 $%^"]


def test_known_texts(library):
    for text in TEXTS:
        assert encoder(BYTE_BPE_50K).encode(text) == library(text), text[:30]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_any_text(library, text):
    if not any(0xD800 <= ord(c) < 0xE000 for c in text):
        assert encoder(BYTE_BPE_50K).encode(text) == library(text)


def test_both_merges_agree():
    rng, bpe = random.Random(6), encoder(BYTE_BPE_50K)
    for _ in range(400):
        word = bytes(rng.choice(b"abcdefghthing\xc3\xa9\xed\x95\x9c  ") for _ in range(rng.randrange(2, 250)))
        assert bpe.short(word) == bpe.long(word)


def test_rows(spark, library):
    rows = [(i, t, "x", [1]) for i, t in enumerate(TEXTS)] + [(99, None, "", None), (0, "", "", None), (None, "a b", "", None)]
    out = token_ids(spark.createDataFrame(rows, "doc_id bigint, text string, d string, ids array<int>"), "doc_id", "text")
    assert out.columns == ["doc_id", "ids"]
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["ids"]) for r in out.collect())
    assert got == sorted((i if i is not None else -1, library(t) if t else []) for i, t, *_ in rows)
    assert token_ids(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text").count() == 0
