import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pathloom.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.tiktoken"), reason="no vocabulary here")
DOCS = "doc_id long, text string, ids string"
ODD = ["", None, " ", "\n\n\n", "a\x1cb \x1d c", "it's we'll I'd", "naïve café", "été ", "已完成扫描", "👩‍🔬 x", "<|endoftext|>", "  \t x\r\n\r\n y", "x" * 5000, "0123456789" * 300, "a b　c d", "̈ combining", "﻿bom", "-" * 700]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.rank_file())


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_odd_texts(spark, public):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(ODD)] + [(0, "", "again")], DOCS)
    got = bpe.encode_corpus(df)
    assert got.count() == len(ODD) + 1
    by_id = {r.doc_id: list(r.ids) for r in got.collect()}
    assert by_id == {i: public(t) if t else [] for i, t in enumerate(ODD)}
    assert {r.doc_id: r.text for r in bpe.decode_corpus(got).collect()} == {i: t or "" for i, t in enumerate(ODD)}
    assert bpe.encode_corpus(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text_as_the_public_tokenizer(encoder, public, text):
    ids = encoder.encode(text)
    assert ids == public(text)
    assert encoder.decode(ids) == text


def test_memo_is_bounded(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_PIECES", 50)
    before = encoder.encode("alpha beta gamma delta " * 3)
    for i in range(300):
        encoder.encode(f"w{i}q z{i}")
    assert len(encoder.memo) <= 50
    assert encoder.encode("alpha beta gamma delta " * 3) == before
