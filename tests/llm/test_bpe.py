"""Ids by the per-prefix encoder against the published implementations."""

import base64
import random

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import DATA
from waymark.llm import bpe


@pytest.fixture(scope="module")
def enc():
    return bpe.Encoder()


@pytest.fixture(scope="module")
def published():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_documents(enc, published):
    for folder in (DATA, DATA.replace("0.001", "0.01")):
        texts = [t for t in pq.read_table(f"{folder}/documents.parquet", columns=["text"])["text"].to_pylist() if t]
        assert [enc.encode(t) for t in texts] == published(texts)
        assert [enc.count(t) for t in texts] == [len(enc.encode(t)) for t in texts]


def test_long_and_odd_texts(enc, published):
    rnd = random.Random(1)
    parts = ["a", "b", "e", "th", "in", " ", "the", "ing", "\n", "é", "ß", "日本", "1", "22", ".", "'s", "'", "--", "==", "​", "\x1c", "\x85", "²", "½", "٣", "́", "𝒳", "<|endoftext|>", "\xa0", "\r\n", "'ve", "'LL"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 50))) for _ in range(3000)]
    texts += ["a" * 20_000, "ab" * 9000, " " * 9000, "thein" * 4000, "=-" * 5000, "\n" * 3000 + "x", "é" * 4000]
    assert [enc.encode(t) for t in texts] == published(texts)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text(enc, published, text):
    got = enc.encode(text)
    assert got == published([text])[0]


def test_round_trip(enc):
    rank = {int(b): base64.b64decode(a) for a, b in map(bytes.split, open(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb"))}
    for t in ("Straße, 42 m² – año\t\n", "  two  blanks ", "naïve 日本語"):
        assert b"".join(rank[i] for i in enc.encode(t)).decode() == t


def test_kept_pieces_are_bounded(published, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 5)
    e = bpe.Encoder()
    texts = [f"word{i} and more" for i in range(50)]
    assert [e.encode(t) for t in texts] == published(texts) and len(e.pieces) <= 5


def test_table(spark):
    df = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, " ", 7), (None, "a b", 7)], "doc_id bigint, text string, ids int")
    got = {r.doc_id: r.ids for r in bpe.encode_documents(df).collect()}
    assert got[1] == [] and got[2] == [] and got[3] == [220] and len(got[None]) == 2
    assert bpe.encode_documents(df.limit(0)).count() == 0
