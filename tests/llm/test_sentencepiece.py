"""Encoding and decoding against the library."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm.sentencepiece_codec import Codec, decode, digests, encode

PATH = P.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
HARD = ["", " ", "   ", "▁", "▁▁ a", "\n", " \n ", "a" * 3000, " " * 1500 + "b", "\x00a", "<s> </s><0x41>", "🙂漢字", "  lead", "trail  ", "é" * 700, "tab\there", "ab" * 600 + " cd"]


@pytest.fixture(scope="module")
def codec():
    return Codec(PATH)


def ids(raw):
    return np.frombuffer(raw, "<i4").tolist()


def test_hard_texts(codec):
    assert [ids(x) for x in codec.encode(HARD)] == [LIBRARY.encode(t) + [2] for t in HARD]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdeinoprst ABÉñ漢🙂▁\n\t'<>0x41", max_size=60))
def test_random_texts(text):
    codec = test_random_texts.codec = getattr(test_random_texts, "codec", None) or Codec(PATH)
    raw = codec.encode([text], end=False)[0]
    assert ids(raw) == LIBRARY.encode(text)
    assert codec.decode_texts(np.array(ids(raw), np.int64), np.array([len(raw) // 4])) == [LIBRARY.decode(ids(raw))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 700), max_size=12))
def test_random_ids_decode(numbers):
    codec = test_random_ids_decode.codec = getattr(test_random_ids_decode, "codec", None) or Codec(PATH)
    assert codec.decode_texts(np.array(numbers, np.int64), np.array([len(numbers)])) == [LIBRARY.decode(numbers)]


def test_operator(spark):
    texts = [*HARD, None, "a b", "a b"]
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(texts)], "doc_id long, text string, ids string, decoded int")
    rows = decode(encode(df, PATH), PATH).orderBy("doc_id").collect()
    for t, r in zip(texts, rows, strict=True):
        expected = LIBRARY.encode(t or "") + [2]
        assert r["ids"] == expected and r["decoded"] == LIBRARY.decode(expected)
    made = {r["doc_id"]: r for r in digests(df, PATH).collect()}
    for i, t in enumerate(texts):
        expected = LIBRARY.encode(t or "") + [2]
        assert made[i]["n_tokens"] == len(expected)
        assert made[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, expected)).encode()).hexdigest()
        assert made[i]["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(expected).encode()).hexdigest()
    assert digests(df.limit(0), PATH).count() == 0


def test_words_of_any_length(codec):
    """Runs, periods and random letters far longer than any piece; texts of over 2 MB."""
    rng = np.random.default_rng(4)
    letters = lambda alphabet, n: "".join(rng.choice(list(alphabet), n))
    texts = ["a" * 100_001, "ab" * 50_000, "aab" * 30_000, letters("ab", 60_000), letters("etaoinshrdlu", 80_000), letters("ABCDEFGHIJKLMNOPqrstuvwxyz0123456789+/", 80_000), "the quick brown fox\n" * 120_000]
    assert [ids(x) for x in codec.encode(texts)] == [LIBRARY.encode(t) + [2] for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aber", min_size=1, max_size=400))
def test_few_letters(text):
    codec = test_random_texts.codec = getattr(test_random_texts, "codec", None) or Codec(PATH)
    assert ids(codec.encode([text], end=False)[0]) == LIBRARY.encode(text)
