"""Packing: exact tokens, whole pieces, gapless sequences, and few of them."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidelog.llm.packing import WordTokens, make_plan, nnls, pack, patterns, pieces

from .fixtures import SCHEMA, documents

PATH = P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcABC é'stÉßñ \n\t\x85\xa0\x1c\x0b12²¼_-µ×<|>漢🙂Σσİſ", max_size=50))
def test_random_texts(text):
    words = test_random_texts.words = getattr(test_random_texts, "words", None) or WordTokens(PATH)
    assert np.frombuffer(words.encode([text])[0], "<u4").tolist() == library(text)


def test_special_tokens_in_a_text():
    text = "a <|startoftext|>b<|endoftext|> c"
    assert np.frombuffer(WordTokens(PATH).encode([text])[0], "<u4").tolist() == library(text)


def test_nnls_finds_an_exact_mixture():
    table = patterns(12)
    rng = np.random.default_rng(0)
    x = np.zeros(table.shape[1])
    x[rng.choice(len(x), 5, replace=False)] = rng.integers(1, 50, 5)
    found = nnls(table, table @ x)
    assert np.allclose(table @ found, table @ x, atol=1e-6) and found.min() >= 0


@pytest.mark.parametrize("seed", range(6))
def test_plans_place_everything_once(seed):
    rng = np.random.default_rng(seed)
    capacity = 256
    lengths = np.clip(rng.lognormal(rng.uniform(2, 5), rng.uniform(0.2, 1.2), 3000).astype(int), 1, capacity)
    lengths[: rng.integers(1, 1000)] = rng.integers(1, capacity + 1)  # a hot length
    counts = np.bincount(lengths, minlength=capacity + 1)
    plan = make_plan(counts, capacity, bins=32)
    assert (plan.used == counts).all()
    taken = {}
    for length, first, count, sequence, each, offset in plan.rows:
        for k in range(count):
            taken.setdefault(sequence + k // each, []).append((offset + k % each * length, length))
    assert len(taken) == plan.sequences
    for parts in taken.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert plan.sequences <= _best_fit(lengths, capacity)


def _best_fit(lengths, capacity):
    rooms = []
    for length in sorted(lengths.tolist(), reverse=True):
        fits = [r for r in rooms if r >= length]
        if fits:
            room = min(fits)
            rooms.remove(room)
        else:
            room = capacity
        rooms.append(room - length)
    return len(rooms)


@pytest.mark.parametrize("capacity", [64, 4096])
def test_operator(spark, capacity):
    rows = documents(2)
    df = spark.createDataFrame(rows, SCHEMA)
    got = pack(df, PATH, capacity=capacity).collect()
    expected = []
    for r in rows:
        ids = [*library(r[1] or ""), 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            expected.append((r[0], k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got), key=str) == sorted(expected, key=str)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


def test_ids_on_request_and_empty(spark):
    df = spark.createDataFrame([(1, "hello world")], "doc_id long, text string")
    assert pieces(df, PATH, with_ids=True).first()["ids"] == [*library("hello world"), 1]
    assert pack(df.limit(0), PATH).count() == 0


def test_kept_ids_are_bounded_in_bytes(monkeypatch):
    from tidelog.llm import packing

    monkeypatch.setattr(packing, "CACHE_BYTES", 4000)
    words = WordTokens(PATH)
    texts = [f"text {i} " + "word " * 300 for i in range(9)] + ["long " * 5000, None, ""]
    for _ in range(2):
        for t in texts:
            assert np.frombuffer(words.encode([t])[0], "<u4").tolist() == library(t or "")
            assert words.recent_bytes == sum(map(len, words.recent.values())) <= 4000
