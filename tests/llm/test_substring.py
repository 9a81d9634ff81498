"""Substring dedup against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest

from tidelog.llm.substring import contract, remove_duplicates

from .fixtures import SCHEMA, documents

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


def brute(rows):
    words = [WORDS(r[1] or "") for r in rows]
    seen = Counter(tuple(w[k : k + 35]) for w in words for k in range(len(w) - 34))
    out = []
    for r, w in zip(rows, words, strict=True):
        gone = {j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(2))
def test_same_as_brute_force(spark, seed):
    rows = documents(seed)
    got = sorted(map(tuple, contract(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 0


@pytest.mark.parametrize("hot", [0, 2])
def test_anchors_with_many_phrases_give_the_same(spark, monkeypatch, hot):
    from tidelog.llm import substring

    monkeypatch.setattr(substring, "HOT", hot)
    rows = documents(3)
    assert sorted(map(tuple, contract(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == brute(rows)


def test_a_passage_in_ever_new_surroundings(spark):
    """One anchor has a different phrase in each document; only the 36 words themselves go."""
    passage = " ".join(f"p{i}" for i in range(36))
    rows = [(i, " ".join(f"a{i}x{j}" for j in range(30)) + f" {passage} " + " ".join(f"z{i}x{j}" for j in range(30))) for i in range(60)]
    got = contract(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["n_removed"] for r in got} == {36}


def test_parse_of_a_block():
    """The longest matches and the duplicate windows of the greedy parse, against plain search."""
    import numpy as np

    from tidelog.llm.substring import WINDOW, Block

    rng = np.random.default_rng(2)
    base = rng.integers(1, 1 << 60, 400).astype(np.uint64)
    phrases, anchors = [], []
    for i in range(60):
        parts = []
        while sum(map(len, parts)) < WINDOW:
            a, n = int(rng.integers(0, 360)), int(rng.integers(3, 59))
            parts.append(base[a : a + n] if rng.random() < 0.8 else rng.integers(1, 1 << 60, n).astype(np.uint64))
        phrases.append(np.concatenate(parts)[:59])
        anchors.append(i % 3)
    block = Block(np.array(anchors), [p.tobytes() for p in phrases])
    words = [p.tolist() for p in phrases]

    def found(i, j, n):
        x = words[i][j : j + n]
        return any((k, m) != (i, j) and words[k][m : m + n] == x for k in range(60) if anchors[k] == anchors[i] for m in range(len(words[k]) - n + 1))

    at, twice = 0, block.duplicates()
    for i, w in enumerate(words):
        for j in range(len(w)):
            n = int(block.longest[at])
            assert (n == 0 or found(i, j, n)) and (j + n == len(w) or not found(i, j, n + 1))
            if j + WINDOW <= len(w):
                assert twice[at] == found(i, j, WINDOW)
            else:
                assert not twice[at]
            at += 1
    assert twice.any()


def test_very_long_text(spark):
    """Texts of over 2 MB, which exceed a slice, and copies inside one text."""
    long = " ".join(f"w{i}" for i in range(300_000))
    rows = [(1, long), (2, "x " + long + " y"), (None, " ".join(long.split()[:400])), (4, "a b c " * 20)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in contract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (300_000, 300_000), 2: (300_002, 300_000), None: (400, 400), 4: (60, 60)}


def test_texts_and_other_columns(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(1, f"  head\n{passage}\ntail ", 5, "a"), (2, passage, 6, "b"), (3, None, 7, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, spans string")
    got = {r["doc_id"]: r for r in remove_duplicates(df).collect()}
    assert got[1]["text"] == "  head\ntail " and got[2]["text"] == "" and got[3]["text"] is None
    assert got[1]["n_words"] == 42 and got[1]["n_removed"] == 40 and got[1]["spans"] == "a"


def test_empty(spark):
    assert contract(spark.createDataFrame([], SCHEMA)).count() == 0
