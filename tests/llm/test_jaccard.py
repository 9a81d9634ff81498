"""Jaccard components against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tidelog.llm import components as components_module
from tidelog.llm import jaccard
from tidelog.llm.components import components

from .fixtures import SCHEMA, documents

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


def shingles(text):
    w = WORDS(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(s), least.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))), key=str)


@pytest.mark.parametrize("seed", range(2))
def test_same_as_brute_force(spark, seed):
    rows = documents(seed, families=25)
    got = sorted(map(tuple, jaccard.join(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == brute(rows)


def test_border_of_the_threshold_and_chains(spark):
    rng = random.Random(5)
    rows, n = [], 0
    for size in (3, 4, 7, 8, 12, 40, 100, 300):
        base = [f"b{size}_{i}" for i in range(size + 4)]
        for cut in range(0, 2 + size // 3, max(1, size // 40)):  # prefixes: sets inside sets, around the threshold
            rows.append((n, " ".join(base[: len(base) - cut]), "en", "s", 0))
            n += 1
        for _ in range(6):  # common passages, not enough to link
            rows.append((n, " ".join(base[: size // 2 + 4] + [f"o{rng.random()}" for _ in range(size)]), "en", "s", 0))
            n += 1
    got = sorted(map(tuple, jaccard.join(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == brute(rows)


def test_linked_sets_always_share_a_key():
    rng = np.random.default_rng(1)
    for n in [*range(3, 40), 80, 200, 243, 300, 729, 1000]:
        base = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for _ in range(8):
            a = base[rng.random(len(base)) > rng.random() * 0.13]
            b = np.unique(np.concatenate([base[rng.random(len(base)) > rng.random() * 0.13], rng.integers(0, 2**63, int(len(base) * rng.random() * 0.13)).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(a) and len(b) and len(a) != both and 100 * both >= 75 * (len(a) + len(b) - both):
                common, _ = jaccard.keys_of([base], np.zeros(0, np.uint64))
                for order in (np.zeros(0, np.uint64), np.sort(common)):
                    keys, owner = jaccard.keys_of([a, b], order)
                    assert np.intersect1d(keys[owner == 0], keys[owner == 1]).size
                assert jaccard._may_link(len(a), len(b), jaccard.parity(a), jaccard.parity(b))


def test_keep_one(spark):
    rows = documents(1)
    df = spark.createDataFrame(rows, SCHEMA)
    kept = jaccard.keep_one(df).collect()
    linked = brute(rows)
    with_words = {c for _, n, c in linked if n}
    ids = sorted(r["doc_id"] for r in kept if shingles(r["text"]) and r["doc_id"] is not None)
    assert ids == sorted(c for c in with_words if c is not None) or set(ids) == {c for c in with_words if c is not None}
    assert sum(1 for r in kept if not shingles(r["text"])) == sum(1 for r in rows if not shingles(r[1]))
    assert len([r for r in kept if shingles(r["text"])]) == len({(find, c) for find, c in _component_names(rows)})


def _component_names(rows):
    """Names of the components, also of those without an id."""
    named = set()
    for i, r in enumerate(rows):
        s = shingles(r[1])
        if s:
            reach, todo = {i}, [i]
            while todo:
                k = todo.pop()
                for j, o in enumerate(rows):
                    t = shingles(o[1])
                    if j not in reach and t:
                        a = shingles(rows[k][1])
                        both = len(a & t)
                        if both and 100 * both >= 75 * (len(a) + len(t) - both):
                            reach.add(j)
                            todo.append(j)
            named.add((min(reach), 0))
    return named


def test_nothing_in_common(spark):
    rows = [(i, " ".join(f"t{i}_{j}" for j in range(n)), "en", "s", 0) for i, n in enumerate((1, 3, 8, 30, 200))] + [(9, None, None, None, None)]
    got = sorted(map(tuple, jaccard.join(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == brute(rows)
    assert jaccard.keep_one(spark.createDataFrame(rows[-1:], SCHEMA)).count() == 1


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert jaccard.join(df).count() == 0 and jaccard.keep_one(df).count() == 0


@pytest.mark.parametrize("few", [0, 10_000])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components_module, "FEW_LINKS", few)
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_near_copies_without_ids_link(spark):
    rng = random.Random(9)
    words = [f"n{rng.random()}" for _ in range(104)]
    text = lambda a, b: " ".join(words[a:b])
    rows = [(7, text(0, 84), "en", "s", 0), (None, text(9, 93), "en", "s", 0), (3, text(18, 102), "en", "s", 0)]  # only the row without an id links the others
    rows += [(None, text(9, 93), "en", "s", 0)] * 3
    other = [f"o{rng.random()}" for _ in range(60)]
    rows += [(None, " ".join(other[k:]), "en", "s", 0) for k in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, jaccard.join(df).collect()), key=str) == brute(rows)
    kept = jaccard.keep_one(df).collect()
    assert len(kept) == 2 and sorted(str(r["doc_id"]) for r in kept) == ["3", "None"]


def test_hot_symbols_large_units_and_equal_names(spark, monkeypatch):
    """A third of the rows are different near copies of one text, others share a long passage only; first hashes have 5 bits; one text has megabytes."""
    monkeypatch.setattr(jaccard, "HOT", 3)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(50):
        words = list(base)
        for _ in range(rng.randrange(0, 7)):
            words[rng.randrange(len(words))] = f"x{rng.random()}"
        rows.append((i, " ".join(words), "en", "s", 0))
    for i in range(50, 100):
        rows.append((i, " ".join(base[:75] + [f"y{i % 9}_{j}" for j in range(60)] + [f"z{i}"] * (i % 4)), "en", "s", 0))
    rows += [(i, f"only {i} of its own kind here", "en", "s", 0) for i in range(100, 110)] + [(110, None, None, None, None), (111, "", "", "", 0)]
    rows.append((112, "many words in one text " * 100_000, "en", "s", 0))
    got = sorted(map(tuple, jaccard.join(spark.createDataFrame(rows, SCHEMA), bits=5).collect()), key=str)
    assert got == brute(rows)
