"""Toxicity: held-out accuracy, what is learned from, and empty inputs."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from tidelog.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, source string"
LABELS = "doc_id long, quality int, toxic int"


def corpus(seed=0, n=600):
    rng = random.Random(seed)
    plain = [a + b for a in ("ti", "on", "er", "ver", "que", "la") for b in ("st", "re", "an", "ou", "ly", "ed", "bo")]
    bad, stem = ["vilegrub", "snotrag", "dimwort"], "krak"
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randrange(3, 7)):
                words[rng.randrange(len(words))] = rng.choice(bad) if i % 2 else stem + rng.choice(plain)
        docs.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out(spark):
    docs, labels = corpus()
    docs = [*docs, (10_000, None, None, None), (10_001, "", "en", "s"), docs[0], (None, docs[5][1], "en", "s")]
    got = toxicity.contract(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(docs)
    truth = {i: t for i, _, t in labels}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if r["doc_id"] in truth and r["held_out"]:
            assert r["predicted"] == truth[r["doc_id"]]
        if r["doc_id"] in (10_000, 10_001):
            assert r["predicted"] == 0
    assert len({r["score"] for r in got if r["doc_id"] == 0}) == 1


def test_held_out_labels_and_other_columns_are_no_inputs(spark):
    docs, labels = corpus(1, 300)
    flipped = [(i, 1, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, _, t in labels]
    other = [(i, t, "xx", f"src{i}") for i, t, _, _ in docs]
    a = toxicity.contract(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS))
    b = toxicity.contract(spark.createDataFrame(other, SCHEMA), spark.createDataFrame(flipped, LABELS))
    assert sorted((r["doc_id"], round(r["score"], 9)) for r in a.collect()) == sorted((r["doc_id"], round(r["score"], 9)) for r in b.collect())


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 1, None)]])
def test_nothing_to_learn_from(spark, labels):
    docs, _ = corpus(2, 20)
    got = toxicity.contract(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == 20 and all(r["score"] == 0 for r in got)
    assert toxicity.contract(spark.createDataFrame([], SCHEMA), spark.createDataFrame(labels, LABELS)).count() == 0


def test_label_model_learns_accuracies_and_correlations():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    good = [np.where(rng.random(4000) < 0.9, y, ~y) for _ in range(3)]
    poor = np.where(rng.random(4000) < 0.6, y, ~y)
    v = np.stack([*good, poor, poor, poor, poor], axis=1).astype(np.int8) * 2 - 1  # one poor voter four times
    start = np.clip(v[:, :3].mean(axis=1) / 2 + 0.5, 0.1, 0.9)
    model = toxicity.fit_label_model(v, start)
    assert model.share[3] < 0.5 < model.share[0]
    assert abs(model.table[0, 2, 1] - 0.9) < 0.05
    assert ((model.posterior(v) > 0.5) == y).mean() > 0.95


def test_label_model_over_patterns_against_plain_loops(spark):
    """The sums over a table of patterns give the model that row-by-row formulas give."""
    rng = np.random.default_rng(1)
    y = rng.random(900) < 0.4
    v = np.stack([np.where(rng.random(900) < p, np.where(y, 1, -1), 0) * np.where(rng.random(900) < q, 1, -1) for p, q in ((0.9, 0.9), (0.5, 0.8), (0.7, 0.95))], axis=1).astype(np.int8)
    label = np.where(rng.random(900) < 0.5, y.astype(int), -1)
    many = np.minimum((v == 1).sum(axis=1), 4)
    rows = [(r.tobytes(), int(k), int(t), 1) for r, k, t in zip(v, many, label, strict=True)]
    table = spark.createDataFrame(rows, "votes binary, many int, toxic int, n long").groupBy("votes", "many", "toxic").count().withColumnRenamed("count", "n")
    got = toxicity.fit_over_patterns(table, 3)

    known = label >= 0
    share = [(label[known & (many == k)].sum() + 0.1) / ((known & (many == k)).sum() + 1) for k in range(5)]
    post = [min(0.98, max(0.02, float(t) if t >= 0 else share[k])) for t, k in zip(label.tolist(), many.tolist(), strict=True)]
    for _ in range(toxicity.ROUNDS):
        tab = np.full((3, 3, 2), 0.5)
        for row, p in zip(v, post, strict=True):
            for j in range(3):
                tab[j, row[j] + 1] += (1 - p, p)
        tab /= tab.sum(axis=1, keepdims=True)
        mean = [[tab[j, 2, c] - tab[j, 0, c] for c in (0, 1)] for j in range(3)]
        rest = np.array([[row[j] - (1 - p) * mean[j][0] - p * mean[j][1] for j in range(3)] for row, p in zip(v, post, strict=True)])
        cov = rest.T @ rest / 900
        corr = cov / np.sqrt(np.outer(np.diag(cov), np.diag(cov)))
        corr[np.abs(corr) < 0.1] = 0
        weight = [1 / (1 + sum(abs(corr[i, j]) for i in range(3) if i != j)) for j in range(3)]
        prior = float(np.clip(np.mean(post), 0.005, 0.9))
        new = []
        for row in v:
            odds = np.log(prior / (1 - prior)) + sum(weight[j] * np.log(tab[j, row[j] + 1, 1] / tab[j, row[j] + 1, 0]) for j in range(3))
            new.append(1 / (1 + np.exp(-odds)))
        change, post = max(abs(a - b) for a, b in zip(new, post, strict=True)), new
        if change < toxicity.SETTLED:
            break
    assert np.allclose(got.table, tab) and np.allclose(got.share, weight) and abs(got.prior - prior) < 1e-9
    assert np.allclose(got.posterior(v), post)


def test_a_text_of_megabytes_and_clashing_columns(spark):
    docs, labels = corpus(3, 200)
    rows = [(i, t, 1, "x") for i, t, _, _ in docs] + [(500, docs[1][1] + " on" * 1_200_000, 2, "y")]
    got = toxicity.contract(spark.createDataFrame(rows, "doc_id long, text string, toxic int, score string"), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == 201 and all(0 <= r["score"] <= 1 for r in got)
