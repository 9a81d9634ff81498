"""Forest search: exact scores and order, recall, routing, and odd vectors."""

from __future__ import annotations

import heapq

import numpy as np
import pytest

from tidelog.llm.forest_search import Forest, contract, search

SCHEMA = "vec_id long, embedding array<float>"


def best(rows, query, own, k=20):
    x = np.array([v for _, v in rows], np.float64)
    ids = np.array([i for i, _ in rows])
    score = x @ query
    score[ids == own] = -np.inf
    return ids[np.lexsort((ids, -score))[:k]].tolist()


def vectors(n, d, seed=0, copies=0, groups=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)).astype(np.float32)
    if groups:
        x = 0.5 * x + rng.standard_normal((groups, d)).astype(np.float32)[rng.integers(0, groups, n)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:copies] = x[0]
    return [(i, v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize(
    ("n", "d", "groups", "options"),
    [
        (3000, 64, 0, {"rerank": 400, "leaves": 400}),  # one segment, random vectors: the hardest
        (9000, 32, 0, {"rerank": 700}),
        (4000, 64, 0, {"segment_size": 1000, "rerank": 300}),  # all segments probed
        (8000, 32, 200, {"segment_size": 300, "probes": 12, "rerank": 120}),  # 12 of 32 segments, vectors in groups
    ],
)
def test_recall(spark, n, d, groups, options):
    rows = vectors(n, d, groups=groups)
    df = spark.createDataFrame(rows, SCHEMA)
    got = search(df, df.filter("vec_id % 20 = 0"), **options).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(by) == {i for i, _ in rows if i % 20 == 0}
    hits = []
    for q, ranks in by.items():
        assert sorted(ranks) == list(range(1, 21))
        v = np.array(rows[q][1], np.float64)
        order = [(-s, i) for _, (i, s) in sorted(ranks.items())]
        assert order == sorted(order) and q not in [i for i, _ in ranks.values()]
        assert all(abs(s - float(np.dot(v, np.array(rows[i][1], np.float64)))) < 1e-12 for i, s in ranks.values())
        hits.append(len(set(best(rows, v, q)) & {i for i, _ in ranks.values()}) / 20)
    assert np.mean(hits) >= 0.9


def test_reranked_share_falls_with_the_size():
    """At the default settings, on random vectors, recall is held while the share that is reranked falls."""
    shares = []
    for n in (6000, 20_000):
        x = np.array([v for _, v in vectors(n, 64, seed=n)])
        forest = Forest(x, seed=1)
        q = x[:: n // 60]
        hits = []
        for v, c in zip(q, forest.candidates(q, n), strict=True):
            true = np.argsort(-(x @ v))[:21]
            hits.append(np.isin(true, c).mean())
        shares.append(len(c) / n)
        assert np.mean(hits) >= 0.9
    assert shares[1] < shares[0] / 3


def test_longest_inner_product_of_unequal_lengths(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 24)) * np.exp(rng.standard_normal((3000, 1)))
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    df = spark.createDataFrame(rows, SCHEMA)
    got = search(df, df.filter("vec_id % 20 = 0"), rerank=600).groupBy("query_id").agg({"vec_id": "collect_set"}).collect()
    assert np.mean([len(set(best(rows, np.array(rows[r[0]][1]), r[0])) & set(r[1])) / 20 for r in got]) >= 0.9


def test_copies_tie_to_smaller_ids(spark):
    rows = vectors(400, 8, copies=150)
    got = contract(spark.createDataFrame(rows, SCHEMA)).filter("query_id = 40").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(20))


def test_a_segment_of_most_vectors_is_split(spark):
    """Two thirds of the vectors in one direction land in few segments, whose parts are all searched."""
    rows = vectors(3000, 16)
    for i in range(2000):
        rows[i] = (i, (np.array(rows[0][1]) + 1e-3 * np.array(rows[i][1])).tolist())
    df = spark.createDataFrame(rows, SCHEMA)
    got = search(df, df.filter("vec_id % 500 = 0"), segment_size=150, probes=32).groupBy("query_id").agg({"vec_id": "collect_set"}).collect()
    assert len(got) == 6
    assert np.mean([len(set(best(rows, np.array(rows[r[0]][1]), r[0])) & set(r[1])) / 20 for r in got]) >= 0.9


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (5, None), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (40, [2.0, 1.0]), (None, [1.0, 1.0]), (10, [float("inf"), 1.0]), (60, []), (80, [1.0, 1.0, 1.0])]
    got = sorted(map(tuple, contract(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == [(0, 1, 40, 2.0), (0, 2, 3, 1.0), (0, 3, 20, 1.0), (20, 1, 40, 2.0), (20, 2, 0, 1.0), (20, 3, 3, 1.0), (40, 1, 0, 2.0), (40, 2, 3, 2.0), (40, 3, 20, 2.0), (80, 1, 9, 6.0)]
    assert contract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_clashing_columns(spark):
    rows = [(i, v, 7, "x") for i, v in vectors(60, 4)]
    df = spark.createDataFrame(rows, f"{SCHEMA}, rank int, score string")
    plain = contract(df.select("vec_id", "embedding")).collect()
    assert sorted(contract(df).collect()) == sorted(plain)


def test_leaves_come_in_the_order_of_a_shared_queue():
    x = np.random.default_rng(3).standard_normal((500, 6))
    forest = Forest(x, seed=1, trees=4, leaf=20)
    q = x[:1]
    at = forest._projected(q)[0]
    queue = [(0.0, 0, t, 0) for t in range(4)]
    popped = []
    while queue:
        cost, level, t, node = heapq.heappop(queue)
        if level == forest.depth:
            popped.append(cost)
            continue
        apart = float(at[t, level] - forest.splits[level][t, node])
        for child, more in ((0, max(apart, 0)), (1, min(apart, 0))):
            heapq.heappush(queue, (cost + more**2, level + 1, t, 2 * node + child))
    for many in (5, 17, 40):
        assert np.allclose(np.sort(forest.first_leaves(q, many)[1][0]), popped[:many], atol=1e-4)
