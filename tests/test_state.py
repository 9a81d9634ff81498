"""State rules on small command lists, against a sequential fold."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import limits, reads, storage, watch, writes
from tidelog.plans.state import log_state, mutation_log, resolve, snapshot

SCHEMA = "key string, shard int, ms long, seq long, op string, value string, meta string, exp_set long"


def make(spark, rows):
    return spark.createDataFrame([(k, 0, ms, i, op, v, None, exp) for i, (k, ms, op, v, exp) in enumerate(rows)], SCHEMA)


def fold(rows):
    """Live keys after the commands: key -> (value, expiry, ms of the put)."""
    state = {}
    for k, ms, op, v, exp in rows:
        live = k in state and (state[k][1] is None or state[k][1] > ms)
        if op in ("SET", "SETEX"):
            state[k] = (v, exp, ms)
        elif op == "DEL":
            state.pop(k, None)
        elif not live:
            state.pop(k, None)
        else:
            state[k] = (state[k][0], exp, state[k][2])
    return state


def random_rows(seed, n=400):
    rng = random.Random(seed)
    rows, ms = [], 1000
    for i in range(n):
        ms += rng.randrange(0, 9)
        op = rng.choice(["SET", "SETEX", "DEL", "EXPIRE", "PERSIST"])
        exp = ms + rng.randrange(1, 60) if op in ("SETEX", "EXPIRE") else None
        rows.append((f"k{rng.randrange(12)}", ms, op, f"v{i}" if op.startswith("SET") else None, exp))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_snapshot_is_the_fold(spark, seed):
    rows = random_rows(seed)
    as_of = rows[-1][1] + 5
    expected = {k: v[:2] for k, v in fold(rows).items() if v[1] is None or v[1] > as_of}
    got = snapshot(mutation_log(resolve(make(spark, rows))), as_of).collect()
    assert {r["key"]: (r["value"], r["expires_at_ms"]) for r in got} == expected


def test_expiry_is_inclusive_and_persist_keeps_a_dead_key_dead(spark):
    rows = [("a", 1, "SETEX", "x", 10), ("b", 1, "SETEX", "y", 10), ("b", 10, "PERSIST", None, None), ("c", 1, "SETEX", "z", 10), ("c", 9, "PERSIST", None, None)]
    log = mutation_log(resolve(make(spark, rows)))
    assert {r["key"] for r in snapshot(log, 9).collect()} == {"a", "b", "c"}
    assert {r["key"] for r in snapshot(log, 10).collect()} == {"c"}
    assert log_state(log, 10).count() == 3  # expired keys without a tombstone still count


def test_revisions_rise(spark):
    rows = [("a", 5, "SET", "1", None), ("b", 5, "SET", "2", None), ("a", 5, "DEL", None, None), ("c", 9, "DEL", None, None), ("a", 9, "SET", "3", None)]
    log = mutation_log(resolve(make(spark, rows))).orderBy("rev").collect()
    assert [(r["key"], r["kind"], r["rev"]) for r in log] == [("a", "PUT", 5), ("b", "PUT", 6), ("a", "DEL", 7), ("a", "PUT", 9)]


def test_full_put_replaces_expiry(spark):
    rows = [("a", 1, "SETEX", "x", 5), ("a", 2, "SET", "y", None)]
    got = snapshot(mutation_log(resolve(make(spark, rows))), 100).collect()
    assert [(r["key"], r["value"], r["expires_at_ms"]) for r in got] == [("a", "y", None)]


def test_exists_counts_repeats_and_delete_does_not(spark):
    snap = snapshot(mutation_log(resolve(make(spark, [("a", 1, "SET", "x", None)]))), 5)
    asked = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "pos long, key string")
    assert reads.exists_count(asked, snap).first()["n"] == 2
    assert writes.delete_count(asked, snap).first()["n"] == 1


def test_compare_and_swap_lets_one_through(spark):
    snap = snapshot(mutation_log(resolve(make(spark, [("a", 7, "SET", "x", None)]))), 8)
    tries = spark.createDataFrame([(0, "a", 6), (1, "a", 7), (2, "a", 7), (3, "b", 0)], "pos long, key string, expected_rev long")
    got = {r["pos"]: r["result"] for r in writes.compared(tries, snap).collect()}
    assert got == {0: "conflict", 1: "ok", 2: "conflict", 3: "nil"}


def test_keys_limit(spark):
    df = spark.createDataFrame([(f"k{i}",) for i in range(10)], "key string")
    assert reads.keys(df, "k*", limit=11).count() == 10
    with pytest.raises(Exception, match="more than 10"):
        reads.keys(df, "k*", limit=10).collect()


def test_full_page_gives_a_cursor(spark):
    df = spark.createDataFrame([(f"k{i}",) for i in range(4)], "key string")
    page = reads.page(df, None, 4)
    assert reads.next_cursor(page, 4).first()["cursor"] == "k3"
    assert reads.next_cursor(reads.page(df, "k3", 4), 4).first()["cursor"] is None


def test_intact_prefix_per_shard(spark):
    log = spark.createDataFrame([(0, 1, "a"), (0, 2, "bad"), (0, 3, "c"), (1, 1, "d")], "shard int, rev long, key string")
    assert {r["key"] for r in storage.intact(log, "key = 'bad'").collect()} == {"a", "d"}


def test_limits_reject_bad_parameters(spark):
    df = spark.createDataFrame([("a", 1, 1)], "key string, ms long, seq long")
    for fn in (lambda: limits.fixed_window(df, 0, 10), lambda: limits.sliding_window(df, 1, 0), lambda: limits.token_bucket(df, 0, 1.0), lambda: limits.token_bucket(df, 1, 0.0)):
        with pytest.raises(ValueError):
            fn()


def test_fixed_window_burst(spark):
    df = spark.createDataFrame([("a", 100 + i, i) for i in range(4)], "key string, ms long, seq long")
    rows = limits.fixed_window(df, 3, 1000).orderBy("seq").collect()
    assert [(r["allowed"], r["remaining"], r["retry_after_ms"]) for r in rows] == [(True, 2, None), (True, 1, None), (True, 0, None), (False, 0, 897)]


def test_token_bucket_refills(spark):
    df = spark.createDataFrame([("a", t, i) for i, t in enumerate([0, 0, 0, 999, 1000, 2500])], "key string, ms long, seq long")
    rows = limits.token_bucket(df, 2, 1.0).orderBy("seq").collect()
    assert [r["allowed"] for r in rows] == [True, True, False, False, True, True]


def test_empty_log(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert snapshot(mutation_log(resolve(empty)), 5).count() == 0


def test_nulls_in_values(spark):
    rows = [("a", 1, "SET", None, None)]
    got = snapshot(mutation_log(resolve(make(spark, rows))), 5).filter(F.col("value").isNull()).collect()
    assert [r["key"] for r in got] == ["a"]


def test_snapshot_wins_over_replay_in_any_order(spark):
    """Sorts that spill merge rows of equal keys in any order, as rows do that come from several machines."""
    rows = [(f"k{i}", 1000 + i, "SET", f"v{i}", None) for i in range(300)] + [(f"k{i}", 6000 + i, "EXPIRE", None, 19000 + i) for i in range(300)]
    log = mutation_log(resolve(make(spark, rows)))
    conf, name = spark._jvm.org.apache.spark.SparkEnv.get().conf(), "spark.shuffle.spill.numElementsForceSpillThreshold"
    before = conf.get(name, str(2**31 - 1))
    conf.set(name, "40")
    try:
        found = watch.from_snapshot(snapshot(log, 12000), log, 1100, "k").collect()
    finally:
        conf.set(name, before)
    assert sorted((r["key"], r["value"], r["expires_at_ms"]) for r in found) == sorted((f"k{i}", f"v{i}", 19000 + i) for i in range(300))
