"""Flag evaluation: odd contexts, hashes in parts, and plans that deal the contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions import scalars
from tidelog.operators import flags

ENTRIES = [
    ("flags:def:a", '{"on": true, "rules": [{"when": {"seg": ["x", "y"], "id": "u2"}, "value": "both"}, {"value": "no conditions"}, {"when": {"seg": null}, "value": "null"}, {"when": {"seg": "z"}, "value": "one"}], "rollout": {"percent": 50}}'),
    ("flags:def:b", '{"on": true, "rules": [{"when": {}, "value": "all"}]}'),
]
CONTEXTS = [("u1", {"seg": "x"}, None), ("u2", {"seg": "y"}, None), ("u3", {"seg": "z"}, None), ("", {"seg": "z"}, None), (None, {"seg": "z"}, None), (None, {}, None), ("u4é€", {}, {"b": "over"})]


def fnv(text):
    h = scalars.FNV_OFFSET
    for unit in memoryview(text.encode("utf-16-le")).cast("H"):
        for byte in [unit >> 8, unit & 255] if unit > 255 else [unit]:
            h = (h ^ byte) * scalars.FNV_PRIME % 2**32
    return h


def inputs(spark):
    contexts = spark.createDataFrame(CONTEXTS, "id string, attributes map<string,string>, overrides map<string,string>")
    asked = spark.createDataFrame([("a", "d"), ("b", "d"), ("none", "d")], "flag string, default string")
    prefs = spark.createDataFrame([("u1", "b", "mine"), ("u3", "b", None), (None, "b", "lost")], "id string, flag string, pref string")
    return contexts, asked, flags.definitions(spark.createDataFrame(ENTRIES, "key string, value string")), prefs


def test_evaluate(spark):
    got = {(r["id"], r["flag"]): (r["value"], r["reason"], r["rule"]) for r in flags.evaluate(*inputs(spark)).collect()}
    rolled = lambda i: ("true", "rollout", None) if fnv(f"{i}:a") % 100 < 50 else ("d", "default", None)
    assert got["u1", "a"] == rolled("u1") and got["u4é€", "a"] == rolled("u4é€")
    assert got["u2", "a"] == ("both", "rule", 0) and got["u3", "a"] == ("one", "rule", 3)
    assert got["u1", "b"] == ("mine", "user-pref", None) and got["u3", "b"] == ("all", "rule", 0)
    assert got["u4é€", "b"] == ("over", "override", None)
    assert {got[i, f] for i in ("", None) for f in "ab"} == {("d", "error", None)}
    assert got["u1", "none"] == ("d", "no-snapshot", None)
    rows = flags.evaluate(*inputs(spark)).groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in rows} == {"u1": 3, "u2": 3, "u3": 3, "": 3, None: 6, "u4é€": 3}


def test_hash_in_parts(spark):
    pairs = [("", "a"), ("7", "new-checkout"), ("é€", "x"), ("a𝄞", "ÿĀ𝄞"), ("x" * 300, "b")]
    df = spark.createDataFrame(pairs, "a string, b string")
    parts = scalars.fnv_mixed(scalars.fnv1a32(F.col("a")), scalars.fnv_bytes(F.concat(F.lit(":"), F.col("b"))))
    rows = df.select(parts.alias("parts"), scalars.fnv1a32(F.concat_ws(":", "a", "b")).alias("whole")).collect()
    assert [(r["parts"], r["whole"]) for r in rows] == [(fnv(f"{a}:{b}"),) * 2 for a, b in pairs]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_contexts_are_dealt_not_broadcast(spark):
    found = plan(flags.evaluate(*inputs(spark)))
    assert "BroadcastNestedLoopJoin BuildRight" in found
    assert "REPARTITION_BY_COL" in found and "CartesianProduct" not in found


def test_open_details_keep_rows_in_place(spark):
    evaluated, (_, asked, _, _) = flags.evaluate(*inputs(spark)), inputs(spark)
    own, more = plan(evaluated), plan(flags.open_details(evaluated, asked))
    assert more.count("SortMergeJoin") == own.count("SortMergeJoin") and more.count("Exchange hash") == own.count("Exchange hash")


def test_typed_details_keep_rows_in_place(spark):
    evaluated, (_, asked, _, _) = flags.evaluate(*inputs(spark)), inputs(spark)
    own, more = plan(evaluated), plan(flags.typed_details(evaluated, asked.withColumn("kind", F.lit("string"))))
    assert more.count("SortMergeJoin") == own.count("SortMergeJoin") and more.count("Exchange hash") == own.count("Exchange hash")
