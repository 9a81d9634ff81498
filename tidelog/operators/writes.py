"""Write commands: each derives the rows to append, or the result that a caller sees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def puts(resolved: DataFrame) -> DataFrame:
    """The put rows of SET commands; a full put replaces value, metadata and expiry."""
    return resolved.filter(F.col("op").isin("SET", "SETEX")).select("key", "ms", "seq", "value", "meta", F.col("exp_set").alias("expires_at_ms"))


def set_if_absent(attempts: DataFrame, snap: DataFrame) -> DataFrame:
    """SETNX of (pos, key, value): the first attempt on a missing key is written. Result 1 or 0."""
    first = F.row_number().over(Window.partitionBy("key").orderBy("pos")) == 1
    there = snap.select("key", F.lit(True).alias("there"))
    return attempts.withColumn("first", first).join(there, "key", "left").select("pos", "key", F.when(F.col("there").isNull() & F.col("first"), 1).otherwise(0).alias("result"))


def set_if_present(attempts: DataFrame, snap: DataFrame) -> DataFrame:
    """SET XX: the attempts on live keys."""
    return attempts.join(snap.select("key"), "key", "left_semi").select("pos", "key", "value")


def swapped(resolved: DataFrame) -> DataFrame:
    """GETSET: each put's old value."""
    return resolved.filter(F.col("op").isin("SET", "SETEX")).select("key", "seq", "value", F.col("was_value").alias("old_value"))


def taken(resolved: DataFrame) -> DataFrame:
    """GETDEL: each delete's old value, null if there was none."""
    return resolved.filter(F.col("op") == "DEL").select("key", "seq", F.col("was_value").alias("old_value"))


def read_and_expire(requests: DataFrame, snap: DataFrame, expires_at_ms: int | None) -> DataFrame:
    """GETEX: values, and the expiry that live keys get."""
    return requests.join(snap, "key", "left").select("pos", "key", "value", F.when(F.col("shard").isNotNull(), F.lit(expires_at_ms)).cast("long").alias("expires_at_ms"))


def delete_count(requests: DataFrame, snap: DataFrame) -> DataFrame:
    """DEL: distinct live keys among the requests."""
    return requests.select("key").distinct().join(snap, "key", "left_semi").agg(F.count("*").alias("n"))


def after_delete(requests: DataFrame, snap: DataFrame) -> DataFrame:
    return snap.join(requests.select("key").distinct(), "key", "left_anti").select("key", "value")


def compared(attempts: DataFrame, snap: DataFrame) -> DataFrame:
    """Compare-and-swap or -delete of (pos, key, expected_rev): ``ok`` for the first matching attempt of a key, ``nil`` for a missing key, else ``conflict``."""
    joined = attempts.join(snap.select("key", "rev"), "key", "left").withColumn("match", F.coalesce(F.col("rev") == F.col("expected_rev"), F.lit(False)))
    nth = F.sum(F.when(F.col("match"), 1).otherwise(0)).over(Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    result = F.when(F.col("rev").isNull(), "nil").when(F.col("match") & (nth == 1), "ok").otherwise("conflict")
    return joined.withColumn("result", result).select("pos", "key", "expected_rev", "result")


def multi_set(pairs: DataFrame) -> DataFrame:
    """MSET of (pos, key, value): the last value of a key wins; expiry and metadata are cleared."""
    return pairs.groupBy("key").agg(F.max_by("value", "pos").alias("value")).select("key", "value", F.lit(None).cast("long").alias("expires_at_ms"))


def expirations(resolved: DataFrame) -> DataFrame:
    """EXPIRE: 1 and the new expiry where the key is live, else 0."""
    live = F.col("was_live")
    return resolved.filter(F.col("op") == "EXPIRE").select("key", "seq", F.when(live, 1).otherwise(0).alias("result"), F.when(live, F.col("exp_set")).alias("expires_at_ms"))


def expire_at(requests: DataFrame, snap: DataFrame, now: int) -> DataFrame:
    """EXPIREAT of (pos, key, at_ms): a time not after now deletes and returns 1 even for a missing key."""
    past = F.col("at_ms") <= now
    live = F.col("shard").isNotNull()
    return requests.join(snap.select("key", "shard"), "key", "left").select(
        "pos", "key", "at_ms",
        F.when(past, "DEL").when(live, "TTL").alias("kind"),
        F.when(past | live, 1).otherwise(0).alias("result"),
    )


def persisted(resolved: DataFrame) -> DataFrame:
    """PERSIST: 1 where the key is live and has an expiry."""
    return resolved.filter(F.col("op") == "PERSIST").select("key", "seq", F.when(F.col("was_exp").isNotNull(), 1).otherwise(0).alias("result"))


def counted(counters: DataFrame) -> DataFrame:
    """INCR and DEL of counters: the running value (null after a delete)."""
    order = Window.partitionBy("key").orderBy("ms", "seq").rowsBetween(Window.unboundedPreceding, 0)
    cut = counters.withColumn("segment", F.sum(F.when(F.col("op") == "DEL", 1).otherwise(0)).over(order))
    inside = Window.partitionBy("key", "segment").orderBy("ms", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return cut.select("key", "ms", "seq", "op", F.when(F.col("op") == "INCR", F.sum("delta").over(inside)).alias("value"))


def batch(ops: DataFrame) -> DataFrame:
    """An ordered mix of set, incr, delete, get and exists on numeric keys: the result of each."""
    order = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    op = F.col("op")
    cut = ops.withColumn("segment", F.sum(F.when(op.isin("set", "delete"), 1).otherwise(0)).over(order))
    inside = Window.partitionBy("key", "segment").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumns({
        "base": F.max(F.when(op == "set", F.col("value"))).over(inside),
        "added": F.sum(F.when(op == "incr", F.col("value"))).over(inside),
    })
    now = F.when(F.col("base").isNotNull() | F.col("added").isNotNull(), F.coalesce("base", F.lit(0)) + F.coalesce("added", F.lit(0)))
    cut = cut.withColumn("now", now).withColumn("was", F.lag("now").over(Window.partitionBy("key").orderBy("pos")))
    result = (
        F.when(op == "set", "ok")
        .when(op == "delete", F.when(F.col("was").isNotNull(), "1").otherwise("0"))
        .when(op == "exists", F.when(F.col("now").isNotNull(), "1").otherwise("0"))
        .otherwise(F.coalesce(F.col("now").cast("string"), F.lit("nil")))
    )
    return cut.select("pos", "key", "op", result.alias("result"))
