"""Input tables, and the command streams that are read from them."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions.time import HOUR, millis
from tidelog.plans.state import with_revisions

AS_OF = 1_705_708_800_000
TTL = 3 * HOUR
SHARDS = 4
#: Later times need no bound.
LAST_MS = 253_402_300_799_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timed_events(spark: SparkSession, sf_dir: str, until: int | None = None) -> DataFrame:
    """events with ``ms`` and ``seq``, up to a time in ms; the bound is on the stored column, so that the scan can skip by it."""
    events = table(spark, sf_dir, "events")
    if until is not None and until < LAST_MS:
        end = (datetime(1970, 1, 1) + timedelta(milliseconds=until + 1)).isoformat(sep=" ")
        events = events.filter(F.col("ts") < F.lit(end).cast("timestamp_ntz"))
    return events.withColumns({"ms": millis("ts"), "seq": F.col("event_id")})


def commands(spark: SparkSession, sf_dir: str, until: int | None = None) -> DataFrame:
    """Key-value commands: one event type for each kind of record."""
    op = F.create_map(*[F.lit(x) for x in ("purchase", "SET", "signup", "SETEX", "error", "DEL", "view", "EXPIRE", "click", "PERSIST")])
    e = timed_events(spark, sf_dir, until)
    kind = F.col("event_type")
    return e.select(
        F.concat(F.lit("user:"), F.col("user_id")).alias("key"),
        (F.col("user_id") % SHARDS).cast("int").alias("shard"),
        "ms", "seq",
        op[kind].alias("op"),
        F.when(kind.isin("purchase", "signup"), F.col("value").cast("string")).alias("value"),
        F.when(kind == "signup", F.col("props")).alias("meta"),
        F.when(kind.isin("signup", "view"), F.col("ms") + TTL).alias("exp_set"),
    )


def requests(spark: SparkSession) -> DataFrame:
    """(pos, key): users 199 down to 0, some missing, then users 0 to 49 again."""
    n = F.col("id")
    user = F.when(n < 200, 199 - n).otherwise(n - 200)
    return spark.range(250).select(n.alias("pos"), F.concat(F.lit("user:"), user).alias("key"))


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Increments of ``cnt:`` keys; an error event deletes the counter."""
    kind = F.col("event_type")
    e = timed_events(spark, sf_dir).filter(kind.isin("click", "purchase", "error"))
    delta = F.when(kind == "click", F.lit(1)).when(kind == "purchase", F.floor("value")).cast("long")
    return e.select(F.concat(F.lit("cnt:"), F.col("user_id")).alias("key"), "ms", "seq", F.when(kind == "error", "DEL").otherwise("INCR").alias("op"), delta.alias("delta"))


def mixed_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands of all kinds and options on few keys of two namespaces, with the revision that each gets if it writes."""
    n = F.col("event_id")
    kinds = ("SET", "SET", "SET", "SET", "SET", "SET", "INCR", "DEL", "EXPIRE", "SET", "SET", "PERSIST", "DELREV", "GET", "INCR")
    k = F.expr(f"cast(event_id * 7 % {len(kinds)} as int)")  # neighbours differ
    op = F.array(*map(F.lit, kinds))[k]
    e = timed_events(spark, sf_dir).select(
        F.concat(F.lit("ns"), F.col("user_id") % 2).alias("ns"),
        F.concat(F.lit("k"), F.col("user_id") % 40).alias("key"),
        (F.col("user_id") % SHARDS).cast("int").alias("shard"),
        "ms", "seq", op.alias("op"),
        F.when(op == "INCR", (n % 5 + 1).cast("string")).when(op == "SET", F.when(n % 29 == 0, "9223372036854775807").when(n % 3 == 0, F.concat(F.lit("v"), n)).otherwise(F.floor("value").cast("string"))).alias("value"),
        F.when(k.isin(1, 4), F.lit(TTL)).when(op == "EXPIRE", F.lit(9 * TTL)).when(k == 10, F.lit(0)).cast("long").alias("ttl_ms"),
        (k == 2).alias("keep_ttl"),
        F.when(k == 3, "NX").when(k == 4, "XX").when(k == 9, "REV").alias("cond"),
        (k == 5).alias("get_old"),
        F.when(k.isin(1, 5), F.when(n % 4 == 0, "not json").otherwise(F.col("props"))).alias("meta"),
    )
    timed = with_revisions(e)
    before = F.lag("rev").over(Window.partitionBy("ns", "key").orderBy("ms", "seq"))
    asked = (F.col("cond") == "REV") | (F.col("op") == "DELREV")
    return timed.withColumn("expected_rev", F.when(asked, before - F.when(F.col("seq") % 5 == 0, 1).otherwise(0)))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("url").alias("key"), F.col("html").alias("value"), (F.col("page_id") % SHARDS).cast("int").alias("shard"))
