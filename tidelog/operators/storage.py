"""The log as files: record sizes, recovery, compaction, and separated values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.plans.state import snapshot

HEADER_BYTES = 37
TOMBSTONE, NO_EXPIRY, TTL_UPDATE = 1, 2, 4


def records(log: DataFrame) -> DataFrame:
    """Flags and encoded size of each record."""
    flags = (
        F.when(F.col("kind") == "DEL", TOMBSTONE).otherwise(0)
        + F.when(F.col("expires_at_ms").isNull(), NO_EXPIRY).otherwise(0)
        + F.when(F.col("kind") == "TTL", TTL_UPDATE).otherwise(0)
    )
    size = HEADER_BYTES + F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + F.coalesce(F.octet_length("meta"), F.lit(0))
    return log.select("shard", "rev", "key", flags.cast("int").alias("flags"), size.cast("long").alias("bytes"))


def append(log: DataFrame, path: str) -> None:
    """One batch of records into a namespace's log."""
    log.write.mode("append").partitionBy("shard").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def intact(log: DataFrame, bad: str) -> DataFrame:
    """The records of each shard before its first bad one."""
    spoiled = F.max(F.when(F.expr(bad), 1).otherwise(0)).over(Window.partitionBy("shard").orderBy("rev").rowsBetween(Window.unboundedPreceding, 0))
    return log.withColumn("_spoiled", spoiled).filter("_spoiled = 0").drop("_spoiled")


def compacted(log: DataFrame, as_of: int) -> DataFrame:
    """What a rewrite keeps: one put for each live key."""
    return snapshot(log, as_of).select("shard", "key", "value", "meta", "expires_at_ms", "rev")


def rewritten(log: DataFrame, as_of: int) -> DataFrame:
    """The log that a rewrite up to a time leaves: one put for each key live then, at its old place, and all later records."""
    puts = snapshot(log, as_of, "put_at.ms", "put_at.seq").withColumn("kind", F.lit("PUT"))
    return puts.select(*log.columns).unionByName(log.filter(F.col("ms") > as_of))


def compaction_stats(log: DataFrame, as_of: int) -> DataFrame:
    """Records and live keys of each shard, and the share that a rewrite drops."""
    total = log.filter(F.col("ms") <= as_of).groupBy("shard").agg(F.count("*").alias("records"))
    live = snapshot(log, as_of).groupBy("shard").agg(F.count("*").alias("live"))
    joined = total.join(live, "shard", "left").withColumn("live", F.coalesce("live", F.lit(0)))
    return joined.withColumn("dead_share", F.round(1 - F.col("live") / F.col("records"), 6))


def blobs(values: DataFrame, least: int) -> DataFrame:
    """Separated values: one row per content of at least ``least`` characters, with its references."""
    return values.filter(F.length("value") >= least).groupBy(F.sha2("value", 256).alias("hash")).agg(F.count("*").alias("refs"), F.max(F.octet_length("value")).cast("long").alias("bytes"))


def orphans(stored: DataFrame, referenced: DataFrame) -> DataFrame:
    """Stored contents that no key refers to."""
    return stored.join(referenced.select("hash"), "hash", "left_anti")
