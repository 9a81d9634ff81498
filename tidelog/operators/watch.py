"""Change feeds, in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.scalars import base64url


def replay(log: DataFrame, since: int, prefix: str = "") -> DataFrame:
    """Set and del events after a revision (exclusive); expiry updates are not replayed."""
    rows = log.filter((F.col("rev") > since) & (F.col("kind") != "TTL"))
    rows = rows.filter(F.col("key").startswith(prefix)) if prefix else rows
    return rows.select(F.when(F.col("kind") == "PUT", "set").otherwise("del").alias("type"), "key", "value", "expires_at_ms", "rev")


def replay_keys(log: DataFrame, keys: DataFrame, since: int) -> DataFrame:
    """The events of several keys, in one feed."""
    return replay(log.join(keys.select("key").distinct(), "key", "left_semi"), since)


def from_snapshot(snap: DataFrame, log: DataFrame, since: int, prefix: str = "") -> DataFrame:
    """A first subscription that began before its scan: all live keys, then what the log has after a revision, nothing twice.

    A put that both have is taken from the snapshot, whose expiry may have been moved since.
    """
    event = F.struct("type", "value", "expires_at_ms")
    scanned, replayed = (rows.select("key", "rev", event.alias("event"), F.lit(n).alias("place")) for n, rows in enumerate((initial(snap, prefix), replay(log, since, prefix))))
    first = scanned.union(replayed).groupBy("key", "rev").agg(F.min_by("event", "place").alias("event"))
    return first.select("event.type", "key", "event.value", "event.expires_at_ms", "rev")


def initial(snap: DataFrame, prefix: str = "") -> DataFrame:
    """A first subscription: all live keys with their revisions."""
    rows = snap.filter(F.col("key").startswith(prefix)) if prefix else snap
    return rows.select(F.lit("set").alias("type"), "key", "value", "expires_at_ms", "rev")


def flushed(snap: DataFrame, rev: int) -> DataFrame:
    """FLUSHDB: a del event for each live key, all with one revision."""
    return snap.select(F.lit("del").alias("type"), "key", F.lit(rev).cast("long").alias("rev"))


def event_json(events: DataFrame) -> DataFrame:
    """Server-sent form of events, in short."""
    return events.select("key", "rev", F.to_json(F.struct("type", "key", "rev")).alias("data"))


def event_fields(events: DataFrame, now_ms: int) -> DataFrame:
    """The fields of the server-sent form: value in URL-safe base64, seconds left (0 if past) and metadata, which only set events have."""
    is_set = F.col("type") == "set"
    left = F.when(is_set & F.col("expires_at_ms").isNotNull(), F.floor(F.greatest(F.lit(0), F.col("expires_at_ms") - now_ms) / 1000))
    body = F.struct("type", "key", F.when(is_set, base64url(F.encode("value", "UTF-8"))).alias("value"), F.col("rev").alias("revision"), left.cast("long").alias("ttl"))
    return events.select("key", "rev", F.to_json(body).alias("data"))
