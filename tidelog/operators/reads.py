"""Read commands over a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions import glob

#: Most keys that KEYS may return.
KEYS_LIMIT = 1_000_000
LIST_DEFAULT, LIST_CAP = 100, 1000


def get(snap: DataFrame, key: str) -> DataFrame:
    return snap.filter(F.col("key") == key).select("key", "value")


def ttl_ms(as_of: int):
    """Milliseconds left: -2 for a missing key, -1 without expiry."""
    return F.when(F.col("shard").isNull(), -2).when(F.col("expires_at_ms").isNull(), -1).otherwise(F.col("expires_at_ms") - as_of).cast("long")


def ttl_s(as_of: int):
    left = ttl_ms(as_of)
    return F.when(left < 0, left).otherwise(F.floor(left / 1000)).cast("long")


def looked_up(requests: DataFrame, snap: DataFrame) -> DataFrame:
    """Requests (pos, key) with what the snapshot has of each, null if missing."""
    return requests.join(snap, "key", "left")


def mget(requests: DataFrame, snap: DataFrame) -> DataFrame:
    """Values in request order; missing keys give null, repeated keys repeat."""
    return looked_up(requests, snap).select("pos", "key", "value")


def exists_count(requests: DataFrame, snap: DataFrame) -> DataFrame:
    """Live keys among the requests; repeats count."""
    return requests.join(snap, "key", "left_semi").agg(F.count("*").alias("n"))


def keys(df: DataFrame, pattern: str, limit: int = KEYS_LIMIT) -> DataFrame:
    """All keys that match; fails at ``limit`` results."""
    found = df.filter(glob.matches(F.col("key"), pattern)).select("key")
    over = found.limit(limit).agg(F.count("*").alias("_n")).filter(F.col("_n") >= limit)
    stop = over.select(F.raise_error(F.lit(f"more than {limit} keys match")).cast("string").alias("key"))
    return found.union(stop)


def matching(df: DataFrame, pattern: str) -> DataFrame:
    return df.filter(glob.matches(F.col("key"), pattern))


def page(df: DataFrame, cursor: str | None, count: int = 10, pattern: str = "*") -> DataFrame:
    """The next ``count`` matching keys behind the cursor in byte order; ``cursor`` is the last key if the page is full."""
    behind = df if cursor is None else df.filter(F.col("key") > cursor)
    found = matching(behind, pattern).select("key").orderBy("key").limit(max(1, count))
    return found


def next_cursor(page_rows: DataFrame, count: int) -> DataFrame:
    """The cursor for the following page: the last key of a full page, else null."""
    size = F.count("*")
    return page_rows.agg(F.when(size >= max(1, count), F.max("key")).alias("cursor"), size.alias("n"))


def list_prefix(df: DataFrame, prefix: str, cursor: str | None = None, limit: int = LIST_DEFAULT) -> DataFrame:
    """Keys under a prefix; pattern characters in the prefix are live."""
    return page(df, cursor, min(limit, LIST_CAP), prefix + "*")


def sharded_page(df: DataFrame, cursor: tuple[int, str] | None, count: int, pattern: str = "*") -> DataFrame:
    """A page in the order of shards, then keys."""
    if cursor is not None:
        shard, key = cursor
        df = df.filter((F.col("shard") > shard) | ((F.col("shard") == shard) & (F.col("key") > key)))
    return matching(df, pattern).select("shard", "key").orderBy("shard", "key").limit(max(1, count))
