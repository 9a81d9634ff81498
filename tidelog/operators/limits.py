"""Rate limits, cache reads and locks over event streams."""

from __future__ import annotations

from collections import OrderedDict, deque
from math import ceil
from types import SimpleNamespace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.plans.fold import ordered_fold


DECISION = "allowed boolean, remaining long, reset_ms long, retry_after_ms long"
DECIDED = [x.split()[0] for x in DECISION.split(", ")]


def check_window(limit: int, window_ms: int) -> None:
    if limit < 1 or window_ms <= 0:
        raise ValueError("limit must be at least 1 and the window positive")


def check_bucket(capacity: int, rate: float) -> None:
    if capacity < 1 or rate <= 0:
        raise ValueError("capacity must be at least 1 and the rate positive")


def fixed_window(requests: DataFrame, limit: int, window_ms: int) -> DataFrame:
    """Requests (key, ms, seq) counted per window; denied ones count too."""
    check_window(limit, window_ms)
    start = F.floor(F.col("ms") / window_ms).cast("long")
    n = F.row_number().over(Window.partitionBy("key", "bucket").orderBy("ms", "seq"))
    rows = requests.withColumn("bucket", start).withColumn("n", n)
    reset = (F.col("bucket") + 1) * window_ms
    return rows.select(
        "key", "seq",
        (F.col("n") <= limit).alias("allowed"),
        F.greatest(F.lit(0), limit - F.col("n")).cast("long").alias("remaining"),
        reset.alias("reset_ms"),
        F.when(F.col("n") > limit, reset - F.col("ms")).alias("retry_after_ms"),
    )


def sliding_window(requests: DataFrame, limit: int, window_ms: int) -> DataFrame:
    """The previous window's count fades out linearly; denied requests don't count."""
    check_window(limit, window_ms)

    def step(state, ms):
        b = ms // window_ms
        if state is None:
            cur = prev = 0
        elif state[0] == b:
            cur, prev = state[1], state[2]
        else:
            cur, prev = 0, state[1] if state[0] == b - 1 else 0
        estimate = prev * (1.0 - (ms % window_ms) / window_ms) + (cur + 1)
        reset = (b + 1) * window_ms
        if estimate <= limit:
            return (b, cur + 1, prev), (True, int(max(0, limit - estimate // 1)), reset, None)
        wait = ceil((estimate - limit) / prev * window_ms) if prev else reset - ms + window_ms
        return (b, cur, prev), (False, 0, reset, wait)

    return ordered_fold(requests, "key", ["ms", "seq"], ["ms"], step, DECISION).select("key", "seq", *DECIDED)


def token_bucket(requests: DataFrame, capacity: int, rate: float) -> DataFrame:
    """Tokens refill by ``rate`` a second up to the capacity; a denied request leaves the state alone."""
    check_bucket(capacity, rate)
    step = token_step(capacity, rate)
    renew = ceil(1000 / rate)

    def full(state, ms):
        state, (allowed, remaining) = step(state, ms)
        wait = None if allowed else ceil((1 - min(float(capacity), state[0] + (ms - state[1]) / 1000.0 * rate)) / rate * 1000)
        return state, (allowed, remaining, ms + (renew if allowed else wait), wait)

    return ordered_fold(requests, "key", ["ms", "seq"], ["ms"], full, DECISION).select("key", "seq", *DECIDED)


def token_step(capacity: int, rate: float):
    def step(state, ms):
        if state is None:
            return (capacity - 1.0, ms), (True, capacity - 1)
        tokens = min(float(capacity), state[0] + (ms - state[1]) / 1000.0 * rate)
        if tokens >= 1:
            return (tokens - 1, ms), (True, int(tokens - 1))
        return state, (False, 0)

    return step


def block_for(decided: DataFrame, requests: DataFrame) -> DataFrame:
    """For each request, when the next allowed one of its key comes (itself, if allowed)."""
    rows = decided.join(requests.select("seq", "ms"), "seq")
    ahead = Window.partitionBy("key").orderBy("ms", "seq").rowsBetween(0, Window.unboundedFollowing)
    return rows.select("key", "seq", (F.min(F.when(F.col("allowed"), F.col("ms"))).over(ahead) - F.col("ms")).alias("wait_ms"))


def cache_reads(accesses: DataFrame, ttl_ms: int, stale_ms: int) -> DataFrame:
    """Reads through a cache that serves stale entries while it renews them: ``miss``, ``stale`` or ``fresh``.

    A miss and a stale read store the entry anew, for ``ttl_ms + stale_ms``.
    """

    def step(stored, ms):
        if stored is None or stored + ttl_ms + stale_ms <= ms:
            return ms, ("miss",)
        if stored + ttl_ms <= ms:
            return ms, ("stale",)
        return stored, ("fresh",)

    return ordered_fold(accesses, "key", ["ms", "seq"], ["ms"], step, "outcome string").select("key", "seq", "outcome")


def locks(requests: DataFrame, lease_ms: int) -> DataFrame:
    """Lock requests: granted if no lease runs."""

    def step(until, ms):
        if until is None or until <= ms:
            return ms + lease_ms, (True,)
        return until, (False,)

    return ordered_fold(requests, "key", ["ms", "seq"], ["ms"], step, "granted boolean").select("key", "seq", "granted")


def lock_steps(calls: DataFrame, lease_ms: int) -> DataFrame:
    """Calls (key, ms, seq, op, token) of a lock: ``acquire`` is granted if no lease runs, ``release`` frees the lock only for the token that holds it."""

    def step(held, ms, op, token):
        holder, until = held or (None, 0)
        free = until <= ms
        if op == "acquire":
            return ((token, ms + lease_ms), (True,)) if free else (held, (False,))
        return (None, (True,)) if not free and holder == token else (held, (False,))

    return ordered_fold(calls, "key", ["ms", "seq"], ["ms", "op", "token"], step, "done boolean").select("key", "seq", "op", "done")


def block_until(decided: DataFrame, requests: DataFrame, timeout_ms: int) -> DataFrame:
    """Waiting with a timeout: the wait until the key's next allowed request, or none and ``timed_out`` if that is too long."""
    waits = block_for(decided, requests)
    late = F.col("wait_ms").isNull() | (F.col("wait_ms") >= timeout_ms)
    return waits.select("key", "seq", F.when(~late, F.col("wait_ms")).alias("wait_ms"), late.alias("timed_out"))


def cache_hits(accesses: DataFrame, capacity: int) -> DataFrame:
    """Reads (shard, key, bytes, ms, seq) through a cache of ``capacity`` bytes: hit or not; a miss stores the entry.

    New entries wait in a first queue. Room is made from it while it holds any:
    an entry read since goes over to the main queue, another is dropped and its
    name kept for a while. A key whose name is kept enters the main queue at once;
    there, entries read since they last came up go round once more.
    """
    names = max(64, capacity // 640)

    def step(state, key, size):
        cache = state or SimpleNamespace(size={}, read=set(), first=deque(), main=deque(), dropped=OrderedDict(), used=0)
        if key in cache.size:
            cache.read.add(key)
            return cache, (True,)
        (cache.main if cache.dropped.pop(key, False) else cache.first).append(key)
        cache.size[key] = max(1, size)
        cache.used += cache.size[key]
        while cache.used > capacity:
            queue = cache.first or cache.main
            name = queue.popleft()
            if name in cache.read:
                cache.read.remove(name)
                cache.main.append(name)
                continue
            cache.used -= cache.size.pop(name)
            if queue is cache.first:
                cache.dropped[name] = True
                if len(cache.dropped) > names:
                    cache.dropped.popitem(last=False)
        return cache, (False,)

    return ordered_fold(accesses, "shard", ["ms", "seq"], ["key", "bytes"], step, "hit boolean").select("shard", "seq", "hit")
