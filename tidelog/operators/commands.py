"""Key-value commands applied in order: what each returns, and the row it appends to the log.

A command finds what the commands before it on the same key of the same
namespace left. ``rev`` is the revision that it gets if it writes; it must rise
along the key.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.plans.fold import ordered_fold

INPUTS = ["ms", "op", "value", "ttl_ms", "keep_ttl", "cond", "get_old", "expected_rev", "meta", "rev"]
OUTPUTS = "result string, kind string, new_value string, new_meta string, expires_at_ms long, new_rev long"
_INTEGER = re.compile(r"[+-]?[0-9]+").fullmatch
_LEAST, _MOST = -(2**63), 2**63 - 1
_NONE = (None, None, None, None, None)


def _valid(meta: str | None) -> str | None:
    """Metadata that isn't JSON is left out silently."""
    try:
        json.loads(meta or "")
    except ValueError:
        return None
    return meta


def step(state, ms, op, value, ttl_ms, keep_ttl, cond, get_old, expected_rev, meta, rev):
    """State: (value, metadata, expiry, revision) of a key, or None; an expired one is still there until it is written."""
    live = state is not None and (state[2] is None or state[2] > ms)
    old = state[0] if live else None

    def put(result, new_value, new_meta, expires):
        return (new_value, new_meta, expires, rev), (result, "PUT", new_value, new_meta, expires, rev)

    def nothing(result):
        return state, (result, *_NONE)

    if op == "GET":
        return nothing("nil" if old is None else old)
    if op == "DEL":
        return (None, ("1", "DEL", None, None, None, rev)) if live else nothing("0")
    if op == "EXPIRE":
        return ((old, state[1], ms + ttl_ms, state[3]), ("1", "TTL", None, None, ms + ttl_ms, rev)) if live else nothing("0")
    if op == "PERSIST":
        bound = live and state[2] is not None
        return ((old, state[1], None, state[3]), ("1", "TTL", None, None, None, rev)) if bound else nothing("0")
    if op == "INCR":
        if not _INTEGER(old or "0"):
            return nothing("error: not an integer")
        total = int(old or "0") + int(value)
        if not _LEAST <= total <= _MOST or not _LEAST <= int(old or "0") <= _MOST:
            return nothing("error: overflow")
        return put(str(total), str(total), None, state[2] if live else None)  # keeps the expiry, drops metadata
    if op == "DELREV":
        if not live:
            return nothing("nil")
        return (None, ("1", "DEL", None, None, None, rev)) if state[3] == expected_rev else nothing("conflict")
    # SET
    if ttl_ms == 0:
        return nothing("error: invalid expiry")
    expires = None if ttl_ms is None else ms + ttl_ms
    if cond == "REV":
        if not live:
            return nothing("nil")
        return put(str(rev), value, _valid(meta), expires) if state[3] == expected_rev else nothing("conflict")
    if cond == "NX" and live or cond == "XX" and not live:
        return nothing("nil")
    if get_old and cond is None:  # a swap: expiry and metadata are cleared whatever is asked
        return put("nil" if old is None else old, value, None, None)
    if keep_ttl:  # also an expiry that has passed
        expires = state[2] if state is not None else None
    return put("ok", value, _valid(meta), expires)


def applied(commands: DataFrame) -> DataFrame:
    """Commands (ns, key, ms, seq, and ``INPUTS``) with their result and the log row they append (``kind`` null for none)."""
    return ordered_fold(commands, ["ns", "key"], ["ms", "seq"], INPUTS, step, OUTPUTS)


def final_state(done: DataFrame, as_of: int) -> DataFrame:
    """(ns, key, value, meta, rev, expires_at_ms) of the live keys, from the appended rows alone."""
    at = F.struct("ms", "seq")
    rows = done.filter(F.col("kind").isNotNull())
    put_at = F.when(F.col("kind") != "TTL", at)
    last = rows.groupBy("ns", "key").agg(
        F.max_by("kind", put_at).alias("kind"),
        F.max_by("new_value", put_at).alias("value"), F.max_by("new_meta", put_at).alias("meta"), F.max_by("new_rev", put_at).alias("rev"),
        F.max_by("expires_at_ms", at).alias("expires_at_ms"),
    )
    live = (F.col("kind") == "PUT") & (F.col("expires_at_ms").isNull() | (F.col("expires_at_ms") > as_of))
    return last.filter(live).drop("kind")


def batches(ops: DataFrame) -> DataFrame:
    """Batches of commands (batch, pos, key, op) on fresh keys, each up to its first failed condition.

    ``op`` is set, setnx, delete or get. ``setnx`` on a present key is the conflict;
    what comes behind it is skipped, what came before stays.
    """
    order = Window.partitionBy("batch", "key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    # before the first conflict every write took place, so that the last one tells whether the key is there
    last = F.last(F.when(F.col("op") != "get", F.col("op")), ignorenulls=True).over(order)
    there = F.coalesce(last != "delete", F.lit(False))
    seen = ops.withColumn("there", there)
    conflict = F.min(F.when((F.col("op") == "setnx") & F.col("there"), F.col("pos"))).over(Window.partitionBy("batch"))
    result = (
        F.when(F.col("pos") > F.col("stop"), "skipped").when(F.col("pos") == F.col("stop"), "conflict")
        .when(F.col("op").isin("set", "setnx"), "ok").when(F.col("op") == "delete", F.when(F.col("there"), "1").otherwise("0"))
        .otherwise(F.when(F.col("there"), "found").otherwise("nil"))
    )
    return seen.withColumn("stop", conflict).select("batch", "pos", "key", "op", result.alias("result"))
