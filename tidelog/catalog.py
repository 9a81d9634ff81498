"""All queries of the library over the test tables, by name."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import oracles
from tidelog.functions import scalars
from tidelog.functions.time import HOUR
from tidelog.operators import commands as kv
from tidelog.operators import flags, limits, metrics, reads, schemas, storage, watch, writes
from tidelog.plans.state import log_state, mutation_log, resolve, snapshot
from tidelog.sources.tables import AS_OF, commands, counters, mixed_commands, pages, requests, table, timed_events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
GLOBS = ("https://m.*", "http://*", "*.html", "https://[bm]*", "*/en/?*")
SINCE = 1_705_000_000_000
BLOB_CHARS = 2000
RL_LIMIT, RL_WINDOW = 3, 6 * HOUR
RL_CAPACITY, RL_RATE = 3, 0.00005
LEASE = HOUR // 2
CACHE_BYTES = 300
SCHEMAS = {"ev:*": "k string", "ev:c*": "k bigint", "ev:*:7": "k bigint NOT NULL"}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _resolved(spark, sf):
    return resolve(commands(spark, sf))


def _log(spark, sf, until=None):
    """The log; commands after ``until`` change nothing before it, so they needn't enter the windows."""
    return mutation_log(resolve(commands(spark, sf, until)))


def _snap(spark, sf, as_of=AS_OF):
    return snapshot(_log(spark, sf, as_of), as_of)


def _snap_of(asked, spark, sf, as_of=AS_OF):
    """The snapshot of the asked keys alone, without right revisions: these count the whole shard's commands."""
    found = commands(spark, sf, as_of).join(asked.select("key").distinct(), "key", "left_semi")
    return snapshot(mutation_log(resolve(found)), as_of).drop("rev")


# -- reads ----------------------------------------------------------------------


@query
def get(spark, sf):
    return reads.get(_snap(spark, sf), "user:12")


@query
def get_with_headers(spark, sf):
    return _snap(spark, sf).select("key", "value", reads.ttl_s(AS_OF).alias("ttl_s"), reads.ttl_ms(AS_OF).alias("ttl_ms"), "rev", "meta")


@query
def mget(spark, sf):
    asked = requests(spark)
    return reads.mget(asked, _snap_of(asked, spark, sf))


@query
def exists_count(spark, sf):
    asked = requests(spark)
    return reads.exists_count(asked, _snap_of(asked, spark, sf))


@query
def ttl(spark, sf):
    asked = requests(spark)
    return reads.looked_up(asked, _snap_of(asked, spark, sf)).select("pos", "key", reads.ttl_s(AS_OF).alias("ttl"))


@query
def pttl(spark, sf):
    asked = requests(spark)
    return reads.looked_up(asked, _snap_of(asked, spark, sf)).select("pos", "key", reads.ttl_ms(AS_OF).alias("pttl"))


@query
def revision(spark, sf):
    return reads.looked_up(requests(spark), _snap(spark, sf)).select("pos", "key", F.coalesce("rev", F.lit(-2)).cast("long").alias("rev"))


@query
def getmeta(spark, sf):
    asked = requests(spark)
    return reads.looked_up(asked, _snap_of(asked, spark, sf)).select("pos", "key", "meta")


@query
def dbsize(spark, sf):
    return log_state(_log(spark, sf, AS_OF), AS_OF).agg(F.count("*").alias("n"))


@query
def ns_isolation(spark, sf):
    both = commands(spark, sf).select(F.lit("default").alias("ns"), "key").union(counters(spark, sf).select(F.lit("db1").alias("ns"), "key"))
    return both.groupBy("ns").agg(F.count_distinct("key").alias("keys"), F.count("*").alias("commands"))


@query
def keys_glob(spark, sf):
    found = [reads.keys(pages(spark, sf), p).select(F.lit(p).alias("pattern"), "key") for p in GLOBS]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


@query
def scan_page(spark, sf):
    return reads.page(pages(spark, sf), "https://b", 50)


@query
def scan_match(spark, sf):
    return reads.page(pages(spark, sf), None, 20, "*.html")


@query
def scan_cursor(spark, sf):
    return reads.next_cursor(reads.page(pages(spark, sf), None, 20, "https://[bm]*"), 20)


@query
def list_prefix(spark, sf):
    return reads.list_prefix(pages(spark, sf), "https://blog.", None, 30)


@query
def scan_sharded(spark, sf):
    return reads.sharded_page(pages(spark, sf), (1, "https://m"), 60)


# -- writes -----------------------------------------------------------------------


def _attempts(spark):
    n = F.col("id")
    return spark.range(400).select(n.alias("pos"), F.concat(F.lit("user:"), n % 300).alias("key"), F.concat(F.lit("new"), n).alias("value"))


@query
def set_apply(spark, sf):
    return writes.puts(_resolved(spark, sf))


@query
def setnx(spark, sf):
    asked = _attempts(spark)
    return writes.set_if_absent(asked, _snap_of(asked, spark, sf))


@query
def setxx(spark, sf):
    asked = _attempts(spark)
    return writes.set_if_present(asked, _snap_of(asked, spark, sf))


@query
def getset(spark, sf):
    return writes.swapped(_resolved(spark, sf))


@query
def getdel(spark, sf):
    return writes.taken(_resolved(spark, sf))


@query
def getex(spark, sf):
    asked = requests(spark)
    return writes.read_and_expire(asked, _snap_of(asked, spark, sf), AS_OF + HOUR)


@query
def del_count(spark, sf):
    asked = requests(spark)
    return writes.delete_count(asked, _snap_of(asked, spark, sf))


@query
def del_state(spark, sf):
    return writes.after_delete(requests(spark).filter("pos % 3 = 0"), _snap(spark, sf))


def _expected(spark, sf):
    """Attempts with the right revision at even positions, a stale one at odd ones."""
    known = _snap(spark, sf).select("key", "rev")
    asked = requests(spark).join(known, "key", "left")
    return asked.select("pos", "key", (F.coalesce("rev", F.lit(0)) - F.col("pos") % 2).cast("long").alias("expected_rev"))


@query
def delrev(spark, sf):
    return writes.compared(_expected(spark, sf).filter("pos < 200"), _snap(spark, sf))


@query
def cas_apply(spark, sf):
    return writes.compared(_expected(spark, sf), _snap(spark, sf))


@query
def expire_apply(spark, sf):
    return writes.expirations(_resolved(spark, sf))


@query
def expireat_apply(spark, sf):
    asked = requests(spark).withColumn("at_ms", (F.lit(AS_OF) + (F.col("pos") % 5 - 2) * HOUR).cast("long"))
    return writes.expire_at(asked, _snap_of(asked, spark, sf), AS_OF)


@query
def persist_apply(spark, sf):
    return writes.persisted(_resolved(spark, sf))


@query
def incr_running(spark, sf):
    return writes.counted(counters(spark, sf))


@query
def incr_final(spark, sf):
    last = writes.counted(counters(spark, sf)).groupBy("key").agg(F.max_by(F.struct("value"), F.struct("ms", "seq")).alias("last"))
    return last.select("key", "last.value").filter(F.col("value").isNotNull())


@query
def mset(spark, sf):
    e = timed_events(spark, sf).filter(F.col("event_type") == "purchase")
    return writes.multi_set(e.select(F.concat(F.lit("user:"), F.col("user_id")).alias("key"), F.col("value").cast("string").alias("value"), F.col("seq").alias("pos")))


def _batch(e):
    ops = F.array(*map(F.lit, ("get", "set", "delete", "incr", "exists")))
    kind = ops[(F.col("event_id") % 5).cast("int")]
    value = F.when(kind == "set", F.floor("value")).when(kind == "incr", F.lit(1)).cast("long")
    return writes.batch(e.select(F.col("seq").alias("pos"), F.concat(F.lit("b:"), F.col("user_id") % 7).alias("key"), kind.alias("op"), value.alias("value")))


@query
def batch_mixed(spark, sf):
    return _batch(timed_events(spark, sf))


@query
def batch_all(spark, sf):
    return _batch(timed_events(spark, sf))


def _applied(spark, sf):
    return kv.applied(mixed_commands(spark, sf))


@query
def kv_apply(spark, sf):
    return _applied(spark, sf).select("ns", "key", "seq", "op", "result", "kind", "new_value", "new_meta", "expires_at_ms", "new_rev")


@query
def set_options(spark, sf):
    rows = _applied(spark, sf).filter("op = 'SET'")
    return rows.groupBy("cond", "keep_ttl", "get_old", F.regexp_replace("result", "[0-9.]+", "#").alias("outcome")).agg(F.count("*").alias("n"), F.count("expires_at_ms").alias("with_expiry"), F.count("new_meta").alias("with_meta"))


@query
def incr_stored(spark, sf):
    return _applied(spark, sf).filter("op = 'INCR'").select("ns", "key", "seq", "result", "expires_at_ms")


@query
def cas_chain(spark, sf):
    return _applied(spark, sf).filter("cond = 'REV' or op = 'DELREV'").select("ns", "key", "seq", "op", "expected_rev", "result")


@query
def ns_state(spark, sf):
    return kv.final_state(_applied(spark, sf), AS_OF)


@query
def batch_abort(spark, sf):
    e = timed_events(spark, sf)
    op = F.array(*map(F.lit, ("setnx", "set", "get", "delete", "setnx")))[(F.col("user_id") % 5).cast("int")]
    return kv.batches(e.select(F.expr("event_id div 8").alias("batch"), (F.col("event_id") % 8).alias("pos"), F.concat(F.lit("b:"), F.col("user_id") % 3).alias("key"), op.alias("op")))


# -- log and storage ----------------------------------------------------------------


@query
def log_records(spark, sf):
    return storage.records(_log(spark, sf))


@query
def log_append(spark, sf):
    path = f"{_scratch(spark)}/log"
    log = _log(spark, sf)
    for half in (0, 1):
        storage.append(log.filter(F.col("seq") % 2 == half), path)
    return storage.read(spark, path).groupBy("shard", "kind").agg(F.count("*").alias("n"), F.max("rev").alias("last_rev"))


@query
def recover_state(spark, sf):
    return _snap(spark, sf, 1 << 60).select("key", "value", "rev", "expires_at_ms")


@query
def recover_truncated(spark, sf):
    good = storage.intact(_log(spark, sf), "seq % 1999 = 1998")
    return snapshot(good, AS_OF).select("key", "value", "rev")


@query
def compact_live(spark, sf):
    return storage.compacted(_log(spark, sf, AS_OF), AS_OF)


@query
def compact_resume(spark, sf):
    path = f"{_scratch(spark)}/log"
    storage.append(storage.rewritten(_log(spark, sf), SINCE), path)
    return storage.compacted(storage.read(spark, path), AS_OF)


@query
def compact_stats(spark, sf):
    return storage.compaction_stats(_log(spark, sf, AS_OF), AS_OF)


def _values(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.col("text").alias("value"))


@query
def blob_dedup(spark, sf):
    return storage.blobs(_values(spark, sf), BLOB_CHARS)


@query
def blob_orphans(spark, sf):
    values = _values(spark, sf)
    kept = storage.blobs(values.filter("doc_id % 2 = 0"), BLOB_CHARS)
    return storage.orphans(storage.blobs(values, BLOB_CHARS), kept)


@query
def flush_events(spark, sf):
    return watch.flushed(_snap(spark, sf), AS_OF)


# -- change feeds -------------------------------------------------------------------


@query
def watch_since(spark, sf):
    return watch.replay(_log(spark, sf), SINCE)


@query
def watch_prefix_since(spark, sf):
    return watch.replay(_log(spark, sf), SINCE, "user:1")


@query
def watch_initial(spark, sf):
    return watch.initial(_snap(spark, sf), "user:")


@query
def sse_events(spark, sf):
    return watch.event_json(watch.replay(_log(spark, sf), SINCE, "user:2"))


@query
def watch_keys_since(spark, sf):
    return watch.replay_keys(_log(spark, sf), requests(spark), SINCE)


@query
def watch_from_snapshot(spark, sf):
    return watch.from_snapshot(_snap(spark, sf), _log(spark, sf), SINCE, "user:1")


@query
def sse_fields(spark, sf):
    return watch.event_fields(watch.replay(_log(spark, sf), SINCE, "user:2"), AS_OF)


def _scratch(spark):
    """A new folder in the one that driver and executors share; a temporary one only where all of them are one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        root = f"file://{tempfile.mkdtemp()}"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


@query
def watch_stream(spark, sf):
    from tidelog.streaming.watch import once, watch as live

    top = _scratch(spark)
    log = _log(spark, sf)
    storage.append(log, f"{top}/log")
    written = storage.read(spark, f"{top}/log")
    once(live(spark, f"{top}/log", written.schema, since=SINCE), f"{top}/out", f"{top}/offsets")
    return spark.read.parquet(f"{top}/out")


# -- flags --------------------------------------------------------------------------

DEFS = [
    ("flags:def:new-checkout", '{"on": true, "rules": [{"when": {"segment": ["BUILDING"]}, "value": "true"}], "rollout": {"percent": 30}}'),
    ("flags:def:ai-search", '{"on": true, "rules": [{"when": {"segment": ["MACHINERY", "FURNITURE"]}, "value": "v2"}], "rollout": {"percent": 10, "value": "v1"}}'),
    ("flags:def:killed", '{"on": false, "rules": [{"when": {}, "value": "true"}], "rollout": {"percent": 100}}'),
    ("flags:def:single", '{"on": true, "rules": [{"when": {"segment": "HOUSEHOLD"}, "value": "12"}, {"when": {"id": "7"}, "value": "seven"}, {"when": {"id": ["8", "9"], "nation": "3"}, "value": "{}"}, {"when": {"id": ["10", "11", "12"]}, "value": "13.5"}]}'),
    ("flags:def:broken", '{"rules": []}'),
]
ASKED = [("new-checkout", "false"), ("ai-search", "v0"), ("killed", "false"), ("unknown", "false"), ("single", "s0")]


def _entries(spark):
    return spark.createDataFrame(DEFS, "key string, value string")


def _flags(spark):
    return spark.createDataFrame(ASKED, "flag string, default string")


def _contexts(spark, sf):
    c = table(spark, sf, "customer")
    attributes = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    override = F.when(F.col("c_acctbal") < 0, F.create_map(F.lit("ai-search"), F.lit("v9")))
    return c.select(F.col("c_custkey").cast("string").alias("id"), attributes.alias("attributes"), override.alias("overrides"))


def _prefs(spark, sf):
    c = table(spark, sf, "customer").filter("c_custkey % 50 = 0")
    return c.select(F.col("c_custkey").cast("string").alias("id"), F.lit("new-checkout").alias("flag"), F.lit("pref").alias("pref"))


def _evaluated(spark, sf):
    return flags.evaluate(_contexts(spark, sf), _flags(spark), flags.definitions(_entries(spark)), _prefs(spark, sf))


@query
def fnv_bucket(spark, sf):
    ids = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    return ids.select("id", scalars.fnv1a32(F.col("id")).alias("hash"), scalars.bucket(F.col("id"), F.lit("new-checkout")).alias("bucket"))


@query
def flag_eval(spark, sf):
    return _evaluated(spark, sf)


@query
def flag_rules(spark, sf):
    defs = flags.definitions(_entries(spark))
    rows = flags.paired(_contexts(spark, sf), defs)
    return rows.select("id", "flag", flags.first_rule(F.col("rules"), F.col("attributes"), F.col("id")).alias("hit")).filter("hit is not null").select("id", "flag", F.col("hit.index").cast("int").alias("rule"), "hit.value")


@query
def flag_rollout(spark, sf):
    rows = _evaluated(spark, sf).filter(F.col("reason") == "rollout")
    return rows.select("id", "flag", "value")


@query
def flag_snapshot(spark, sf):
    return flags.definitions(_entries(spark)).select("flag", "on", F.size("rules").alias("n_rules"), F.col("rollout.percent").alias("percent"))


@query
def flag_changes(spark, sf):
    before = _entries(spark)
    after = before.filter("key <> 'flags:def:killed'").withColumn("value", F.when(F.col("key") == "flags:def:broken", '{"on": true}').otherwise(F.col("value"))).union(spark.createDataFrame([("flags:def:added", '{"on": true}')], "key string, value string"))
    return flags.changes(before, after)


@query
def flag_openfeature(spark, sf):
    return flags.open_details(_evaluated(spark, sf), _flags(spark))


@query
def flag_open_types(spark, sf):
    kinds = spark.createDataFrame([("new-checkout", "false", "boolean"), ("ai-search", "v0", "string"), ("killed", "{}", "object"), ("unknown", "1", "number"), ("single", "0", "number")], "flag string, default string, kind string")
    contexts = _contexts(spark, sf).withColumn("id", F.when(F.col("id") == "5", "").otherwise(F.col("id")))
    rows = flags.evaluate(contexts, kinds.select("flag", "default"), flags.definitions(_entries(spark)), _prefs(spark, sf), allow_empty=True)
    return flags.typed_details(rows, kinds)


@query
def flag_reason_counts(spark, sf):
    return _evaluated(spark, sf).groupBy("flag", "reason").agg(F.count("*").alias("n"))


@query
def prefs_fold(spark, sf):
    e = timed_events(spark, sf).filter(F.col("event_type").isin("click", "error"))
    flag = F.when(F.col("event_id") % 2 == 0, "a").otherwise("b")
    changed = e.select(F.col("user_id").cast("string").alias("id"), flag.alias("flag"), F.when(F.col("event_type") == "click", F.col("value").cast("string")).alias("value"), "ms", "seq")
    return flags.folded_prefs(changed).select("id", F.array_join(F.transform(F.array_sort(F.map_entries("prefs")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("prefs"))


# -- limits, cache, locks -----------------------------------------------------------


def _calls(spark, sf):
    return timed_events(spark, sf).select(F.col("user_id").cast("string").alias("key"), "ms", "seq")


@query
def rl_fixed(spark, sf):
    return limits.fixed_window(_calls(spark, sf), RL_LIMIT, RL_WINDOW)


@query
def rl_sliding(spark, sf):
    return limits.sliding_window(_calls(spark, sf), RL_LIMIT, RL_WINDOW).select("key", "seq", "allowed")


@query
def rl_token(spark, sf):
    return limits.token_bucket(_calls(spark, sf), RL_CAPACITY, RL_RATE).select("key", "seq", "allowed")


@query
def rl_sliding_full(spark, sf):
    return limits.sliding_window(_calls(spark, sf), RL_LIMIT, RL_WINDOW)


@query
def rl_token_full(spark, sf):
    return limits.token_bucket(_calls(spark, sf), RL_CAPACITY, RL_RATE)


@query
def rl_blockuntil(spark, sf):
    calls = _calls(spark, sf)
    return limits.block_until(limits.fixed_window(calls, RL_LIMIT, RL_WINDOW), calls, HOUR)


@query
def rl_blockfor(spark, sf):
    calls = _calls(spark, sf)
    return limits.block_for(limits.fixed_window(calls, RL_LIMIT, RL_WINDOW), calls)


@query
def rl_token_stream(spark, sf):
    from tidelog.streaming.limits import token_bucket
    from tidelog.streaming.watch import once

    top = _scratch(spark)
    _calls(spark, sf).write.parquet(f"{top}/calls")
    calls = spark.readStream.schema("key string, ms long, seq long").parquet(f"{top}/calls")
    once(token_bucket(calls, RL_CAPACITY, RL_RATE), f"{top}/out", f"{top}/state")
    return spark.read.schema("key string, seq long, allowed boolean, remaining long").parquet(f"{top}/out").select("key", "seq", "allowed")


IP_ROWS = [
    (1, "1.1.1.1", "2.2.2.2", "3.3.3.3, 4.4.4.4", "5.5.5.5"), (2, None, "2.2.2.2", "3.3.3.3", "5.5.5.5"), (3, None, None, " 3.3.3.3 , 4.4.4.4", "5.5.5.5"),
    (4, None, None, None, "5.5.5.5"), (5, None, None, None, None), (6, "", "2.2.2.2", None, None), (7, None, None, "", "5.5.5.5"),
]


@query
def extract_ip(spark, sf):
    rows = spark.createDataFrame(IP_ROWS, "n int, edge string, real string, forwarded string, socket string")
    return rows.select("n", scalars.client_ip(F.col("edge"), F.col("real"), F.col("forwarded"), F.col("socket")).alias("ip"))


def _reads_of(spark, sf):
    return timed_events(spark, sf).filter(F.col("event_type").isin("view", "click")).select(F.concat(F.lit("user:"), F.col("user_id")).alias("key"), "ms", "seq")


@query
def swr_classify(spark, sf):
    return limits.cache_reads(_reads_of(spark, sf), 6 * HOUR, 6 * HOUR)


@query
def lock_grants(spark, sf):
    calls = timed_events(spark, sf).select(F.concat(F.lit("lock:"), F.col("user_id") % 10).alias("key"), "ms", "seq")
    return limits.locks(calls, LEASE)


@query
def lock_release(spark, sf):
    e = timed_events(spark, sf)
    op = F.when(F.col("event_type") == "error", "release").otherwise("acquire")
    calls = e.select(F.concat(F.lit("lock:"), F.col("user_id") % 10).alias("key"), "ms", "seq", op.alias("op"), (F.col("user_id") % 20).cast("string").alias("token"))
    return limits.lock_steps(calls, LEASE)


@query
def cache_sim(spark, sf):
    key = F.concat(F.lit("user:"), F.col("user_id"))
    size = F.octet_length(key) + F.octet_length("props")
    calls = timed_events(spark, sf).select((F.col("user_id") % 4).cast("int").alias("shard"), key.alias("key"), size.cast("long").alias("bytes"), "ms", "seq")
    return limits.cache_hits(calls, CACHE_BYTES).groupBy("shard").agg(F.count("*").alias("reads"), F.count(F.when(F.col("hit"), 1)).alias("hits"))


# -- helpers and metrics ------------------------------------------------------------


@query
def schema_parse(spark, sf):
    e = timed_events(spark, sf)
    parsed = F.from_json("props", "k long")
    return e.select("seq", F.when(F.col("event_type") == "click", parsed["k"]).alias("k"), F.when(F.col("event_type") != "click", F.col("props")).alias("raw"))


@query
def schema_globs(spark, sf):
    n = F.col("event_id")
    value = F.when(n % 11 == 0, "{not json").when(n % 7 == 0, '{"k": "x"}').when(n % 5 == 0, "{}").when(n % 17 != 0, F.col("props"))
    name = F.concat(F.when(F.col("event_type") == "view", "raw:").otherwise("ev:"), F.col("event_type"), F.lit(":"), F.col("user_id") % 10)
    return schemas.parsed(timed_events(spark, sf).select("seq", name.alias("key"), value.alias("value")), SCHEMAS).drop("value")


@query
def parse_integers(spark, sf):
    text = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "+").when(F.col("o_orderkey") % 3 == 1, "-").otherwise(""), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise(""))
    return table(spark, sf, "orders").select("o_orderkey", scalars.parse_long(text).alias("n"))


@query
def ttl_specs(spark, sf):
    n, kind = F.col("o_orderkey"), F.array(*map(F.lit, ("EX", "PX", "EXAT", "PXAT")))[(F.col("o_orderkey") % 4).cast("int")]
    amount = F.when(n % 7 == 0, F.lit(0)).when(kind == "EXAT", F.lit(AS_OF // 1000) + n - 5000).when(kind == "PXAT", F.lit(AS_OF) + n - 5000).otherwise(n)
    url = F.concat(F.lit("a=1&limit="), n, F.lit("&limit=2&flag"))
    big = F.concat(F.lit("1844674407370955"), (n % 9000 + 1000).cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", kind.alias("kind"), scalars.ttl_of(kind, amount, AS_OF).alias("ttl"), scalars.query_param(url, "limit").alias("size"), scalars.query_param(url, "flag").alias("none"), scalars.parse_unsigned(big).cast("string").alias("big"))


@query
def key_codecs(spark, sf):
    key = F.col("key")
    coded = pages(spark, sf).select("key", scalars.base64url(F.encode(key, "UTF-8")).alias("b64"), scalars.percent_encode(key).alias("percent"))
    same = (F.decode(scalars.unbase64url(F.col("b64")), "UTF-8") == F.col("key")) & (scalars.percent_decode(F.col("percent")) == F.col("key"))
    return coded.withColumn("round_trip", same)


@query
def ns_names(spark, sf):
    names = table(spark, sf, "part").select(F.regexp_replace("p_name", " ", "_").alias("a"), F.col("p_type").alias("b"))
    both = names.select(F.col("a").alias("name")).union(names.select(F.col("b").alias("name"))).distinct()
    return both.select("name", scalars.namespace_ok(F.col("name")).alias("ok"))


@query
def ops_total(spark, sf):
    return metrics.totals(_resolved(spark, sf))


@query
def op_histogram(spark, sf):
    return metrics.histogram(table(spark, sf, "events"), "value", [1, 5, 10, 25, 50, 75, 100, 250])


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
