"""The SQL of the catalogue's queries, for a second engine."""

from __future__ import annotations

AS_OF = 1705708800000
SINCE = 1705000000000
HOUR = 3600000

_COMMANDS = """commands AS (
  SELECT 'user:' || user_id AS key, CAST(user_id % 4 AS INTEGER) AS shard, epoch_us(ts) // 1000 AS ms, event_id AS seq,
    CASE event_type WHEN 'purchase' THEN 'SET' WHEN 'signup' THEN 'SETEX' WHEN 'error' THEN 'DEL' WHEN 'view' THEN 'EXPIRE' ELSE 'PERSIST' END AS op,
    CASE WHEN event_type IN ('purchase', 'signup') THEN CAST(value AS VARCHAR) END AS value,
    CASE WHEN event_type = 'signup' THEN props END AS meta,
    CASE WHEN event_type IN ('signup', 'view') THEN epoch_us(ts) // 1000 + 10800000 END AS exp_set
  FROM events)"""

_RESOLVED = f"""{_COMMANDS},
cut AS (SELECT *, SUM(CASE WHEN op IN ('SET', 'SETEX', 'DEL') THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ms, seq ROWS UNBOUNDED PRECEDING) AS segment FROM commands),
lagged AS (SELECT *, COALESCE(LAG(exp_set) OVER (PARTITION BY key, segment ORDER BY ms, seq) <= ms, FALSE) AS late FROM cut),
lived AS (SELECT *,
    segment > 0 AND FIRST_VALUE(op) OVER w <> 'DEL' AND NOT BOOL_OR(late) OVER w AS live,
    FIRST_VALUE(value) OVER w AS head_value, FIRST_VALUE(seq) OVER w AS head_seq, FIRST_VALUE(op) OVER w AS head_op
  FROM lagged WINDOW w AS (PARTITION BY key, segment ORDER BY ms, seq ROWS UNBOUNDED PRECEDING)),
before AS (SELECT *, LAG(exp_set) OVER k AS prior_exp, LAG(head_value) OVER k AS prior_value,
    COALESCE(LAG(live) OVER k AND (LAG(exp_set) OVER k IS NULL OR LAG(exp_set) OVER k > ms), FALSE) AS was_live
  FROM lived WINDOW k AS (PARTITION BY key ORDER BY ms, seq)),
resolved AS (SELECT *, CASE WHEN was_live THEN prior_value END AS was_value, CASE WHEN was_live THEN prior_exp END AS was_exp FROM before)"""

_LOG = f"""{_RESOLVED},
applied AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY shard ORDER BY ms, seq) AS n,
    CASE WHEN op IN ('SET', 'SETEX') THEN 'PUT' WHEN op = 'DEL' THEN 'DEL' ELSE 'TTL' END AS kind
  FROM resolved WHERE op IN ('SET', 'SETEX') OR (was_live AND (op IN ('DEL', 'EXPIRE') OR (op = 'PERSIST' AND was_exp IS NOT NULL)))),
log AS (SELECT shard, key, ms, seq, kind, value, meta, exp_set AS expires_at_ms,
    n + MAX(ms - n) OVER (PARTITION BY shard ORDER BY ms, seq ROWS UNBOUNDED PRECEDING) AS rev FROM applied)"""


def _state(as_of: int, source: str = "log", name: str = "snap") -> str:
    """Snapshot by the records themselves: the last put not followed by a delete, with the last record's expiry."""
    return f"""{name}_rows AS (SELECT *, SUM(CASE WHEN kind <> 'TTL' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ms, seq ROWS UNBOUNDED PRECEDING) AS part FROM {source} WHERE ms <= {as_of}),
{name}_last AS (SELECT *, FIRST_VALUE(kind) OVER p AS head_kind, FIRST_VALUE(value) OVER p AS head_value, FIRST_VALUE(meta) OVER p AS head_meta, FIRST_VALUE(rev) OVER p AS head_rev,
    ROW_NUMBER() OVER (PARTITION BY key ORDER BY ms DESC, seq DESC) AS back
  FROM {name}_rows WINDOW p AS (PARTITION BY key, part ORDER BY ms, seq ROWS UNBOUNDED PRECEDING)),
{name}_all AS (SELECT key, shard, head_value AS value, head_meta AS meta, head_rev AS rev, expires_at_ms FROM {name}_last WHERE back = 1 AND head_kind = 'PUT'),
{name} AS (SELECT * FROM {name}_all WHERE expires_at_ms IS NULL OR expires_at_ms > {as_of})"""


_SNAP = f"{_LOG},\n{_state(AS_OF)}"
_REQUESTS = "requests AS (SELECT i AS pos, 'user:' || CASE WHEN i < 200 THEN 199 - i ELSE i - 200 END AS key FROM range(250) r(i))"
_SNAP_REQ = f"{_SNAP},\n{_REQUESTS}"
_EXPECTED = f"{_SNAP_REQ},\nattempts AS (SELECT pos, key, COALESCE(rev, 0) - pos % 2 AS expected_rev FROM requests LEFT JOIN snap USING (key))"
_COUNTERS = """counters AS (
  SELECT 'cnt:' || user_id AS key, epoch_us(ts) // 1000 AS ms, event_id AS seq, CASE WHEN event_type = 'error' THEN 'DEL' ELSE 'INCR' END AS op,
    CASE WHEN event_type = 'click' THEN 1 WHEN event_type = 'purchase' THEN CAST(FLOOR(value) AS BIGINT) END AS delta
  FROM events WHERE event_type IN ('click', 'purchase', 'error')),
parted AS (SELECT *, SUM(CASE WHEN op = 'DEL' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ms, seq ROWS UNBOUNDED PRECEDING) AS part FROM counters),
counted AS (SELECT key, ms, seq, op, CASE WHEN op = 'INCR' THEN CAST(SUM(delta) OVER (PARTITION BY key, part ORDER BY ms, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS value FROM parted)"""
_PAGES = "kv AS (SELECT url AS key, html AS value, CAST(page_id % 4 AS INTEGER) AS shard FROM pages)"
_LEFT_MS = f"CAST(CASE WHEN rev IS NULL THEN -2 WHEN expires_at_ms IS NULL THEN -1 ELSE expires_at_ms - {AS_OF} END AS BIGINT)"
_LEFT_S = f"CAST(CASE WHEN rev IS NULL THEN -2 WHEN expires_at_ms IS NULL THEN -1 ELSE (expires_at_ms - {AS_OF}) // 1000 END AS BIGINT)"
_BLOBS = "(SELECT sha256(text) AS hash, COUNT(*) AS refs, CAST(MAX(strlen(text)) AS BIGINT) AS bytes FROM documents WHERE length(text) >= 2000 {more} GROUP BY 1)"


def _compared(where: str) -> str:
    return f"""WITH {_EXPECTED},
tested AS (SELECT a.pos, a.key, a.expected_rev, s.rev, COALESCE(s.rev = a.expected_rev, FALSE) AS hit FROM attempts a LEFT JOIN snap s ON a.key = s.key WHERE {where}),
nth AS (SELECT *, SUM(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY pos ROWS UNBOUNDED PRECEDING) AS k FROM tested)
SELECT pos, key, expected_rev, CASE WHEN rev IS NULL THEN 'nil' WHEN hit AND k = 1 THEN 'ok' ELSE 'conflict' END AS result FROM nth"""


_FNV = "list_reduce([2166136261::BIGINT] || list_transform(range(1, length({s}) + 1), lambda i: ascii(substr({s}, i::INT, 1))::BIGINT), lambda h, x: (xor(h, x) * 16777619) % 4294967296)"
_BUCKET = "(" + _FNV.format(s="(id || ':' || flag)") + " % 100)"
_EVAL = f"""asked(flag, dflt, state, percent, rolled) AS (VALUES ('new-checkout', 'false', 'on', 30, 'true'), ('ai-search', 'v0', 'on', 10, 'v1'), ('killed', 'false', 'off', 100, 'true'), ('unknown', 'false', NULL, NULL, NULL), ('single', 's0', 'on', NULL, NULL)),
contexts AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS segment, c_custkey % 50 = 0 AS has_pref, c_acctbal < 0 AS has_override, c_nationkey AS nation FROM customer),
numbered AS (SELECT *, CASE WHEN (flag = 'new-checkout' AND segment = 'BUILDING') OR (flag = 'ai-search' AND segment IN ('MACHINERY', 'FURNITURE')) OR flag = 'killed' THEN 0
    WHEN flag = 'single' THEN CASE WHEN segment = 'HOUSEHOLD' THEN 0 WHEN id = '7' THEN 1 WHEN id IN ('8', '9') AND nation = 3 THEN 2 WHEN id IN ('10', '11', '12') THEN 3 END END AS hit FROM contexts, asked),
pairs AS (SELECT *, hit IS NOT NULL AS ruled FROM numbered),
reasoned AS (SELECT *, CASE WHEN state = 'off' THEN 'off' WHEN has_pref AND flag = 'new-checkout' THEN 'user-pref' WHEN has_override AND flag = 'ai-search' THEN 'override'
    WHEN state IS NULL THEN 'no-snapshot' WHEN ruled THEN 'rule' WHEN {_BUCKET} < percent THEN 'rollout' ELSE 'default' END AS reason FROM pairs),
evaluated AS (SELECT id, flag, dflt, reason, CASE reason WHEN 'user-pref' THEN 'pref' WHEN 'override' THEN 'v9' WHEN 'rule' THEN CASE flag WHEN 'new-checkout' THEN 'true' WHEN 'single' THEN (['12', 'seven', '{{}}', '13.5'])[hit + 1] ELSE 'v2' END
    WHEN 'rollout' THEN rolled ELSE dflt END AS value, CASE WHEN reason = 'rule' THEN hit END AS rule FROM reasoned)"""
_EVAL_TYPED = (
    _EVAL.replace("('new-checkout', 'false', 'on', 30, 'true'), ('ai-search', 'v0', 'on', 10, 'v1'), ('killed', 'false', 'off', 100, 'true'), ('unknown', 'false', NULL, NULL, NULL), ('single', 's0', 'on', NULL, NULL)", "('new-checkout', 'false', 'on', 30, 'true'), ('ai-search', 'v0', 'on', 10, 'v1'), ('killed', '{}', 'off', 100, 'true'), ('unknown', '1', NULL, NULL, NULL), ('single', '0', 'on', NULL, NULL)")
    .replace("SELECT CAST(c_custkey AS VARCHAR) AS id,", "SELECT CASE WHEN c_custkey = 5 THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS id,")
    + """,
typed AS (SELECT *, CASE WHEN flag = 'new-checkout' THEN value IN ('true', 'false') WHEN flag = 'ai-search' THEN value IS NOT NULL WHEN flag = 'killed' THEN value LIKE '{%' ELSE regexp_full_match(value, '-?[0-9]+([.][0-9]+)?') END AS good FROM evaluated)"""
)
_CALLS = "calls AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) // 1000 AS ms, event_id AS seq, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events)"
_FIXED = f"""{_CALLS},
numbered AS (SELECT *, ms // 21600000 AS b, ROW_NUMBER() OVER (PARTITION BY key, ms // 21600000 ORDER BY ms, seq) AS k FROM calls)"""


def _fold(calls: str, first: str, step: str, columns: str, out: str) -> str:
    """A recursion over each key's rows in order."""
    return f"""WITH RECURSIVE {calls},
f AS (SELECT key, seq, n, ms, {first} FROM calls WHERE n = 1
  UNION ALL SELECT key, seq, n, ms, {columns} FROM (SELECT c.key, c.seq, c.n, c.ms, {step} FROM f r JOIN calls c ON c.key = r.key AND c.n = r.n + 1))
SELECT key, seq, {out} FROM f"""


_SLIDING = _fold(
    _CALLS,
    "ms // 21600000 AS b, 1 AS cur, 0 AS prev, TRUE AS allowed",
    """c.ms // 21600000 AS b, CASE WHEN c.ms // 21600000 = r.b THEN r.cur ELSE 0 END AS c0,
     CASE WHEN c.ms // 21600000 = r.b THEN r.prev WHEN c.ms // 21600000 = r.b + 1 THEN r.cur ELSE 0 END AS p0""",
    "b, c0 + CASE WHEN p0 * (1.0::DOUBLE - (ms % 21600000)::DOUBLE / 21600000::DOUBLE) + (c0 + 1) <= 3 THEN 1 ELSE 0 END AS cur, p0 AS prev, p0 * (1.0::DOUBLE - (ms % 21600000)::DOUBLE / 21600000::DOUBLE) + (c0 + 1) <= 3 AS allowed",
    "allowed",
)
_TOKEN = _fold(
    _CALLS,
    "2.0::DOUBLE AS tokens, ms AS last, TRUE AS allowed",
    "r.tokens AS t0, r.last AS l0, LEAST(3.0::DOUBLE, r.tokens + (c.ms - r.last)::DOUBLE / 1000.0::DOUBLE * 0.00005::DOUBLE) AS t",
    "CASE WHEN t >= 1 THEN t - 1 ELSE t0 END AS tokens, CASE WHEN t >= 1 THEN ms ELSE l0 END AS last, t >= 1 AS allowed",
    "allowed",
)
_EST = "(p0 * (1.0::DOUBLE - (ms % 21600000)::DOUBLE / 21600000::DOUBLE) + (c0 + 1))"
_SLIDING_FULL = _fold(
    _CALLS,
    "ms // 21600000 AS b, 1 AS cur, 0 AS prev, TRUE AS allowed, CAST(2 AS BIGINT) AS remaining, CAST(NULL AS BIGINT) AS wait",
    """c.ms // 21600000 AS b, CASE WHEN c.ms // 21600000 = r.b THEN r.cur ELSE 0 END AS c0,
     CASE WHEN c.ms // 21600000 = r.b THEN r.prev WHEN c.ms // 21600000 = r.b + 1 THEN r.cur ELSE 0 END AS p0""",
    f"""b, c0 + CASE WHEN {_EST} <= 3 THEN 1 ELSE 0 END AS cur, p0 AS prev, {_EST} <= 3 AS allowed, CAST(CASE WHEN {_EST} <= 3 THEN GREATEST(0, 3 - FLOOR({_EST})) ELSE 0 END AS BIGINT) AS remaining,
     CAST(CASE WHEN {_EST} > 3 THEN CASE WHEN p0 > 0 THEN CEIL(({_EST} - 3) / p0 * 21600000) ELSE (b + 1) * 21600000 - ms + 21600000 END END AS BIGINT) AS wait""",
    "allowed, remaining, CAST((b + 1) * 21600000 AS BIGINT) AS reset_ms, wait AS retry_after_ms",
)
_TOKEN_FULL = _fold(
    _CALLS,
    "2.0::DOUBLE AS tokens, ms AS last, TRUE AS allowed, 3.0::DOUBLE AS had",
    "r.tokens AS t0, r.last AS l0, LEAST(3.0::DOUBLE, r.tokens + (c.ms - r.last)::DOUBLE / 1000.0::DOUBLE * 0.00005::DOUBLE) AS t",
    "CASE WHEN t >= 1 THEN t - 1 ELSE t0 END AS tokens, CASE WHEN t >= 1 THEN ms ELSE l0 END AS last, t >= 1 AS allowed, t AS had",
    "allowed, CAST(CASE WHEN allowed THEN FLOOR(had - 1) ELSE 0 END AS BIGINT) AS remaining, CAST(CASE WHEN allowed THEN ms + 20000000 ELSE ms + CEIL((1 - had) / 0.00005::DOUBLE * 1000) END AS BIGINT) AS reset_ms, CAST(CASE WHEN NOT allowed THEN CEIL((1 - had) / 0.00005::DOUBLE * 1000) END AS BIGINT) AS retry_after_ms",
)
_RELEASE = _fold(
    """calls AS (SELECT 'lock:' || user_id % 10 AS key, epoch_us(ts) // 1000 AS ms, event_id AS seq, CASE WHEN event_type = 'error' THEN 'release' ELSE 'acquire' END AS op, CAST(user_id % 20 AS VARCHAR) AS token,
     ROW_NUMBER() OVER (PARTITION BY user_id % 10 ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events)""",
    "op, CASE WHEN op = 'acquire' THEN token END AS holder, CASE WHEN op = 'acquire' THEN ms + 1800000 ELSE 0 END AS until, op = 'acquire' AS done",
    "c.op, c.token, r.holder AS h0, r.until AS u0, r.until > c.ms AS held",
    """op, CASE WHEN op = 'acquire' THEN CASE WHEN held THEN h0 ELSE token END WHEN held AND h0 = token THEN NULL ELSE h0 END AS holder,
     CASE WHEN op = 'acquire' THEN CASE WHEN held THEN u0 ELSE ms + 1800000 END WHEN held AND h0 = token THEN 0 ELSE u0 END AS until,
     CASE WHEN op = 'acquire' THEN NOT held ELSE held AND h0 = token END AS done""",
    "op, done",
)
_KV = """WITH RECURSIVE named AS (SELECT *, (['SET', 'SET', 'SET', 'SET', 'SET', 'SET', 'INCR', 'DEL', 'EXPIRE', 'SET', 'SET', 'PERSIST', 'DELREV', 'GET', 'INCR'])[CAST(event_id * 7 % 15 AS INTEGER) + 1] AS op, event_id * 7 % 15 AS k, epoch_us(ts) // 1000 AS ms FROM events),
stream AS (SELECT 'ns' || user_id % 2 AS ns, 'k' || user_id % 40 AS key, ms, event_id AS seq, op, k,
    CASE WHEN op = 'INCR' THEN CAST(event_id % 5 + 1 AS VARCHAR) WHEN op = 'SET' THEN CASE WHEN event_id % 29 = 0 THEN '9223372036854775807' WHEN event_id % 3 = 0 THEN 'v' || event_id ELSE CAST(CAST(FLOOR(value) AS BIGINT) AS VARCHAR) END END AS value,
    CASE WHEN k IN (1, 4) THEN 10800000 WHEN op = 'EXPIRE' THEN 97200000 WHEN k = 10 THEN 0 END AS ttl,
    CASE k WHEN 3 THEN 'NX' WHEN 4 THEN 'XX' WHEN 9 THEN 'REV' END AS cond,
    CASE WHEN k IN (1, 5) AND event_id % 4 <> 0 THEN props END AS meta,
    ROW_NUMBER() OVER s + MAX(ms - nth) OVER (PARTITION BY user_id % 4 ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS rev
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id % 4 ORDER BY ms, event_id) AS nth FROM named) WINDOW s AS (PARTITION BY user_id % 4 ORDER BY ms, event_id)),
calls AS (SELECT *, CASE WHEN cond = 'REV' OR op = 'DELREV' THEN LAG(rev) OVER w - CASE WHEN seq % 5 = 0 THEN 1 ELSE 0 END END AS wanted, ROW_NUMBER() OVER w AS n FROM stream WINDOW w AS (PARTITION BY ns, key ORDER BY ms, seq)),
f AS (SELECT ns, key, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS op, CAST(NULL AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS cond, CAST(NULL AS BIGINT) AS wanted, CAST(NULL AS BIGINT) AS ms, CAST(NULL AS BIGINT) AS rev,
    CAST(NULL AS VARCHAR) AS v, CAST(NULL AS VARCHAR) AS m, CAST(NULL AS BIGINT) AS e, CAST(NULL AS BIGINT) AS r, CAST(NULL AS VARCHAR) AS result, CAST(NULL AS VARCHAR) AS kind
  FROM calls WHERE n = 1
  UNION ALL
  SELECT ns, key, n, seq, op, k, cond, wanted, ms, rev,
    CASE WHEN kind = 'PUT' THEN CASE WHEN op = 'INCR' THEN result ELSE value END WHEN kind = 'DEL' THEN NULL ELSE v0 END,
    CASE WHEN kind = 'PUT' THEN CASE WHEN op = 'SET' AND k <> 5 THEN meta END WHEN kind = 'DEL' THEN NULL ELSE m0 END,
    CASE WHEN kind = 'PUT' THEN CASE WHEN op = 'INCR' THEN CASE WHEN live THEN e0 END WHEN k = 5 THEN NULL WHEN k = 2 THEN e0 ELSE ms + ttl END WHEN kind = 'DEL' THEN NULL WHEN kind = 'TTL' THEN CASE WHEN op = 'EXPIRE' THEN ms + ttl END ELSE e0 END,
    CASE WHEN kind = 'PUT' THEN rev WHEN kind = 'DEL' THEN NULL ELSE r0 END, result, kind
  FROM (SELECT *, CASE WHEN op = 'SET' AND result NOT IN ('nil', 'conflict', 'error: invalid expiry') THEN 'PUT' WHEN k = 5 THEN 'PUT' WHEN op = 'INCR' AND NOT starts_with(result, 'error') THEN 'PUT'
      WHEN op IN ('DEL', 'DELREV') AND result = '1' THEN 'DEL' WHEN op IN ('EXPIRE', 'PERSIST') AND result = '1' THEN 'TTL' END AS kind
    FROM (SELECT *, CASE
        WHEN op = 'GET' THEN COALESCE(old, 'nil') WHEN op IN ('DEL', 'EXPIRE') THEN CASE WHEN live THEN '1' ELSE '0' END WHEN op = 'PERSIST' THEN CASE WHEN live AND e0 IS NOT NULL THEN '1' ELSE '0' END
        WHEN op = 'INCR' THEN CASE WHEN NOT regexp_full_match(COALESCE(old, '0'), '[+-]?[0-9]+') THEN 'error: not an integer' WHEN TRY_CAST(COALESCE(old, '0') AS HUGEINT) + CAST(value AS BIGINT) > 9223372036854775807 THEN 'error: overflow' ELSE CAST(TRY_CAST(COALESCE(old, '0') AS HUGEINT) + CAST(value AS BIGINT) AS VARCHAR) END
        WHEN op = 'DELREV' THEN CASE WHEN NOT live THEN 'nil' WHEN r0 = wanted THEN '1' ELSE 'conflict' END
        WHEN k = 10 THEN 'error: invalid expiry' WHEN cond = 'REV' THEN CASE WHEN NOT live THEN 'nil' WHEN r0 = wanted THEN CAST(rev AS VARCHAR) ELSE 'conflict' END
        WHEN cond = 'NX' AND live OR cond = 'XX' AND NOT live THEN 'nil' WHEN k = 5 THEN COALESCE(old, 'nil') ELSE 'ok' END AS result
      FROM (SELECT c.*, p.v AS v0, p.m AS m0, p.e AS e0, p.r AS r0, p.v IS NOT NULL AND (p.e IS NULL OR p.e > c.ms) AS live, CASE WHEN p.v IS NOT NULL AND (p.e IS NULL OR p.e > c.ms) THEN p.v END AS old
        FROM f p JOIN calls c ON c.ns = p.ns AND c.key = p.key AND c.n = p.n + 1)))),
done AS (SELECT ns, key, ms, seq, op, k, cond, wanted AS expected_rev, result, kind, CASE WHEN kind = 'PUT' THEN v END AS new_value, CASE WHEN kind = 'PUT' THEN m END AS new_meta, CASE WHEN kind IN ('PUT', 'TTL') THEN e END AS expires_at_ms, CASE WHEN kind IS NOT NULL THEN rev END AS new_rev, n, v, m, e, r FROM f WHERE n > 0)"""
_BATCHES = """WITH ops AS (SELECT event_id // 8 AS batch, event_id % 8 AS pos, 'b:' || user_id % 3 AS key, (['setnx', 'set', 'get', 'delete', 'setnx'])[CAST(user_id % 5 AS INTEGER) + 1] AS op FROM events),
prior AS (SELECT o.*, COALESCE((SELECT arg_max(p.op, p.pos) FROM ops p WHERE p.batch = o.batch AND p.key = o.key AND p.pos < o.pos AND p.op <> 'get') IN ('set', 'setnx'), FALSE) AS there FROM ops o),
stops AS (SELECT batch, MIN(pos) AS stop FROM prior WHERE op = 'setnx' AND there GROUP BY batch)
SELECT batch, pos, key, op, CASE WHEN pos > stop THEN 'skipped' WHEN pos = stop THEN 'conflict' WHEN op IN ('set', 'setnx') THEN 'ok' WHEN op = 'delete' THEN CASE WHEN there THEN '1' ELSE '0' END WHEN there THEN 'found' ELSE 'nil' END AS result FROM prior LEFT JOIN stops USING (batch)"""
_SWR = _fold(
    "calls AS (SELECT 'user:' || user_id AS key, epoch_us(ts) // 1000 AS ms, event_id AS seq, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events WHERE event_type IN ('view', 'click'))",
    "ms AS stored, 'miss' AS outcome",
    "r.stored AS s0",
    "CASE WHEN s0 + 21600000 <= ms THEN ms ELSE s0 END AS stored, CASE WHEN s0 + 43200000 <= ms THEN 'miss' WHEN s0 + 21600000 <= ms THEN 'stale' ELSE 'fresh' END AS outcome",
    "outcome",
)
_LOCK = _fold(
    "calls AS (SELECT 'lock:' || user_id % 10 AS key, epoch_us(ts) // 1000 AS ms, event_id AS seq, ROW_NUMBER() OVER (PARTITION BY user_id % 10 ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events)",
    "ms + 1800000 AS held, TRUE AS granted",
    "r.held AS h0",
    "CASE WHEN h0 <= ms THEN ms + 1800000 ELSE h0 END AS held, h0 <= ms AS granted",
    "granted",
)
_REPLAY = "SELECT CASE WHEN kind = 'PUT' THEN 'set' ELSE 'del' END AS type, key, value, expires_at_ms, rev FROM log WHERE kind <> 'TTL'"
_IP = "ips(n, edge, \"real\", forwarded, socket) AS (VALUES (1, '1.1.1.1', '2.2.2.2', '3.3.3.3, 4.4.4.4', '5.5.5.5'), (2, NULL, '2.2.2.2', '3.3.3.3', '5.5.5.5'), (3, NULL, NULL, ' 3.3.3.3 , 4.4.4.4', '5.5.5.5'), (4, NULL, NULL, NULL, '5.5.5.5'), (5, NULL, NULL, NULL, NULL), (6, '', '2.2.2.2', NULL, NULL), (7, NULL, NULL, '', '5.5.5.5'))"
_BATCH = """ops AS (SELECT event_id AS pos, 'b:' || user_id % 7 AS key, (['get', 'set', 'delete', 'incr', 'exists'])[CAST(event_id % 5 AS INTEGER) + 1] AS op,
    CASE event_id % 5 WHEN 1 THEN CAST(FLOOR(value) AS BIGINT) WHEN 3 THEN 1 END AS value FROM events),
part AS (SELECT *, SUM(CASE WHEN op IN ('set', 'delete') THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY pos ROWS UNBOUNDED PRECEDING) AS p FROM ops),
sums AS (SELECT *, MAX(CASE WHEN op = 'set' THEN value END) OVER w AS base, CAST(SUM(CASE WHEN op = 'incr' THEN value END) OVER w AS BIGINT) AS added FROM part WINDOW w AS (PARTITION BY key, p ORDER BY pos ROWS UNBOUNDED PRECEDING)),
nows AS (SELECT *, CASE WHEN base IS NOT NULL OR added IS NOT NULL THEN COALESCE(base, 0) + COALESCE(added, 0) END AS now FROM sums),
was AS (SELECT *, LAG(now) OVER (PARTITION BY key ORDER BY pos) AS was FROM nows)"""
_GLOB_REGEX = {"https://m.*": r"^https://m\..*$", "http://*": r"^http://.*$", "*.html": r"^.*\.html$", "https://[bm]*": r"^https://[bm].*$", "*/en/?*": r"^.*/en/..*$"}


_GLOBBED = """WITH e AS (
  SELECT event_id AS seq, CASE event_type WHEN 'view' THEN 'raw:' ELSE 'ev:' END || event_type || ':' || user_id % 10 AS key,
    CASE WHEN event_id % 11 = 0 THEN '{not json' WHEN event_id % 7 = 0 THEN '{"k": "x"}' WHEN event_id % 5 = 0 THEN '{}' WHEN event_id % 17 <> 0 THEN props END AS value
  FROM events),
s AS (SELECT *, CASE WHEN key LIKE 'ev:%:7' THEN 'ev:*:7' WHEN key LIKE 'ev:c%' THEN 'ev:c*' WHEN key LIKE 'ev:%' THEN 'ev:*' END AS schema,
    CASE WHEN json_valid(value) THEN json_extract_string(value, '$.k') END AS k FROM e),
t AS (SELECT *, CASE WHEN value IS NOT NULL AND schema IS NOT NULL AND (NOT json_valid(value)
      OR (schema <> 'ev:*' AND k IS NOT NULL AND TRY_CAST(k AS BIGINT) IS NULL) OR (schema = 'ev:*:7' AND k IS NULL)) THEN 'schema_error' END AS error FROM s)
SELECT seq, key, schema, error, CASE WHEN schema IS NULL THEN value WHEN value IS NULL OR error IS NOT NULL THEN NULL
  WHEN k IS NULL THEN '{}' WHEN schema = 'ev:*' THEN '{"k":"' || k || '"}' ELSE '{"k":' || k || '}' END AS data FROM t"""


def oracle_sql() -> dict[str, str]:
    snap, req = f"WITH {_SNAP}", f"WITH {_SNAP_REQ}"
    joined = "FROM requests LEFT JOIN snap USING (key)"
    return {
        "get": f"{snap} SELECT key, value FROM snap WHERE key = 'user:12'",
        "get_with_headers": f"{snap} SELECT key, value, {_LEFT_S} AS ttl_s, {_LEFT_MS} AS ttl_ms, rev, meta FROM snap",
        "mget": f"{req} SELECT pos, key, value {joined}",
        "exists_count": f"{req} SELECT COUNT(*) AS n FROM requests WHERE key IN (SELECT key FROM snap)",
        "ttl": f"{req} SELECT pos, key, {_LEFT_S} AS ttl {joined}",
        "pttl": f"{req} SELECT pos, key, {_LEFT_MS} AS pttl {joined}",
        "revision": f"{req} SELECT pos, key, CAST(COALESCE(rev, -2) AS BIGINT) AS rev {joined}",
        "getmeta": f"{req} SELECT pos, key, meta {joined}",
        "dbsize": f"{snap} SELECT COUNT(*) AS n FROM snap_all",
        "ns_isolation": "SELECT 'default' AS ns, COUNT(DISTINCT user_id) AS keys, COUNT(*) AS commands FROM events UNION ALL SELECT 'db1', COUNT(DISTINCT user_id), COUNT(*) FROM events WHERE event_type IN ('click', 'purchase', 'error')",
        "keys_glob": f"WITH {_PAGES} " + " UNION ALL ".join(f"SELECT '{p}' AS pattern, key FROM kv WHERE regexp_matches(key, '{r}', 's')" for p, r in _GLOB_REGEX.items()),
        "scan_page": f"WITH {_PAGES} SELECT key FROM kv WHERE key > 'https://b' ORDER BY key LIMIT 50",
        "scan_match": f"WITH {_PAGES} SELECT key FROM kv WHERE key LIKE '%.html' ORDER BY key LIMIT 20",
        "scan_cursor": f"WITH {_PAGES}, page AS (SELECT key FROM kv WHERE regexp_matches(key, '^https://[bm]') ORDER BY key LIMIT 20) SELECT CASE WHEN COUNT(*) >= 20 THEN MAX(key) END AS cursor, COUNT(*) AS n FROM page",
        "list_prefix": f"WITH {_PAGES} SELECT key FROM kv WHERE starts_with(key, 'https://blog.') ORDER BY key LIMIT 30",
        "scan_sharded": f"WITH {_PAGES} SELECT shard, key FROM kv WHERE shard > 1 OR (shard = 1 AND key > 'https://m') ORDER BY shard, key LIMIT 60",
        "set_apply": f"WITH {_COMMANDS} SELECT key, ms, seq, value, meta, exp_set AS expires_at_ms FROM commands WHERE op IN ('SET', 'SETEX')",
        "setnx": f"{snap}, attempts AS (SELECT i AS pos, 'user:' || i % 300 AS key FROM range(400) r(i)) SELECT pos, key, CASE WHEN key NOT IN (SELECT key FROM snap) AND ROW_NUMBER() OVER (PARTITION BY key ORDER BY pos) = 1 THEN 1 ELSE 0 END AS result FROM attempts",
        "setxx": f"{snap}, attempts AS (SELECT i AS pos, 'user:' || i % 300 AS key, 'new' || i AS value FROM range(400) r(i)) SELECT * FROM attempts WHERE key IN (SELECT key FROM snap)",
        "getset": f"WITH {_RESOLVED} SELECT key, seq, value, was_value AS old_value FROM resolved WHERE op IN ('SET', 'SETEX')",
        "getdel": f"WITH {_RESOLVED} SELECT key, seq, was_value AS old_value FROM resolved WHERE op = 'DEL'",
        "getex": f"{req} SELECT pos, key, value, CASE WHEN rev IS NOT NULL THEN {AS_OF + HOUR} END AS expires_at_ms {joined}",
        "del_count": f"{req} SELECT COUNT(DISTINCT key) AS n FROM requests WHERE key IN (SELECT key FROM snap)",
        "del_state": f"{req} SELECT key, value FROM snap WHERE key NOT IN (SELECT key FROM requests WHERE pos % 3 = 0)",
        "delrev": _compared("a.pos < 200"),
        "cas_apply": _compared("TRUE"),
        "expire_apply": f"WITH {_RESOLVED} SELECT key, seq, CASE WHEN was_live THEN 1 ELSE 0 END AS result, CASE WHEN was_live THEN exp_set END AS expires_at_ms FROM resolved WHERE op = 'EXPIRE'",
        "expireat_apply": f"{req}, timed AS (SELECT *, {AS_OF} + (pos % 5 - 2) * {HOUR} AS at_ms FROM requests) SELECT pos, key, at_ms, CASE WHEN at_ms <= {AS_OF} THEN 'DEL' WHEN rev IS NOT NULL THEN 'TTL' END AS kind, CASE WHEN at_ms <= {AS_OF} OR rev IS NOT NULL THEN 1 ELSE 0 END AS result FROM timed LEFT JOIN snap USING (key)",
        "persist_apply": f"WITH {_RESOLVED} SELECT key, seq, CASE WHEN was_exp IS NOT NULL THEN 1 ELSE 0 END AS result FROM resolved WHERE op = 'PERSIST'",
        "incr_running": f"WITH {_COUNTERS} SELECT * FROM counted",
        "incr_final": f"WITH {_COUNTERS}, lasts AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY key ORDER BY ms DESC, seq DESC) AS back FROM counted) SELECT key, value FROM lasts WHERE back = 1 AND value IS NOT NULL",
        "mset": "SELECT 'user:' || user_id AS key, CAST(arg_max(value, event_id) AS VARCHAR) AS value, CAST(NULL AS BIGINT) AS expires_at_ms FROM events WHERE event_type = 'purchase' GROUP BY user_id",
        "batch_mixed": f"WITH {_BATCH} SELECT pos, key, op, CASE op WHEN 'set' THEN 'ok' WHEN 'delete' THEN CASE WHEN was IS NOT NULL THEN '1' ELSE '0' END WHEN 'exists' THEN CASE WHEN now IS NOT NULL THEN '1' ELSE '0' END ELSE COALESCE(CAST(now AS VARCHAR), 'nil') END AS result FROM was",
        "log_records": f"WITH {_LOG} SELECT shard, rev, key, CAST((CASE WHEN kind = 'DEL' THEN 1 ELSE 0 END) + (CASE WHEN expires_at_ms IS NULL THEN 2 ELSE 0 END) + (CASE WHEN kind = 'TTL' THEN 4 ELSE 0 END) AS INTEGER) AS flags, CAST(37 + strlen(key) + COALESCE(strlen(value), 0) + COALESCE(strlen(meta), 0) AS BIGINT) AS bytes FROM log",
        "log_append": f"WITH {_LOG} SELECT shard, kind, COUNT(*) AS n, MAX(rev) AS last_rev FROM log GROUP BY 1, 2",
        "recover_state": f"WITH {_LOG},\n{_state(1 << 60)} SELECT key, value, rev, expires_at_ms FROM snap",
        "recover_truncated": f"WITH {_LOG}, good AS (SELECT * EXCLUDE (bad) FROM (SELECT *, MAX(CASE WHEN seq % 1999 = 1998 THEN 1 ELSE 0 END) OVER (PARTITION BY shard ORDER BY rev ROWS UNBOUNDED PRECEDING) AS bad FROM log) WHERE bad = 0),\n{_state(AS_OF, 'good')} SELECT key, value, rev FROM snap",
        "compact_live": f"{snap} SELECT shard, key, value, meta, expires_at_ms, rev FROM snap",
        "compact_resume": f"{snap} SELECT shard, key, value, meta, expires_at_ms, rev FROM snap",
        "compact_stats": f"{snap}, t AS (SELECT shard, COUNT(*) AS records FROM log WHERE ms <= {AS_OF} GROUP BY 1), l AS (SELECT shard, COUNT(*) AS live FROM snap GROUP BY 1) SELECT shard, records, COALESCE(live, 0) AS live, ROUND(1 - COALESCE(live, 0)::DOUBLE / records, 6) AS dead_share FROM t LEFT JOIN l USING (shard)",
        "blob_dedup": "SELECT * FROM " + _BLOBS.format(more=""),
        "blob_orphans": "SELECT * FROM " + _BLOBS.format(more="") + " WHERE hash NOT IN (SELECT hash FROM " + _BLOBS.format(more="AND doc_id % 2 = 0") + ")",
        "flush_events": f"{snap} SELECT 'del' AS type, key, CAST({AS_OF} AS BIGINT) AS rev FROM snap",
        "watch_since": f"WITH {_LOG} {_REPLAY} AND rev > {SINCE}",
        "watch_prefix_since": f"WITH {_LOG} {_REPLAY} AND rev > {SINCE} AND starts_with(key, 'user:1')",
        "watch_initial": f"{snap} SELECT 'set' AS type, key, value, expires_at_ms, rev FROM snap",
        "watch_stream": f"WITH {_LOG} {_REPLAY} AND rev > {SINCE}",
        "sse_events": f"WITH {_LOG}, e AS ({_REPLAY} AND rev > {SINCE} AND starts_with(key, 'user:2')) SELECT key, rev, '{{\"type\":\"' || type || '\",\"key\":\"' || key || '\",\"rev\":' || rev || '}}' AS data FROM e",
        "fnv_bucket": f"WITH ids AS (SELECT CAST(c_custkey AS VARCHAR) AS id, 'new-checkout' AS flag FROM customer) SELECT id, {_FNV.format(s='id')} AS hash, {_BUCKET} AS bucket FROM ids",
        "flag_eval": f"WITH {_EVAL} SELECT id, flag, value, reason, rule FROM evaluated",
        "flag_rules": "SELECT CAST(c_custkey AS VARCHAR) AS id, 'new-checkout' AS flag, 0 AS rule, 'true' AS value FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'ai-search', 0, 'v2' FROM customer WHERE c_mktsegment IN ('MACHINERY', 'FURNITURE') UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'killed', 0, 'true' FROM customer UNION ALL SELECT * FROM (SELECT CAST(c_custkey AS VARCHAR) AS id, 'single' AS flag, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 0 WHEN c_custkey = 7 THEN 1 WHEN c_custkey IN (8, 9) AND c_nationkey = 3 THEN 2 WHEN c_custkey IN (10, 11, 12) THEN 3 END AS rule, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN '12' WHEN c_custkey = 7 THEN 'seven' WHEN c_custkey IN (8, 9) AND c_nationkey = 3 THEN '{}' WHEN c_custkey IN (10, 11, 12) THEN '13.5' END AS value FROM customer) WHERE rule IS NOT NULL",
        "flag_rollout": f"WITH {_EVAL} SELECT id, flag, value FROM evaluated WHERE reason = 'rollout'",
        "flag_snapshot": "SELECT * FROM (VALUES ('new-checkout', TRUE, 1, 30.0::DOUBLE), ('ai-search', TRUE, 1, 10.0::DOUBLE), ('killed', FALSE, 1, 100.0::DOUBLE), ('single', TRUE, 4, NULL)) t(flag, \"on\", n_rules, percent)",
        "flag_changes": "SELECT * FROM (VALUES ('flags:def:added', 'added'), ('flags:def:killed', 'removed'), ('flags:def:broken', 'changed')) t(key, change)",
        "flag_openfeature": f"WITH {_EVAL} SELECT id, flag, CASE WHEN value IN ('true', 'false') THEN value ELSE dflt END AS value, CASE WHEN value NOT IN ('true', 'false') THEN 'ERROR' WHEN reason = 'off' THEN 'DISABLED' WHEN reason IN ('rule', 'user-pref', 'override') THEN 'TARGETING_MATCH' WHEN reason = 'rollout' THEN 'SPLIT' ELSE 'DEFAULT' END AS reason FROM evaluated",
        "kv_apply": f"{_KV} SELECT ns, key, seq, op, result, kind, new_value, new_meta, expires_at_ms, new_rev FROM done",
        "set_options": f"{_KV} SELECT cond, k = 2 AS keep_ttl, k = 5 AS get_old, regexp_replace(result, '[0-9.]+', '#', 'g') AS outcome, COUNT(*) AS n, COUNT(expires_at_ms) AS with_expiry, COUNT(new_meta) AS with_meta FROM done WHERE op = 'SET' GROUP BY 1, 2, 3, 4",
        "incr_stored": f"{_KV} SELECT ns, key, seq, result, expires_at_ms FROM done WHERE op = 'INCR'",
        "cas_chain": f"{_KV} SELECT ns, key, seq, op, expected_rev, result FROM done WHERE cond = 'REV' OR op = 'DELREV'",
        "ns_state": f"{_KV} SELECT ns, key, v AS value, m AS meta, r AS rev, e AS expires_at_ms FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ns, key ORDER BY n DESC) AS back FROM done) WHERE back = 1 AND v IS NOT NULL AND (e IS NULL OR e > {AS_OF})",
        "batch_abort": _BATCHES,
        "batch_all": f"WITH {_BATCH} SELECT pos, key, op, CASE op WHEN 'set' THEN 'ok' WHEN 'delete' THEN CASE WHEN was IS NOT NULL THEN '1' ELSE '0' END WHEN 'exists' THEN CASE WHEN now IS NOT NULL THEN '1' ELSE '0' END ELSE COALESCE(CAST(now AS VARCHAR), 'nil') END AS result FROM was",
        "watch_keys_since": f"WITH {_LOG}, {_REQUESTS} {_REPLAY} AND rev > {SINCE} AND key IN (SELECT key FROM requests)",
        "watch_from_snapshot": f"{snap} SELECT * FROM (SELECT 'set' AS type, key, value, expires_at_ms, rev FROM snap WHERE starts_with(key, 'user:1')) UNION SELECT * FROM ({_REPLAY} AND rev > {SINCE} AND starts_with(key, 'user:1') AND (key, rev) NOT IN (SELECT (key, rev) FROM snap))",
        "sse_fields": f"WITH {_LOG}, e AS ({_REPLAY} AND rev > {SINCE} AND starts_with(key, 'user:2')) SELECT key, rev, '{{\"type\":\"' || type || '\",\"key\":\"' || key || '\"' || CASE WHEN type = 'set' THEN ',\"value\":\"' || rtrim(translate(base64(encode(value)), '+/', '-_'), '=') || '\"' ELSE '' END || ',\"revision\":' || rev || CASE WHEN type = 'set' AND expires_at_ms IS NOT NULL THEN ',\"ttl\":' || (GREATEST(0, expires_at_ms - {AS_OF}) // 1000) ELSE '' END || '}}' AS data FROM e",
        "rl_sliding_full": _SLIDING_FULL,
        "rl_token_full": _TOKEN_FULL,
        "rl_blockuntil": f"WITH {_FIXED}, waits AS (SELECT key, seq, MIN(CASE WHEN k <= 3 THEN ms END) OVER (PARTITION BY key ORDER BY ms, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - ms AS w FROM numbered) SELECT key, seq, CASE WHEN w < {HOUR} THEN w END AS wait_ms, w IS NULL OR w >= {HOUR} AS timed_out FROM waits",
        "lock_release": _RELEASE,
        "flag_open_types": f"WITH {_EVAL_TYPED} SELECT id, flag, CASE WHEN good THEN value ELSE dflt END AS value, CASE WHEN NOT good THEN 'ERROR' WHEN reason = 'off' THEN 'DISABLED' WHEN reason IN ('rule', 'user-pref', 'override') THEN 'TARGETING_MATCH' WHEN reason = 'rollout' THEN 'SPLIT' ELSE 'DEFAULT' END AS reason FROM typed",
        "ttl_specs": f"SELECT o_orderkey, kind, CAST(CASE kind WHEN 'EX' THEN CASE WHEN a > 0 THEN a * 1000 END WHEN 'PX' THEN CASE WHEN a > 0 THEN a END WHEN 'EXAT' THEN GREATEST(0, (a - {AS_OF // 1000}) * 1000) ELSE GREATEST(0, a - {AS_OF}) END AS BIGINT) AS ttl, CAST(o_orderkey AS VARCHAR) AS size, CAST(NULL AS VARCHAR) AS \"none\", CAST(TRY_CAST('1844674407370955' || (o_orderkey % 9000 + 1000) AS UBIGINT) AS VARCHAR) AS big FROM (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN 0 WHEN kind = 'EXAT' THEN {AS_OF // 1000} + o_orderkey - 5000 WHEN kind = 'PXAT' THEN {AS_OF} + o_orderkey - 5000 ELSE o_orderkey END AS a FROM (SELECT o_orderkey, (['EX', 'PX', 'EXAT', 'PXAT'])[CAST(o_orderkey % 4 AS INTEGER) + 1] AS kind FROM orders))",
        "flag_reason_counts": f"WITH {_EVAL} SELECT flag, reason, COUNT(*) AS n FROM evaluated GROUP BY 1, 2",
        "prefs_fold": "WITH c AS (SELECT CAST(user_id AS VARCHAR) AS id, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS flag, CASE WHEN event_type = 'click' THEN CAST(value AS VARCHAR) END AS value, ROW_NUMBER() OVER (PARTITION BY user_id, event_id % 2 ORDER BY epoch_us(ts) // 1000 DESC, event_id DESC) AS back FROM events WHERE event_type IN ('click', 'error')) SELECT id, string_agg(flag || '=' || value, ',' ORDER BY flag) AS prefs FROM c WHERE back = 1 AND value IS NOT NULL GROUP BY id",
        "rl_fixed": f"WITH {_FIXED} SELECT key, seq, k <= 3 AS allowed, CAST(GREATEST(0, 3 - k) AS BIGINT) AS remaining, (b + 1) * 21600000 AS reset_ms, CASE WHEN k > 3 THEN (b + 1) * 21600000 - ms END AS retry_after_ms FROM numbered",
        "rl_sliding": _SLIDING,
        "rl_token": _TOKEN,
        "rl_token_stream": _TOKEN,
        "rl_blockfor": f"WITH {_FIXED} SELECT key, seq, MIN(CASE WHEN k <= 3 THEN ms END) OVER (PARTITION BY key ORDER BY ms, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - ms AS wait_ms FROM numbered",
        "extract_ip": f"WITH {_IP} SELECT n, COALESCE(edge, \"real\", trim(split_part(nullif(forwarded, ''), ',', 1)), socket, 'unknown') AS ip FROM ips",
        "swr_classify": _SWR,
        "lock_grants": _LOCK,
        "schema_parse": "SELECT event_id AS seq, CASE WHEN event_type = 'click' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_type <> 'click' THEN props END AS raw FROM events",
        "schema_globs": _GLOBBED,
        "parse_integers": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN CASE WHEN o_orderkey % 3 = 1 THEN -o_orderkey ELSE o_orderkey END END AS n FROM orders",
        "key_codecs": "SELECT url AS key, rtrim(translate(base64(encode(url)), '+/', '-_'), '=') AS b64, url_encode(url) AS percent, TRUE AS round_trip FROM pages",
        "ns_names": "SELECT DISTINCT name, regexp_full_match(name, '[A-Za-z0-9_-]{1,64}') AS ok FROM (SELECT replace(p_name, ' ', '_') AS name FROM part UNION ALL SELECT p_type FROM part)",
        "ops_total": f"WITH {_RESOLVED} SELECT op, CASE WHEN was_live THEN 'hit' ELSE 'miss' END AS result, COUNT(*) AS n FROM resolved GROUP BY 1, 2",
        "op_histogram": "SELECT le, (SELECT COUNT(*) FROM events WHERE value <= le) AS n, (SELECT COUNT(value) FROM events) AS total FROM (VALUES (1.0::DOUBLE), (5.0::DOUBLE), (10.0::DOUBLE), (25.0::DOUBLE), (50.0::DOUBLE), (75.0::DOUBLE), (100.0::DOUBLE), (250.0::DOUBLE)) t(le)",
    }
