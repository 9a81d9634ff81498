"""Feature flags: rules, deterministic rollout, and the whole precedence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.scalars import fnv1a32, fnv_bytes, fnv_mixed

DEFINITION = T.StructType([
    T.StructField("on", T.BooleanType()),
    T.StructField("rules", T.ArrayType(T.StructType([T.StructField("when", T.MapType(T.StringType(), T.StringType())), T.StructField("value", T.StringType())]))),
    T.StructField("rollout", T.StructType([T.StructField("percent", T.DoubleType()), T.StructField("value", T.StringType())])),
])


def definitions(entries: DataFrame) -> DataFrame:
    """(flag, on, rules, rollout) of entries ``flags:def:<name>``; those without a boolean ``on`` are left out.

    A rule has its value and its conditions, each with the key and the list of values
    that fit, so that these are parsed once for a definition, not for each context.
    """
    prefix = "flags:def:"
    parsed = entries.filter(F.col("key").startswith(prefix)).select(F.substring("key", len(prefix) + 1, 1000).alias("flag"), F.from_json("value", DEFINITION).alias("d"))
    values = lambda v: F.coalesce(F.from_json(v, "array<string>"), F.array(v))
    conditions = lambda when: F.transform(F.map_entries(when), lambda c: F.struct(c["key"].alias("key"), values(c["value"]).alias("values")))
    rules = F.transform("d.rules", lambda r: F.struct(r["value"].alias("value"), conditions(r["when"]).alias("conditions")))
    return parsed.select("flag", "d.on", rules.alias("rules"), "d.rollout").filter(F.col("on").isNotNull())


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Entries whose bytes differ between two loads: added, removed or changed."""
    joined = before.select("key", F.col("value").alias("old")).join(after.select("key", F.col("value").alias("new")), "key", "full_outer")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return joined.filter(~F.col("old").eqNullSafe(F.col("new"))).select("key", kind.alias("change"))


def first_rule(rules, attributes, unit_id):
    """(index, value) of the first rule, as ``definitions`` has them, whose conditions all hold.

    A condition names one value or lists some, of an attribute or of ``id``; a
    missing attribute fails, no conditions hold.
    """
    actual = lambda k: F.when(k == "id", unit_id).otherwise(attributes[k])
    hits = F.filter(
        F.transform(rules, lambda r, i: F.struct(i.alias("index"), r["value"].alias("value"), F.forall(r["conditions"], lambda c: F.coalesce(F.array_contains(c["values"], actual(c["key"])), F.lit(False))).alias("hit"))),
        lambda r: r["hit"],
    )
    return F.get(hits, F.lit(0))


def paired(contexts: DataFrame, config: DataFrame) -> DataFrame:
    """Every context, with its hash, and every row of a table of flags or definitions.

    These are configuration, which each evaluating process holds whole, and are
    broadcast, lest the contexts be. The contexts are dealt to all tasks, as a small file
    of them makes many rows; those without an id are dealt one by one.
    """
    key = F.when(F.col("id").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("id"))
    dealt = contexts.withColumn("_deal", key).repartition("_deal").drop("_deal")
    return dealt.withColumn("_hash", fnv1a32(F.col("id"))).crossJoin(F.broadcast(config))


def evaluate(contexts: DataFrame, flags: DataFrame, defs: DataFrame, prefs: DataFrame, allow_empty: bool = False) -> DataFrame:
    """One row per context (id, attributes, override map) and flag (flag, default): value, reason, rule.

    Order: off, user preference, override, no definition, first rule, rollout,
    default. A missing id is an error and gives the default; ``allow_empty`` lets
    the empty one pass, as the common flag interface does. Preferences are joined to the
    contexts before these meet the flags; of several for an id and a flag the greatest counts.
    """
    chosen = prefs.groupBy("id").agg(F.collect_list(F.struct("flag", "pref")).alias("_prefs"))
    asked = flags.join(defs, "flag", "left").withColumn("_tail", fnv_bytes(F.concat(F.lit(":"), F.col("flag"))))
    rows = paired(contexts.join(chosen, "id", "left"), asked)
    percent = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("rollout.percent")))
    rows = rows.withColumns({
        "pref": F.array_max(F.transform(F.filter("_prefs", lambda p: p["flag"] == F.col("flag")), lambda p: p["pref"])),
        "rule_hit": first_rule(F.col("rules"), F.col("attributes"), F.col("id")),
        "rolled": F.when(percent > 0, fnv_mixed(F.col("_hash"), F.col("_tail")) % 100 < percent),  # hashed only where there is a rollout
    })
    override = F.col("overrides")[F.col("flag")]
    cases = [
        (F.col("id").isNull() | ((F.col("id") == "") & F.lit(not allow_empty)), "error", F.col("default")),
        (F.col("on") == F.lit(False), "off", F.col("default")),
        (F.col("pref").isNotNull(), "user-pref", F.col("pref")),
        (override.isNotNull(), "override", override),
        (F.col("on").isNull(), "no-snapshot", F.col("default")),
        (F.col("rule_hit").isNotNull(), "rule", F.col("rule_hit.value")),
        (F.coalesce("rolled", F.lit(False)), "rollout", F.coalesce("rollout.value", F.lit("true"))),
    ]
    reason = value = None
    for test, name, result in cases:
        reason = F.when(test, name) if reason is None else reason.when(test, name)
        value = F.when(test, result) if value is None else value.when(test, result)
    out = rows.withColumns({"reason": reason.otherwise("default"), "value": value.otherwise(F.col("default"))})
    return out.select("id", "flag", "value", "reason", F.when(F.col("reason") == "rule", F.col("rule_hit.index")).cast("int").alias("rule"))


#: Names of the reasons in the common flag interface.
OPEN_REASONS = {"off": "DISABLED", "rule": "TARGETING_MATCH", "user-pref": "TARGETING_MATCH", "override": "TARGETING_MATCH", "rollout": "SPLIT", "default": "DEFAULT", "no-snapshot": "DEFAULT", "error": "ERROR"}


def open_details(evaluated: DataFrame, flags: DataFrame) -> DataFrame:
    """Boolean resolution: a value of another type is an error and gives the default."""
    names = F.create_map(*[F.lit(x) for pair in OPEN_REASONS.items() for x in pair])
    good = F.col("value").isin("true", "false")
    return evaluated.join(F.broadcast(flags), "flag").select("id", "flag", F.when(good, F.col("value")).otherwise(F.col("default")).alias("value"), F.when(good, names[F.col("reason")]).otherwise("ERROR").alias("reason"))


def typed_details(evaluated: DataFrame, flags: DataFrame) -> DataFrame:
    """Resolution by the flag's type (flag, default, kind): boolean, string, number or object; a value of another type is an error and gives the default."""
    names = F.create_map(*[F.lit(x) for pair in OPEN_REASONS.items() for x in pair])
    value, kind = F.col("value"), F.col("kind")
    number = value.rlike(r"\A-?[0-9]+(\.[0-9]+)?\z")
    structured = value.rlike(r"\A\s*[\[{]") & F.try_parse_json(value).isNotNull()
    good = F.when(kind == "boolean", value.isin("true", "false")).when(kind == "number", number).when(kind == "object", structured).otherwise(value.isNotNull())
    rows = evaluated.join(F.broadcast(flags.select("flag", "default", "kind")), "flag").withColumn("good", good)
    good = F.col("good")
    return rows.select("id", "flag", F.when(good, value).otherwise(F.col("default")).alias("value"), F.when(good, names[F.col("reason")]).otherwise("ERROR").alias("reason"))


def folded_prefs(changes: DataFrame) -> DataFrame:
    """Preference changes (id, flag, value or null to reset, ms, seq) as one map per user; users without any left are dropped."""
    last = changes.groupBy("id", "flag").agg(F.max_by(F.struct("value"), F.struct("ms", "seq")).alias("last")).select("id", "flag", "last.value")
    return last.filter(F.col("value").isNotNull()).groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("flag", "value")))).alias("prefs"))
