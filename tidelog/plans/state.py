"""From commands to state: liveness, the mutation log, and snapshots.

Per key, commands are ordered by (ms, seq). A put or delete opens a segment;
within it, each command sets or clears the expiry. The key is dead from the
first command on that finds the expiry passed. All windows partition by the
key, so that one exchange serves them. Revisions are numbered inside short stretches
of time of a shard, and moved on by what the stretches before hold: no task gets
a whole shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Milliseconds of a stretch in which revisions are numbered at once.
STRETCH = 1 << 16


def with_revisions(rows: DataFrame) -> DataFrame:
    """Adds ``rev`` to rows (shard, ms, seq): the shard's hybrid clock, which is the time, but always more than before."""
    cut = rows.withColumn("_b", F.expr(f"ms div {STRETCH}"))
    order = Window.partitionBy("shard", "_b").orderBy("ms", "seq")
    local = cut.withColumn("_n", F.row_number().over(order).cast("long"))
    local = local.withColumn("_lead", F.max(F.col("ms") - F.col("_n")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # one row for each stretch: how many rows come before, and the furthest that the clock ran ahead there
    before = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    slim = cut.select("shard", "_b", "ms", "seq").withColumn("_n", F.row_number().over(order).cast("long"))
    totals = slim.groupBy("shard", "_b").agg(F.count("*").alias("_count"), F.max(F.col("ms") - F.col("_n")).alias("_most"))
    totals = totals.withColumn("_start", F.coalesce(F.sum("_count").over(before), F.lit(0)))
    totals = totals.withColumn("_ahead", F.max(F.col("_most") - F.col("_start")).over(before)).select("shard", "_b", "_start", "_ahead")
    placed = local.join(totals, ["shard", "_b"])
    return placed.withColumn("rev", F.col("_start") + F.col("_n") + F.greatest("_ahead", F.col("_lead") - F.col("_start"))).select(*rows.columns, "rev")


def resolve(commands: DataFrame) -> DataFrame:
    """Adds what each command finds (``was_*``) and leaves (``live``, ``head_*``)."""
    by_key = Window.partitionBy("key").orderBy("ms", "seq")
    so_far = by_key.rowsBetween(Window.unboundedPreceding, 0)
    in_segment = Window.partitionBy("key", "segment").orderBy("ms", "seq")
    of_segment = in_segment.rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("op").isin("SET", "SETEX", "DEL")
    cut = commands.withColumn("segment", F.sum(F.when(head, 1).otherwise(0)).over(so_far))
    late = F.coalesce(F.lag("exp_set").over(in_segment) <= F.col("ms"), F.lit(False))
    cut = cut.withColumn("late", late)
    cut = cut.withColumns({
        "live": (F.col("segment") > 0) & (F.first("op").over(of_segment) != "DEL") & ~F.max("late").over(of_segment),
        "head_value": F.first("value").over(of_segment),
        "head_meta": F.first("meta").over(of_segment),
        "head_seq": F.first("seq").over(of_segment),
        "head_ms": F.first("ms").over(of_segment),
        "head_op": F.first("op").over(of_segment),
    })
    was_exp = F.lag("exp_set").over(by_key)
    was_live = F.coalesce(F.lag("live").over(by_key) & (was_exp.isNull() | (was_exp > F.col("ms"))), F.lit(False))
    cut = cut.withColumn("was_live", was_live)
    return cut.withColumns({
        "was_value": F.when(F.col("was_live"), F.lag("head_value").over(by_key)),
        "was_exp": F.when(F.col("was_live"), was_exp),
    }).drop("late")


def mutation_log(resolved: DataFrame) -> DataFrame:
    """The commands that change something, with their kind and revision.

    The revision of a shard is a hybrid clock: the time, but always more than
    the one before.
    """
    op = F.col("op")
    applied = op.isin("SET", "SETEX") | (F.col("was_live") & (op.isin("DEL", "EXPIRE") | ((op == "PERSIST") & F.col("was_exp").isNotNull())))
    kind = F.when(op.isin("SET", "SETEX"), "PUT").when(op == "DEL", "DEL").otherwise("TTL")
    rows = resolved.filter(applied).select("shard", "key", "ms", "seq", kind.alias("kind"), "value", "meta", F.col("exp_set").alias("expires_at_ms"))
    return with_revisions(rows)


def log_state(log: DataFrame, as_of: int, *more: str) -> DataFrame:
    """Each key's last put, with the expiry of its last record, whether still live or not: (key, shard, value, meta, rev, expires_at_ms).

    ``more`` may name ``put_at.ms`` and ``put_at.seq``.
    """
    before = log.filter(F.col("ms") <= as_of)
    at = F.struct("ms", "seq")
    put_at = F.when(F.col("kind") == "PUT", at)
    last = before.groupBy("key", "shard").agg(
        *[F.max_by(c, put_at).alias(c) for c in ("value", "meta", "rev")],  # apart, so that unused ones are pruned with their windows
        F.max(put_at).alias("put_at"),
        F.max(F.when(F.col("kind") == "DEL", at)).alias("del_at"),
        F.max_by("expires_at_ms", at).alias("expires_at_ms"),
    )
    present = last.filter(F.col("put_at").isNotNull() & (F.col("del_at").isNull() | (F.col("put_at") > F.col("del_at"))))
    return present.select("key", "shard", "value", "meta", "rev", "expires_at_ms", *more)


def snapshot(log: DataFrame, as_of: int, *more: str) -> DataFrame:
    """The live keys at a time."""
    return log_state(log, as_of, *more).filter(F.col("expires_at_ms").isNull() | (F.col("expires_at_ms") > as_of))
