"""Joins in which one key may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with over one in so many of the rows is broadcast.
FREQUENT = 1_000


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], salt: list[str]) -> DataFrame:
    """The inner join of rows with a written table that has each key once and, as ``c``, the number of its rows.

    Keys that each hold over one in ``FREQUENT`` of all rows are fewer than
    ``FREQUENT`` and are broadcast; their rows get a salt, from the columns
    ``salt``, in the merge join with the others, whatever their number, so that
    no task gets them all.
    """
    own = [c for c in table.columns if c not in keys]
    least = (table.agg(F.sum("c")).first()[0] or 0) // FREQUENT
    frequent = table.filter(F.col("c") > least).limit(FREQUENT)  # the limit cuts nothing: it states the bound
    frequent = frequent.select(*keys, F.struct(*own).alias("_frequent"))
    # the salt of the others is read from a column, lest the optimizer drop a constant key
    others = table.filter(F.col("c") <= least).select(*keys, F.least(F.col("c"), F.lit(0)).cast("long").alias("_salt"), F.struct(*own).alias("_other"))
    marked = rows.join(F.broadcast(frequent), keys, "left")
    salted = marked.withColumn("_salt", F.when(F.col("_frequent").isNotNull(), 1 + F.pmod(F.xxhash64(*salt), F.lit(1 << 20))).otherwise(F.lit(0)).cast("long"))
    met = salted.join(others.hint("merge"), [*keys, "_salt"], "left").withColumn("_own", F.coalesce("_frequent", "_other")).filter("_own is not null")
    return met.select(*rows.columns, *[F.col("_own")[c].alias(c) for c in own])
