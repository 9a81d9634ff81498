"""Connected components of a graph of links, without a task that sees them all."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written

#: Up to so many links are resolved in one task, which is quicker than rounds of jobs.
FEW_LINKS = 10_000


def _at_once(links: DataFrame) -> DataFrame:
    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for hi, lo in zip(pdf["hi"].tolist(), pdf["lo"].tolist(), strict=True):
            a, b = find(hi), find(lo)
            parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        return pd.DataFrame({"node": nodes, "root": [find(x) for x in nodes]})

    return links.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(resolve, "node long, root long")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi > lo").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("hi").agg(F.min("lo").alias("m"))
    joined = links.join(least, "hi")
    return joined.filter("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(least.select("hi", F.col("m").alias("lo"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link; links are pairs (a, b) of longs, the root is the least node reached.

    Alternates the two star contractions until the links no longer change;
    each round is written to the shared folder.
    """
    now = written(links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    mark = None
    if now.count() <= FEW_LINKS:
        return _at_once(now)
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(state) == mark:
            break
        mark = tuple(state)
        now = written(_small_star(_large_star(now)))
    roots = now.groupBy("hi").agg(F.min("lo").alias("root")).select(F.col("hi").alias("node"), "root")
    return roots.union(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
