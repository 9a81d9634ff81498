"""Operation counts and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def totals(resolved: DataFrame) -> DataFrame:
    """Commands by kind and by whether the key was live."""
    return resolved.groupBy("op", F.when(F.col("was_live"), "hit").otherwise("miss").alias("result")).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts: how many values are at most each bound."""
    columns = [F.count(F.when(F.col(value) <= b, 1)) for b in bounds]
    row = df.agg(F.array(*columns).alias("n"), F.count(value).alias("total"))
    le = F.array(*[F.lit(float(b)) for b in bounds])
    return row.select(F.explode(F.arrays_zip(le.alias("le"), F.col("n"))).alias("x"), "total").select("x.le", "x.n", "total")
