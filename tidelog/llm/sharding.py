"""Contiguous shards of nearly equal bytes, from global prefix sums.

Rows are put into one global order by range partitioning; each partition's
total is added up over the partitions, so that every row gets the bytes and
rows before it without any task holding more than a partition. The order is
cut at equal byte targets; a row that a cut falls into goes to the side of its
larger half. Equal texts stand next to each other in the order,
and a cut that falls into such a group moves to the group's nearer edge, if
that shifts it by no more than ``GROUP_SHARE`` of a shard; larger groups are
split.

Cases with a defined result: a null text has no bytes (size 1) and the
checksum of an empty text; a text of any length stays whole; repeated rows and
null ids are rows of their own; other columns are ignored, and written with the
shards, except those named shard and slot; an empty table gives an empty result; with fewer rows than shards some shards are empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

#: How far a cut may move, as a part of a shard's bytes, to keep equal texts together.
GROUP_SHARE = 0.01


def _ordered(df: DataFrame, carried: list[str]) -> DataFrame:
    """Slim rows, and the carried columns, in the global order, with the bytes and rows before each."""
    slim = df.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
        *carried,
    )
    order = ("text_hash", "text_crc32", "doc_id")
    # sampled range bounds differ between runs of a plan, so the numbered rows are written once
    rows = written(slim.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (  # one row for each partition
        rows.groupBy("part")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        .select(
            "part",
            F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_start"),
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_start"),
        )
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumns({"end": F.sum("size").over(inside), "nth": F.row_number().over(inside)}).join(F.broadcast(starts), "part")
    return written(
        placed.select(
            "doc_id", "size", "text_crc32", "text_hash",
            (F.col("bytes_start") + F.col("end") - F.col("size")).alias("bytes_before"),
            (F.col("rows_start") + F.col("nth") - 1).alias("rows_before"),
            *carried,
        )
    )


def _cuts(rows: DataFrame, total: int, n_shards: int) -> list[int]:
    """Byte positions where shards begin, without the first."""
    target = total / n_shards
    cuts = [round(target * k) for k in range(1, n_shards)]
    hit = F.filter(F.array(*map(F.lit, cuts)), lambda c: (c > F.col("bytes_before")) & (c < F.col("bytes_before") + F.col("size"))) if cuts else F.array()
    at_cut = rows.filter(F.size(hit) > 0).select("text_hash", "text_crc32").distinct()  # n_shards - 1 groups at most
    edge = F.filter(F.array(*map(F.lit, cuts)), lambda c: c == F.col("bytes_before")) if cuts else F.array()
    at_edge = rows.filter(F.size(edge) > 0).select("text_hash", "text_crc32").distinct()
    keys = at_cut.union(at_edge).distinct()
    groups = (
        rows.join(F.broadcast(keys), ["text_hash", "text_crc32"], "left_semi")
        .groupBy("text_hash", "text_crc32")
        .agg(F.min("bytes_before").alias("low"), F.max(F.col("bytes_before") + F.col("size")).alias("high"))
        .collect()
    )
    moved = []
    for cut in cuts:
        for g in groups:
            if g["low"] < cut < g["high"]:
                edge_at = g["low"] if cut - g["low"] <= g["high"] - cut else g["high"]
                if abs(edge_at - cut) <= GROUP_SHARE * target:
                    cut = edge_at
                break
        moved.append(cut)
    return sorted(moved)


def assign(df: DataFrame, n_shards: int = 16, carried: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, size, text_crc32, shard, and its slot in the shard (gapless from 0); then the carried columns."""
    rows = _ordered(df, list(carried))
    total = rows.agg(F.sum("size")).first()[0] or 0
    cuts = _cuts(rows, total, n_shards) if total else [0] * (n_shards - 1)
    begun = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    sharded = rows.withColumn("shard", F.size(F.filter(begun, lambda c: c <= F.col("bytes_before") + F.shiftright("size", 1))))
    first = {r["shard"]: r["first"] for r in sharded.groupBy("shard").agg(F.min("rows_before").alias("first")).collect()}
    firsts = F.array(*[F.lit(first.get(k, 0)).cast("long") for k in range(n_shards)])
    return sharded.select("doc_id", "size", "text_crc32", "shard", (F.col("rows_before") - firsts[F.col("shard")]).alias("slot"), *carried)


def contract(df: DataFrame, n_shards: int = 16) -> DataFrame:
    return assign(df, n_shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(df: DataFrame, path: str, n_shards: int = 16) -> None:
    """The documents with their slots as Parquet folders ``shard=k`` under ``path``; ids may be null or repeated."""
    whole = df.select("doc_id", "text", F.struct(*[F.col(c) for c in df.columns if c not in ("shard", "slot")]).alias("_row"))
    placed = assign(whole, n_shards, ("_row",)).select("_row.*", "shard", "slot")
    placed.write.partitionBy("shard").parquet(path)
