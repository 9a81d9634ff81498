"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='tidelog-')}"


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where none is named and all runs on one machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    return (named or _own_dir()).rstrip("/")


class _Open(threading.local):
    """The open scratches of a thread, the innermost last."""

    def __init__(self):
        self.paths: list[list[str]] = []


_open = _Open()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidelog-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _open.paths:
        _open.paths[-1].append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._tidelog_path = path
    return table


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables written inside at the end, but for those passed to the function it gives.

    What leaves the block must be such a kept table, or read none but those.
    """
    paths: list[str] = []
    kept: list[str] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table._tidelog_path)
        return table

    _open.paths.append(paths)
    try:
        yield keep
    finally:
        _open.paths.pop()
        for p in paths:
            if p not in kept:
                at = spark._jvm.org.apache.hadoop.fs.Path(p)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if _open.paths:
            _open.paths[-1].extend(kept)
