"""Live change streams over an appended log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.watch import replay


def watch(spark: SparkSession, log_path: str, schema, *, prefix: str = "", since: int = 0, files_per_trigger: int = 8) -> DataFrame:
    """Change events of a log folder as a stream, resumed through the query's checkpoint."""
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(log_path)
    return replay(log, since, prefix)


def once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over what there is, into Parquet files."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def deduplicated(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events without those delivered twice, as after a reconnection; the state is bounded by a watermark on the revision's time."""
    at = F.timestamp_millis(F.col("rev"))
    return events.withColumn("_at", at).withWatermark("_at", delay).dropDuplicatesWithinWatermark(["key", "rev"]).drop("_at")
