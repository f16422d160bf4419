"""Incremental ingestion: new files are taken as a stream until none is left, and replace what their sources had."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import write_sources


def ingest(spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda d: d, key: str = "source") -> None:
    """Reads Parquet files that were not read before and replaces their sources in the target table."""

    def batch(rows: DataFrame, number: int) -> None:
        write_sources(prepare(rows), target, key)

    stream = spark.readStream.schema(schema).parquet(folder)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums of events by type and window, as an append stream with a watermark, read back as a table."""
    events = spark.readStream.schema(schema).parquet(folder).withWatermark("ts", late)
    counted = events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    flat = counted.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
    flat.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("window_start timestamp, event_type string, n bigint, total double").parquet(target)


def stored_rows(spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str) -> DataFrame:
    """All rows of a folder taken by a stream, each file once, as a table."""
    stream = spark.readStream.schema(schema).parquet(folder)
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(target)
