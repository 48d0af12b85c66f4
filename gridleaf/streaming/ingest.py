"""Streams of process events and of submitted acts.

``process_stream`` appends each event once: repeats within the watermark are dropped by
state that expires with it.  ``ingest`` runs the batch plan on every micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def process_stream(spark: SparkSession, path: str, schema: StructType, key: str, at: str, ttl_seconds: int) -> DataFrame:
    """Events from a folder of Parquet files, each key once while its time to live runs, with expires_at."""
    events = spark.readStream.schema(schema).parquet(path).withColumn(at, F.col(at).cast("timestamp"))
    once = events.withWatermark(at, f"{ttl_seconds} seconds").dropDuplicatesWithinWatermark([key])
    return once.withColumn("expires_at", F.timestamp_seconds(F.unix_micros(at) / 1e6 + ttl_seconds))


def activity(events: DataFrame, at: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their values by time window; windows close when the watermark passes."""
    windowed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, width), by)
    return windowed.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select("window.start", by, "n", "value")


def ingest(stream: DataFrame, plan: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Hand every micro-batch to ``plan``; ends when what is there has been read."""

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            plan(batch)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
