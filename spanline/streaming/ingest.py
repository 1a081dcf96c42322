"""Structured Streaming extras: contents as they arrive, late deliveries once.

The reference has no streams; these are extensions for continuous ingestion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arriving(spark: SparkSession, folder: str, schema: str, per_trigger: int = 16) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def first_deliveries(stream: DataFrame, keys: list[str], at: str, late: str = "90 days") -> DataFrame:
    """Each key once within the watermark; state of older keys is dropped."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def monthly_counts(stream: DataFrame, at: str, key: str, late: str = "90 days") -> DataFrame:
    """Counts per 30 days and key, updated while late rows may still come."""
    return stream.withWatermark(at, late).groupBy(F.window(at, "30 days"), key).agg(F.count(F.lit(1)).alias("n"))


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes everything available and ends; restarts go on where it ended."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
