"""Row-wise operators have no action, so they run on a stream as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def run_once(spark: SparkSession, folder: str, schema: str, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Read a folder of Parquet files as a stream, transform it, and append it to ``out``."""
    stream = spark.readStream.schema(schema).parquet(folder)
    query = transform(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def dedup_within(stream: DataFrame, time: str, keys: list[str], delay: str) -> DataFrame:
    """Duplicates on a stream: only within the watermark's delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
