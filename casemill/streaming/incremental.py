"""Incremental append as Structured Streaming: an extension beside the batch anti-join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def append_available(spark: SparkSession, source: str, schema: StructType, sink: str, checkpoint: str, key: str, delay: str = "1 day", time: str | None = None) -> None:
    """Take the parquet files of `source` that earlier runs haven't seen into `sink`, each key
    once; with `time`, keys are remembered for `delay` only, so state is bounded."""
    rows: DataFrame = spark.readStream.schema(schema).parquet(source)
    rows = rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key]) if time else rows.dropDuplicates([key])
    done = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start(sink)
    done.awaitTermination()
