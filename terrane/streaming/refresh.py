"""Micro-batches: countries that new rows touch run through the pipeline again (Q-12)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def touched_countries(spark: SparkSession, path: str, schema: StructType, rerun: Callable[[DataFrame, list[str]], None], checkpoint: str, key: str = "country_code", every: str | None = None) -> StreamingQuery:
    """Call ``rerun`` with each micro-batch and the countries in it.

    Without ``every`` all files there are handled and the query ends. A micro-batch that fails is
    handed over again, so ``rerun`` must give the same result twice, as snapshots by country do. Only
    distinct country codes reach the driver.
    """

    def handle(batch: DataFrame, _: int) -> None:
        countries = [r[0] for r in batch.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key).collect()]
        if countries:
            rerun(batch, countries)

    writer = spark.readStream.schema(schema).parquet(path).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events of each type and window, late ones dropped after the watermark; an extra beside the batch reports."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select("window.start", "window.end", "event_type", "n")
