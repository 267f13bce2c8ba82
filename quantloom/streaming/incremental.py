"""Incremental runs over Structured Streaming: late rows, hourly panels and one submission per period."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quantloom.functions.scalar import period_key


def event_stream(spark: SparkSession, path: str, schema, max_files: int = 8) -> DataFrame:
    """A folder of Parquet files as a stream, a few files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def panel_stream(events: DataFrame, ts: str, asset: str, value: str, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Mean value per window and asset; rows later than ``late`` are dropped and each window is given out once."""
    return (
        events.withWatermark(ts, late)
        .groupBy(F.window(ts, every).alias("w"), F.col(asset).alias("asset"))
        .agg(F.avg(value).alias("px"), F.count("*").alias("n"))
        .select(F.col("w.start").alias("ts"), "asset", "px", "n")
    )


def once_per_period(requests: DataFrame, ts: str, cadence: str, late: str = "40 days") -> DataFrame:
    """The first request of each period; later ones of the same period are dropped while the watermark holds it."""
    keyed = requests.withColumn("period_key", period_key(F.to_date(ts), cadence))
    return keyed.withWatermark(ts, late).dropDuplicatesWithinWatermark(["period_key"])


def run_available(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Take what is there, batch by batch, and stop; a later call goes on from the checkpoint."""
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def append_table(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch under its number, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
