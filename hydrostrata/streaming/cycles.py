"""Streaming extension: windowed counts of events with late data, and upserts of new deliveries per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema: str, at: str = "ts", late: str = "10 minutes", name: str = "*") -> DataFrame:
    """A file stream of parquet events with a watermark on ``at``."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withWatermark(at, late)


def windowed(events: DataFrame, at: str, by: str, value: str, length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums per tumbling (or sliding) window and ``by``; for streams and tables alike."""
    window = F.window(at, length, slide) if slide else F.window(at, length)
    return events.groupBy(window.alias("w"), by).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), by, "n", "total")


def sessions(events: DataFrame, at: str, by: str, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each ``by``: events at most ``gap`` apart."""
    return events.groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), by, "n")


def upsert_batches(stream: DataFrame, key: str, order: str, target: str, checkpoint: str) -> Callable[[], None]:
    """Start a query that keeps at ``target`` the latest row of each key; returns what runs it to the end.

    Batches write whole new versions of the target beside the old and then note which one counts, so a batch
    that is run again gives the same table.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if number > 0:
            rows = rows.unionByName(spark.read.parquet(f"{target}/version={number - 1}").drop("version"))
        rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), order).alias("r")).select(key, "r.*").write.mode("overwrite").parquet(f"{target}/version={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return lambda: query.start().awaitTermination()
