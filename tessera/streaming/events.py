"""Streams of turns and events (an extension beside the batch operators): watermarks, sessions by gap, keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def source(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def deduplicated(turns: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Turns once per id within the watermark; late copies fall away."""
    return turns.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["id"])


def sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """(key, start, end, n): runs of events with no longer pause than the gap."""
    e = events.withWatermark(ts, lateness)
    return e.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def tumbling(events: DataFrame, by: list[str], ts: str = "ts", width: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    e = events.withWatermark(ts, lateness)
    return e.groupBy(F.window(ts, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def append(stream: DataFrame, folder: str, checkpoint: str):
    """Writes what there is and ends: the incremental run of a batch schedule."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
