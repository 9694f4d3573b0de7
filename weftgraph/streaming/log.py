"""Streaming over the append-only audit log. An extension: the log's own readers are batch readers.

The log folder is a file source; records carry ISO times, which become event time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """New records of the log as a stream, with their time as ``at``."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withColumn("at", F.to_timestamp("ts"))


def windowed(stream: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window and type; a window is final when the watermark has passed it."""
    w = F.window("at", size)
    counts = stream.withWatermark("at", late).groupBy(w.alias("w"), "eventType").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), "eventType", "n")


def once(stream: DataFrame, key: str = "id", late: str = "15 minutes") -> DataFrame:
    """Each key once within the watermark, as a ledger of used tokens keeps it."""
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark([key])


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of one actor's records with no gap longer than ``gap``."""
    s = F.session_window("at", gap)
    return stream.withWatermark("at", late).groupBy(s.alias("s"), "actor").agg(F.count("*").alias("n")).select("actor", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
