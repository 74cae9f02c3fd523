"""Streams: files as a stream, duplicates within a watermark, and (beyond the surveyed operators) event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, schema: str, ts: str = "ts", files: str = "*.parquet", max_files: int = 64) -> DataFrame:
    """The Parquet files of a folder that the pattern names as a stream; the event time is cast to a timestamp, which watermarks need."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", files).parquet(folder)
    return rows.withColumn(ts, F.col(ts).cast("timestamp"))


def deduplicated(stream: DataFrame, key: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def tumbling(rows: DataFrame, width: str, *by: str, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Counts and sums of value by window. The watermark is what bounds a stream's state; a batch ignores it."""
    return rows.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sessions(rows: DataFrame, gap: str, *by: str, ts: str = "ts", late: str = "1 day") -> DataFrame:
    return rows.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "n")
