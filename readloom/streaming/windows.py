"""Windowed counts and sessions that work on tables and on streams alike.

An extension: coordinate-ordered scans drop state once a read can't be met again; event time and watermarks are what
Structured Streaming has for that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(rows: DataFrame, time: str, keys: list[str], width: str, late: str | None = None) -> DataFrame:
    """start, keys, n per tumbling window of `time`; on a stream, rows later than `late` are dropped with their window's state."""
    if late:
        rows = rows.withWatermark(time, late)
    return rows.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(rows: DataFrame, time: str, keys: list[str], gap: str, late: str | None = None) -> DataFrame:
    """start, end, keys, n per session: rows of the keys that follow each other within `gap`; end is the last row plus gap."""
    if late:
        rows = rows.withWatermark(time, late)
    return rows.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def stream_of(spark, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, so many at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
