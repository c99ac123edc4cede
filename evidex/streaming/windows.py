"""Streaming forms of the batch operators, an extension beyond the batch pipelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, ts: str, keys: Sequence[str], value: str, size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Count, sum and mean of each window and key; works on streams, with late rows up to `late`, and on tables."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = rows.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total", "mean")


def session_counts(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Number of events of each session of a key."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    out = rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n")


def first_seen(events: DataFrame, ts: str, keys: Sequence[str], late: str = "1 day") -> DataFrame:
    """A stream's rows once by key within the watermark; a table's rows once by key."""
    if events.isStreaming:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))
    return events.dropDuplicates(list(keys))


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Append a stream to Parquet; available rows are processed and the query ends."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
