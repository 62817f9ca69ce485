"""Streaming forms of the event operators. An extension: batch plans are the library's main form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events per key and tumbling window; later than the watermark is dropped, as state must end."""
    at = F.col(ts).cast("timestamp")
    w = F.window("_at", width)
    return events.withColumn("_at", at).withWatermark("_at", late).groupBy(w, key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of a key with their events."""
    at = F.col(ts).cast("timestamp")
    s = F.session_window("_at", gap)
    return events.withColumn("_at", at).withWatermark("_at", late).groupBy(s, key).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def to_parquet(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends finished windows and stops when the input there is has been read."""
    return df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
