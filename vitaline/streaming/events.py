"""Structured Streaming over event records: the same aggregation serves batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tumbling(events: DataFrame, size: str, watermark: str | None = None) -> DataFrame:
    """Count and sum per event type and window of `size`; late rows are accepted up to the watermark."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if watermark:
        e = e.withWatermark("ts", watermark)
    g = e.groupBy("event_type", F.window("ts", size)).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select("event_type", F.col("window.start").alias("start"), "n", "total")


def range_alerts(events: DataFrame, lo: float, hi: float) -> DataFrame:
    """Rows whose value is missing or outside lo..hi, with the reason; stateless, so it needs no watermark."""
    v = F.col("value")
    kind = F.when(v.isNull(), "missing").when(v < lo, "low").when(v > hi, "high")
    return events.withColumn("alert", kind).where(F.col("alert").isNotNull())


def write_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Parquet sink with exactly-once output; the checkpoint folder must be shared by all executors."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
