"""Media-attention counts per country, batch and Structured Streaming.

The same transformation serves both: events are mapped to a country
(``user_id % 25`` = nation key in the test data) and counted in event-time
windows. The streaming job adds a watermark so window state is dropped once
late data can no longer arrive, and writes in append mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _with_country(events: DataFrame, nations: DataFrame) -> DataFrame:
    return events.join(
        F.broadcast(nations.select("nationkey", "iso3")),
        (F.col("user_id") % 25).cast("int") == F.col("nationkey"),
    )


def daily_counts(events: DataFrame, nations: DataFrame) -> DataFrame:
    """Tumbling one-day windows: (iso3, day, article_count)."""
    e = _with_country(events, nations)
    return e.groupBy("iso3", F.to_date(F.date_trunc("day", "ts")).alias("day")).agg(F.count(F.lit(1)).alias("article_count"))


def windowed_counts(events: DataFrame, nations: DataFrame, length: str = "30 days", slide: str = "1 day",
                    watermark: str | None = None) -> DataFrame:
    """Sliding event-time windows (30-day look-back, daily slide) per iso3."""
    # event time must be a session-zone timestamp for watermarks
    e = _with_country(events, nations).withColumn("ts", F.col("ts").cast("timestamp"))
    if watermark:
        e = e.withWatermark("ts", watermark)
    return e.groupBy("iso3", F.window("ts", length, slide).alias("w")).agg(F.count(F.lit(1)).alias("article_count")).select(
        "iso3", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "article_count"
    )


def start_attention_stream(spark, source_dir: str, nations: DataFrame, sink_dir: str, checkpoint_dir: str,
                           length: str = "1 day", slide: str = "1 day", watermark: str = "1 day", schema=None,
                           available_now: bool = True):
    """Read event files incrementally and append closed windows to a parquet sink."""
    src = spark.readStream.schema(schema).parquet(source_dir)
    counts = windowed_counts(src, nations, length, slide, watermark)
    writer = (
        counts.writeStream.outputMode("append").format("parquet")
        .option("path", sink_dir).option("checkpointLocation", checkpoint_dir)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
