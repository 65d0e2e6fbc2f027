"""Incremental ingest: clean, validate and keep the first article of each address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sondhan.operators.cleaning import clean_articles, reject_reason
from sondhan.operators.dedup import normalize_url


def ingest(stream: DataFrame, min_tokens: int = 50) -> DataFrame:
    """Cleaned, valid articles of a stream, one a normalised address; the checkpoint holds what was seen."""
    cleaned = clean_articles(stream)
    valid = cleaned.filter(reject_reason(F.col("url"), F.col("title"), F.col("body"), min_tokens).isNull())
    return valid.withColumn("nurl", normalize_url(F.col("url"))).filter("nurl <> ''").dropDuplicates(["nurl"])


def ingest_bounded(stream: DataFrame, event_time: str, delay: str = "7 days", min_tokens: int = 50) -> DataFrame:
    """Like ``ingest`` with state bounded by a watermark on the crawl time."""
    cleaned = clean_articles(stream)
    valid = cleaned.filter(reject_reason(F.col("url"), F.col("title"), F.col("body"), min_tokens).isNull())
    timed = valid.withColumn("nurl", normalize_url(F.col("url"))).withColumn("seen_at", F.try_to_timestamp(F.col(event_time))).withWatermark("seen_at", delay)
    return timed.filter("nurl <> ''").dropDuplicatesWithinWatermark(["nurl"])


def write(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def event_counts(events: DataFrame, window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Events by tumbling window and type, late ones within the watermark."""
    timed = events.withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")
