"""Request ledgers as streams: tumbling windows that agree with the batch query once the watermark has passed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_ledger(spark: SparkSession, folder: str, schema: str, **options: str) -> DataFrame:
    """A stream over the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).options(**options).parquet(folder)


def window_rates(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """start, submitted, failed, qps of each tumbling window of ts; rows later than `late` are left out."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"))
    out = counted.agg(F.count("*").alias("submitted"), F.count_if(F.col("event_type") == "error").alias("failed"))
    seconds = (F.unix_micros("w.end") - F.unix_micros("w.start")) / 1_000_000
    return out.select(F.col("w.start").alias("start"), "submitted", "failed", ((F.col("submitted") - F.col("failed")) / seconds).alias("qps"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, end and requests of each session: a gap without requests ends it."""
    grouped = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.count("*").alias("requests")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "requests")
