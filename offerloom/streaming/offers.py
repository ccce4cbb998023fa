"""The batch rules with a day's grain as streams: optional twins of freshness, price history and price alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_sightings(stream: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Each offer's sighting once within the lateness, by its key; late repeats are dropped with their state."""
    return stream.withWatermark("seen_at", lateness).dropDuplicatesWithinWatermark(["offer_id", "cents"])


def daily_low(stream: DataFrame, lateness: str = "2 days") -> DataFrame:
    """The lowest price of each product and UTC day, closed once the watermark has passed the day."""
    days = stream.withWatermark("seen_at", lateness).groupBy(F.window("seen_at", "1 day").alias("w"), "product_id")
    return days.agg(F.min("cents").alias("cents"), F.count("*").alias("sightings")).select("product_id", F.to_date("w.start").alias("observed_on"), "cents", "sightings")


def sessions(stream: DataFrame, key: str, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Bursts of a key's events, split by a gap."""
    grouped = stream.withWatermark("seen_at", lateness).groupBy(F.session_window("seen_at", gap).alias("w"), key)
    return grouped.agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")
