"""Streams (an extension): corrections that are applied as they come, and upload sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_corrections(stream: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Of (span_id, ts, revision, corrected_text): the latest correction of each span and day;
    state of a day is dropped once the watermark has passed it."""
    return (
        stream.withWatermark("ts", late)
        .groupBy(F.window("ts", window), "span_id")
        .agg(F.max_by("corrected_text", "revision").alias("corrected_text"), F.max("revision").alias("revision"), F.count("*").alias("corrections"))
        .select("span_id", F.col("window.start").alias("day"), "corrected_text", "revision", "corrections")
    )


def upload_sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Of (user_id, ts): sessions that end after a pause of ``gap``, when their files may go."""
    return (
        stream.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap), "user_id")
        .agg(F.count("*").alias("events"))
        .select("user_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("delete_after"), "events")
    )
