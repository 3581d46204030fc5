"""Activity summaries over event streams; each works on a batch as on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of event files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def late_split(events: DataFrame, bound: str = "1 hour") -> DataFrame:
    """The stream under a watermark; rows later than ``bound`` are dropped by the stateful operators after it."""
    return events.withWatermark("ts", bound)


def windows(events: DataFrame, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(start, event_type, n, users) per tumbling or sliding window; users is exact on batches, approximate on streams."""
    by = events.groupBy(F.window("ts", size, slide) if slide else F.window("ts", size), "event_type")
    users = F.approx_count_distinct("user_id") if events.isStreaming else F.countDistinct("user_id")
    out = by.agg(F.count("*").alias("n"), users.alias("users"))
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "users")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, session, n, value) per session of a user."""
    out = events.groupBy("user_id", F.session_window("ts", gap).alias("session"))
    return out.agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def unique_events(events: DataFrame) -> DataFrame:
    """Each event_id once; on streams within the watermark."""
    return events.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
