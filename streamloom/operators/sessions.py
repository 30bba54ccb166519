"""Sessions by inactivity, and identities as of an event."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TIMEOUT_MS = 30_000


def sessionize(events: DataFrame, timeout_ms: int = TIMEOUT_MS) -> DataFrame:
    """events with session_no by device: a new one after a gap over the timeout, or after the app was in the background for longer."""
    order = Window.partitionBy("device_id").orderBy("timestamp_ms", "id")
    idle = F.col("timestamp_ms") - F.lag("timestamp_ms").over(order) > timeout_ms
    # the last time the app went to the background, until it comes back
    switch = F.when(F.col("event_type").isin("app_background", "app_foreground"), F.struct("event_type", "timestamp_ms"))
    before = F.last(switch, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    away = (F.col("event_type") == "app_foreground") & (before["event_type"] == "app_background") & (F.col("timestamp_ms") - before["timestamp_ms"] > timeout_ms)
    new = F.coalesce(idle, F.lit(True)) | F.coalesce(away, F.lit(False))
    return events.withColumn("_new", new.cast("long")).withColumn("session_no", F.sum("_new").over(order)).drop("_new")


def summaries(sessions: DataFrame) -> DataFrame:
    """One row for each session; its duration is last activity less start."""
    return sessions.groupBy("device_id", "session_no").agg(
        F.min("timestamp_ms").alias("start_ms"), F.max("timestamp_ms").alias("end_ms"), F.count("*").alias("events")
    ).withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))


def boundary_events(summary: DataFrame) -> DataFrame:
    """A session_start and a session_end row for each session."""
    return summary.selectExpr(
        "device_id", "session_no", "stack(2, 'session_start', start_ms, cast(null as bigint), 'session_end', end_ms, duration_ms) as (event_type, timestamp_ms, duration_ms)"
    )


def identity_as_of(events: DataFrame, changes: DataFrame) -> DataFrame:
    """events with the user_id that held for their device at their time; changes (device_id, timestamp_ms, user_id), a null user resets.

    One sort of both tables by device replaces a range join. A change counts from its own millisecond on.
    """
    sides = events.select("device_id", "timestamp_ms", F.lit(1).alias("_side"), F.lit(None).cast("string").alias("_user"), F.struct(*events.columns).alias("_e")).unionByName(
        changes.select("device_id", "timestamp_ms", F.lit(0).alias("_side"), F.coalesce("user_id", F.lit("")).alias("_user")), allowMissingColumns=True
    )
    order = Window.partitionBy("device_id").orderBy("timestamp_ms", "_side").rowsBetween(Window.unboundedPreceding, 0)
    held = F.nullif(F.last("_user", ignorenulls=True).over(order), F.lit(""))
    return sides.withColumn("user_id", held).where("_side = 1").select("_e.*", "user_id")


def with_context(events: DataFrame, contexts: DataFrame, key: str) -> DataFrame:
    """Events with the device context of their batch or device."""
    return events.join(contexts, key, "left")
