"""Reports over the flat events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.sources.schemas import PARTITIONS


def total(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("n"))


def by(events: DataFrame, *columns: str) -> DataFrame:
    """Counts by columns, largest first."""
    return events.groupBy(*columns).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *columns)


def of_month(events: DataFrame, app_id: str, year: int, month: int) -> DataFrame:
    """An app's events of a month; the equalities prune partitions."""
    return events.where((F.col("app_id") == app_id) & (F.col("year") == year) & (F.col("month") == month))


def latest(events: DataFrame, category: str, event_type: str, n: int) -> DataFrame:
    return events.where((F.col("event_category") == category) & (F.col("event_type") == event_type)).orderBy(F.desc("timestamp_ms"), "id").limit(n)


def page(rows: DataFrame, *order: str, offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def partition_sizes(events: DataFrame) -> DataFrame:
    return events.groupBy(*PARTITIONS).agg(F.count("*").alias("n"))


def field(events: DataFrame, name: str, path: str) -> DataFrame:
    """events with a field of the payload."""
    return events.withColumn(name, F.get_json_object("payload_json", path))
