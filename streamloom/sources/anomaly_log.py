"""The anomaly log: append-only rows by configuration and day, read in pages from the newest on.

A day of a configuration is a folder with its rows in descending time, so a page reads the newest days that hold enough
rows and nothing of other configurations. Pages go on from the last row seen (its time and event id), not from a count, so
that page n costs as much as page 1 and rows that come in between move nothing.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamloom.functions.scalars import event_time
from streamloom.sources.files import Files, append_numbered, read_table
from streamloom.sources.schemas import ANOMALY_RECORD

PARTITIONS = ("anomaly_config_id", "day")
SCHEMA = T.StructType([*ANOMALY_RECORD.fields, T.StructField("day", T.StringType())])


def append(records: DataFrame, path: str, number: int, sink: str = "one") -> bool:
    """Append a sink's numbered batch of records once."""
    rows = records.select(*ANOMALY_RECORD.names, F.date_format(event_time(F.col("timestamp_ms")), "yyyy-MM-dd").alias("day"))
    # a hot configuration's day is dealt over tasks by time; a file's rows descend, so that its row groups can be skipped
    dealt = rows.repartitionByRange("anomaly_config_id", "day", F.desc("timestamp_ms"), "event_id").sortWithinPartitions("anomaly_config_id", "day", F.desc("timestamp_ms"), F.desc("event_id"))
    return append_numbered(dealt, path, number, sink, PARTITIONS)


def read(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, SCHEMA, len(PARTITIONS))


def folder_of(spark: SparkSession, config_id: str) -> str:
    return f"anomaly_config_id={spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(config_id)}"


def days_of(spark: SparkSession, path: str, config_id: str) -> list[str]:
    """Days with rows of the configuration, newest first: names of folders, nothing is read."""
    names = Files(spark, path).folders(f"{path}/{folder_of(spark, config_id)}")
    return sorted((n.removeprefix("day=") for n in names if n.startswith("day=")), reverse=True)


def page(spark: SparkSession, path: str, config_id: str, limit: int, after: tuple[int, str] | None = None) -> DataFrame:
    """The newest limit records of a configuration, or those that follow the record after (timestamp_ms, event_id). Only the days that the page needs are listed and read."""
    days, seek = days_of(spark, path, config_id), F.lit(True)
    if after is not None:
        last, at = datetime.fromtimestamp(after[0] // 1000, UTC).strftime("%Y-%m-%d"), F.lit(after[0])
        days = [d for d in days if d <= last]
        seek = (F.col("timestamp_ms") < at) | ((F.col("timestamp_ms") == at) & (F.col("event_id") < after[1]))

    def of_days(n: int) -> DataFrame:
        folders = [f"{path}/{folder_of(spark, config_id)}/day={d}" for d in days[:n]]
        own = (F.col("anomaly_config_id") == config_id) & F.col("day").isin(days[:n])
        return read_table(spark, path, SCHEMA, len(PARTITIONS), folders).where(own & seek)

    n = 1
    while n < len(days) and of_days(n).limit(limit).count() < limit:
        n *= 2
    return of_days(n).orderBy(F.desc("timestamp_ms"), F.desc("event_id")).limit(limit)


def drop_before(spark: SparkSession, path: str, day: str) -> int:
    """Delete the days before day (YYYY-MM-DD) of every configuration; returns how many folders went."""
    files = Files(spark, path)
    gone = [f"{path}/{c}/{d}" for c in files.folders(path) if c.startswith("anomaly_config_id=") for d in files.folders(f"{path}/{c}") if d.startswith("day=") and d.removeprefix("day=") < day]
    files.each(files.delete, gone)
    return len(gone)
