"""Exact deduplication by idempotency key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamloom.operators.folds import keep_spaced

KEY = "idempotency_key"


def _keyed(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    empty = F.coalesce(F.col(KEY), F.lit("")) == ""
    return events.where(~empty), events.where(empty)


def first_of_key(events: DataFrame) -> DataFrame:
    """The earliest event of each key by (timestamp_ms, id); events without a key all pass.

    min_by aggregates before the shuffle, so a key that is most of the table moves as one row a task.
    """
    keyed, free = _keyed(events)
    first = keyed.groupBy(KEY).agg(F.min_by(F.struct(*events.columns), F.struct("timestamp_ms", "id")).alias("_e")).select("_e.*")
    return first.unionByName(free)


def first_within(events: DataFrame, window_ms: int) -> DataFrame:
    """Events at least window_ms after the last kept event of their key; events without a key all pass."""
    keyed, free = _keyed(events)
    return keep_spaced(keyed, [KEY], "timestamp_ms", F.lit(window_ms).cast("long"), "id").unionByName(free)


def unseen(events: DataFrame, seen: DataFrame) -> DataFrame:
    """Events whose key is not among keys seen before."""
    keyed, free = _keyed(events)
    return keyed.join(seen.select(KEY).where(F.col(KEY).isNotNull()).distinct(), KEY, "left_anti").select(*events.columns).unionByName(free)


def insert_ignore(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """table with the rows of new whose key it lacks; of new rows with one key the first."""
    first = Window.partitionBy(key).orderBy(*[c for c in new.columns if c != key])
    fresh = new.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").join(table.select(key), key, "left_anti")
    return table.unionByName(fresh.select(*table.columns))


def newest(events: DataFrame, n: int) -> DataFrame:
    """The newest n events of each device."""
    order = Window.partitionBy("device_id").orderBy(F.desc("timestamp_ms"), F.desc("id"))
    return events.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")
