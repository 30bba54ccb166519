"""A table of counters by key that batches add to: deltas are appended, readers sum them, folding keeps them few.

A batch adds its own sums once, under its number; the sum of all deltas of a key is its counter, whatever the order. A
fold writes the sums of all files that are in as one table and swaps them for those, so that a reader sees either.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamloom.sources.files import Files, append_numbered, name_of, pending, read_table, recover, swap

SCHEMA = T.StructType([*[T.StructField(c, T.StringType()) for c in ("config_id", "app_id", "window_key")], T.StructField("event_count", T.LongType()), T.StructField("updated_ms", T.LongType())])
KEY = ("config_id", "app_id", "window_key")


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.sum("event_count").alias("event_count"), F.max("updated_ms").alias("updated_ms"))


def add(events: DataFrame, path: str, number: int, sink: str = "one") -> bool:
    """Count a batch of events (config_id, app_id, window_key, timestamp_ms), once."""
    own = events.groupBy(*KEY).agg(F.count("*").alias("event_count"), F.max("timestamp_ms").alias("updated_ms"))
    return append_numbered(own.select(*SCHEMA.names), path, number, sink)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(config_id, app_id, window_key, event_count, updated_ms), one row a key."""
    return _summed(read_table(spark, path, SCHEMA, 0))


def _files(spark: SparkSession, path: str) -> list[str]:
    """The table's files that are in: a file or a few for each batch since the last fold."""
    files = Files(spark, path)
    if not files.exists(path):
        return []
    open_ = tuple(pending(files, path))
    own = [s.getPath().toString() for s in files.fs.listStatus(files.path_of(path)) if s.isFile()]
    return [p for p in own if p.endswith(".parquet") and not (open_ and name_of(p).startswith(open_))]


def fold(spark: SparkSession, path: str, forget_before_ms: int | None = None) -> int:
    """Replace all deltas by their sums, less keys last counted before a time; returns the number of files that went."""
    recover(spark, path)
    files, old = Files(spark, path), _files(spark, path)
    if not old:
        return 0
    made = f"{path}/_folded/{uuid.uuid4().hex}"
    rows = _summed(spark.read.schema(SCHEMA).parquet(*old))
    if forget_before_ms is not None:
        rows = rows.where(F.col("updated_ms") >= forget_before_ms)
    rows.write.parquet(made)
    new = {p: f"{path}/folded-{name_of(p)}" for p in files.below(made) if p.endswith(".parquet")}
    swap(files, path, new, old)
    files.delete(made)
    return len(old)
