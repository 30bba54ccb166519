"""Streaming twins of the batch operators. Time is event time; every path but the sink's drops what is later than its watermark."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from streamloom.functions.scalars import YEAR_ONE, event_time, matches_topic
from streamloom.operators.classify import flatten
from streamloom.operators.ingest import decoded, split_poison, validate
from streamloom.operators import anomaly, rules
from streamloom.sources import anomaly_log, warehouse
from streamloom.sources.files import Files, marked, name_of
from streamloom.sources.schemas import ENVELOPE, EVENT_ROW


def envelopes(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """JSON lines as a stream; a bounded number of files a batch is the back-pressure. Unparsed lines keep their text."""
    return decoded(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path))


def subscribed(stream: DataFrame, pattern: str, subject: str = "subject") -> DataFrame:
    return stream.where(matches_topic(F.col(subject), pattern))


def with_time(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", event_time(F.col("timestamp_ms"))).withWatermark("ts", late)


def dedup(events: DataFrame, window: str = "10 minutes") -> DataFrame:
    """Drop repeated keys within the window; exact, no false positives. Events without a key pass."""
    empty = F.coalesce(F.col("idempotency_key"), F.lit("")) == ""
    # a key that no other event has stands for the empty ones, so that one stateful path serves all
    keyed = with_time(events, window).withColumn("_key", F.when(empty, F.concat(F.lit("\u0000"), F.col("id"))).otherwise(F.col("idempotency_key")))
    return keyed.dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def window_counts(events: DataFrame, seconds: int, late: str = "10 minutes") -> DataFrame:
    """Events by app and window of so many seconds, windows counted from the year 1."""
    start = f"{(-YEAR_ONE) % seconds} seconds"
    return with_time(events, late).groupBy("app_id", F.window("ts", f"{seconds} seconds", startTime=start)).agg(F.count("*").alias("n")).select("app_id", F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    return with_time(events, late).groupBy("device_id", F.session_window("ts", gap)).agg(F.count("*").alias("events")).select("device_id", F.col("session_window.start").alias("start"), "events")


def query_of(files: Files, checkpoint: str) -> str:
    """Id of the query that owns the checkpoint: the same after a restart, another one with another checkpoint."""
    return json.loads(files.text(f"{checkpoint}/metadata"))["id"]


def sink(stream: DataFrame, path: str, rejects: str, checkpoint: str, compression: str = "snappy", least_rows: int = 0, seconds: float = 0, clock: Callable[[], float] = time.time) -> DataStreamWriter:
    """Valid envelopes into the warehouse, poison and invalid ones into a reject table.

    The table is the warehouse's own, for its reading, compaction and retention. A batch is appended once under its
    query and number, so that a retry adds nothing and another query's batches are its own; late events land in the hour
    of their time whenever they come. With least_rows, small batches wait in the shared folder until they are so many rows
    or the oldest is so many seconds old (see Carried); without, each is written. An empty batch writes nothing.
    """
    spark = stream.sparkSession
    files = Files(spark, path)

    def write(batch: DataFrame, number: int) -> None:
        query = query_of(files, checkpoint)
        batch = batch.persist()
        if not batch.isEmpty():
            good, poison = split_poison(batch)
            checked = validate(good)
            bad = poison.select("record", F.lit("unparsable").alias("error")).unionByName(checked.where("error is not null").select(F.to_json(F.struct(*ENVELOPE.names)).alias("record"), "error"))
            bad.write.mode("overwrite").parquet(f"{rejects}/query={query}/batch={number}")
            rows = flatten(checked.where("error is null").drop("error"))
            if not least_rows:
                warehouse.append_batch(rows, path, number, compression, query)
            else:
                Carried(spark, path, query, least_rows, seconds, clock).add(rows, number)
        if least_rows:
            Carried(spark, path, query, least_rows, seconds, clock).flush(number, compression)
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


class Carried:
    """A query's small batches on their way to the warehouse, in its folder _carried: rows and a note with their number and the time.

    A batch of the number that the sink's mark has, or of a lower one, is in the table already and dropped when it is seen
    again; so whatever a crash leaves, a row is written once.
    """

    def __init__(self, spark: SparkSession, path: str, query: str, rows: int, seconds: float, clock: Callable[[], float] = time.time):
        self.spark, self.path, self.query, self.rows, self.seconds, self.clock = spark, path, query, rows, seconds, clock
        self.files, self.folder = Files(spark, path), f"{path}/_carried/{query}"

    def _notes(self) -> dict[int, dict]:
        done = marked(self.files, self.path, self.query)
        found = {int(name_of(p)): json.loads(self.files.text(p)) for p in self.files.below(f"{self.folder}/notes")}
        for n in [n for n in found if n <= done]:
            self._drop(n)
            del found[n]
        return found

    def _drop(self, number: int) -> None:
        self.files.delete(f"{self.folder}/rows/batch={number}")
        self.files.delete(f"{self.folder}/notes/{number}")

    def add(self, rows: DataFrame, number: int) -> None:
        """Keep a batch's rows; a retry replaces them but not their time."""
        if number <= marked(self.files, self.path, self.query):
            return
        known = self._notes().get(number)
        rows.write.mode("overwrite").parquet(f"{self.folder}/rows/batch={number}")
        n = self.spark.read.parquet(f"{self.folder}/rows/batch={number}").count()
        self.files.write(f"{self.folder}/notes/{number}", json.dumps({"rows": n, "at": known["at"] if known else self.clock()}))

    def flush(self, number: int, compression: str = "snappy", now: bool = False) -> int:
        """Write what waits if it is enough, old enough or wanted now; returns its rows."""
        notes = self._notes()
        total = sum(x["rows"] for x in notes.values())
        due = now or total >= self.rows or (notes and self.clock() - min(x["at"] for x in notes.values()) >= self.seconds)
        if not total or not due:
            return 0
        rows = self.spark.read.schema(EVENT_ROW).parquet(*[f"{self.folder}/rows/batch={n}" for n in sorted(notes)])
        warehouse.append_batch(rows, self.path, number, compression, self.query)
        for n in notes:
            self._drop(n)
        return total


def with_ticks(stream: DataFrame) -> DataFrame:
    """stream with a batch for every trigger, empty or not, so that what waits for its time is written without new rows. For triggers of a processing time."""
    ticks = stream.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load().where("false")
    return stream.unionByName(ticks.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema.fields]))


class Refreshing:
    """A configuration, as load gives it, that is read again when older than so many seconds."""

    def __init__(self, load: Callable, seconds: float, clock: Callable[[], float] = time.monotonic):
        self.load, self.seconds, self.clock = load, seconds, clock
        self.at: float | None = None

    def get(self):
        if self.at is None or self.clock() - self.at >= self.seconds:
            self.table, self.at = self.load(), self.clock()
        return self.table


def live_hits(stream: DataFrame, load: Callable[[], DataFrame], seconds: float, write: Callable[[DataFrame, int], None], document: str = "payload_json", clock: Callable[[], float] = time.monotonic) -> DataStreamWriter:
    """Rule hits of each batch to write(hits, number), by rules that are loaded and compiled again when older than so many seconds: a rule that is added, changed or switched off holds for the running stream."""
    held = Refreshing(lambda: rules.Compiled(load(), document), seconds, clock)
    return stream.writeStream.foreachBatch(lambda batch, number: write(held.get().hits(batch), number))


def live_alerts(stream: DataFrame, load: Callable[[], DataFrame], seconds: float, log: str, sink_name: str, document: str = "payload_json", clock: Callable[[], float] = time.monotonic) -> DataStreamWriter:
    """Threshold alerts of each batch into the anomaly log, by configurations that are loaded again when older than so many seconds. Cooldowns hold over batches: the log's last alerts count as kept."""
    spark = stream.sparkSession
    held = Refreshing(lambda: anomaly.Configured(load(), "threshold"), seconds, clock)

    def write(batch: DataFrame, number: int) -> None:
        found = anomaly.threshold(batch, held.get(), document)
        # a retried batch sees no rows of its own: they are hidden until all are in, and then it has nothing to do
        kept = anomaly.cooled_after(found, anomaly.last_alerts(anomaly_log.read(spark, log)))
        anomaly_log.append(anomaly.records(kept, "threshold"), log, number, sink_name)

    return stream.writeStream.foreachBatch(write)


def observed(events: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """events whose progress reports carry these aggregates."""
    return events.observe(name, *[c.alias(n) for n, c in metrics.items()])
