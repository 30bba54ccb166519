"""Counters, backlogs and latencies of streams as a table, and independent consumers of one source.

A listener keeps a row for each batch that a query ends; flush() appends what has gathered as a small file. Counters are
sums over the table. Latencies are kept as quantile sketches by query and hour, which merge: hours to days, queries to all.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from streamloom.sources.files import Files

PROGRESS = (
    "query string, name string, batch long, at timestamp, input_rows long, output_rows long, late_rows long, state_rows long, "
    "duration_ms long, watermark string, observed string"
)


class Progress(StreamingQueryListener):
    """Rows of PROGRESS for every batch of the session's queries."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.lock, self.held = threading.Lock(), []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = (
            str(p.id), p.name, p.batchId, datetime.fromisoformat(p.timestamp.replace("Z", "+00:00")), p.numInputRows, p.sink.numOutputRows,
            sum(s.numRowsDroppedByWatermark for s in p.stateOperators), sum(s.numRowsTotal for s in p.stateOperators),
            int(p.durationMs.get("triggerExecution", 0)), p.eventTime.get("watermark"), json.dumps({k: v.asDict() for k, v in p.observedMetrics.items()}, default=str),
        )
        with self.lock:
            self.held.append(row)

    def flush(self) -> int:
        """Append what has gathered; returns the number of rows."""
        with self.lock:
            rows, self.held = self.held, []
        if rows:
            self.spark.createDataFrame(rows, PROGRESS).coalesce(1).write.mode("append").parquet(self.path)
        return len(rows)

    def __enter__(self) -> Progress:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        self.spark.streams.removeListener(self)
        self.flush()


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROGRESS).parquet(path) if Files(spark, path).exists(path) else spark.createDataFrame([], PROGRESS)


def counters(progress: DataFrame) -> DataFrame:
    """(query, batches, input_rows, late_rows, state_rows): totals, and the state as the last batch left it. A batch that was reported twice counts once."""
    once = progress.groupBy("query", "batch").agg(F.max_by(F.struct("input_rows", "late_rows", "state_rows"), "at").alias("p"))
    return once.groupBy("query").agg(
        F.count("*").alias("batches"), F.sum("p.input_rows").alias("input_rows"), F.sum("p.late_rows").alias("late_rows"), F.max_by("p.state_rows", "batch").alias("state_rows")
    )


def latency_sketches(values: DataFrame, column: str, *keys: str) -> DataFrame:
    """(keys, sketch, n): a quantile sketch of a whole-number column for each key; sketches of parts merge to that of the whole."""
    return values.groupBy(*keys).agg(F.kll_sketch_agg_bigint(F.col(column).cast("long")).alias("sketch"), F.count(column).alias("n"))


def merged(sketches: DataFrame, *keys: str) -> DataFrame:
    """Sketches of finer keys as those of coarser ones."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_bigint("sketch").alias("sketch"), F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, *at: float) -> DataFrame:
    """sketches with a column p<percent> for each quantile, instead of the sketch."""
    columns = {f"p{round(q * 100)}": F.kll_sketch_get_quantile_bigint("sketch", F.lit(q)) for q in at}
    return sketches.withColumns(columns).drop("sketch")


def backlog(spark: SparkSession, source: str, checkpoint: str) -> int:
    """Files of a text or Parquet source that a query with this checkpoint has not yet taken into a batch."""
    files = Files(spark, source)
    there = {p for p in files.below(source) if not p.rsplit("/", 1)[-1].startswith(("_", "."))}
    taken = set()
    for log in files.below(f"{checkpoint}/sources/0"):
        taken |= {json.loads(r["value"])["path"] for r in spark.read.text(log).where("value like '{%'").collect()}
    bare = lambda p: p.split(":", 1)[-1].replace("///", "/")
    return len({bare(p) for p in there} - {bare(p) for p in taken})


class Consumers:
    """Several queries over one source, each with its own checkpoint: what becomes of one does not touch the others.

    starts: name -> a function that starts the query (the same checkpoint each time). A query that fails is started again
    up to `restarts` times, from its own checkpoint.
    """

    def __init__(self, starts: dict[str, Callable[[], StreamingQuery]], restarts: int = 3, wait: float = 0.2):
        self.starts, self.left, self.wait = starts, dict.fromkeys(starts, restarts), wait
        self.running: dict[str, StreamingQuery] = {}
        self.failed: dict[str, list[str]] = {name: [] for name in starts}

    def run(self) -> dict[str, list[str]]:
        """Until all have ended; returns each one's failures. One that is out of restarts has as many failures as tries."""
        self.running = {name: start() for name, start in self.starts.items()}
        while self.running:
            for name, query in list(self.running.items()):
                if query.isActive:
                    continue
                error = query.exception()
                del self.running[name]
                if error is not None:
                    self.failed[name].append(str(error)[:500])
                    if self.left[name] > 0:
                        self.left[name] -= 1
                        self.running[name] = self.starts[name]()
            time.sleep(self.wait)
        return self.failed

    def stop(self) -> None:
        for query in self.running.values():
            query.stop()
