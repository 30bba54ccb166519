"""Records that fail are delivered again, a limited number of times, and then put with the dead letters.

A ledger in the shared folder holds what waits for its next try. Each batch takes the new records and the ledger's, hands
them to the consumer and writes the ledger anew under its own number; the one before stays until the batch after, so a
batch that is retried starts from the same ledger and counts nothing twice. A record is known by the batch that brought it
and its place there, so equal records are counted apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from streamloom.operators.ingest import dead_letters
from streamloom.sources.files import Files, name_of

RECORD = "record string, arrived_ms long, batch long, place long, tries int"
FAILED = f"{RECORD}, error string"


def lines(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """(record, arrived_ms) of the lines of text files as a stream; a record arrives when its file does."""
    read = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return read.select(F.col("value").alias("record"), F.unix_millis("_metadata.file_modification_time").alias("arrived_ms"))


class Ledger:
    """Waiting records and dead letters of one consumer, below a folder."""

    def __init__(self, spark: SparkSession, path: str, subject: str, stream: str, consumer: str, most: int):
        self.spark, self.path, self.files = spark, path, Files(spark, path)
        self.subject, self.stream, self.consumer, self.most = subject, stream, consumer, most

    def _folder(self, kind: str, number: int) -> str:
        return f"{self.path}/{kind}/batch_no={number}"

    def waiting(self, number: int) -> DataFrame:
        """What waits after a batch."""
        folder = self._folder("waiting", number)
        return self.spark.read.schema(FAILED).parquet(folder) if self.files.exists(f"{folder}/_SUCCESS") else self.spark.createDataFrame([], FAILED)

    def dead(self) -> DataFrame:
        """The dead letters with where they came from."""
        folder = f"{self.path}/dead"
        rows = self.spark.read.schema(FAILED).parquet(folder) if self.files.exists(folder) else self.spark.createDataFrame([], FAILED)
        return dead_letters(rows, self.subject, self.stream, self.consumer)

    def deliver(self, batch: DataFrame, number: int, consume: Callable[[DataFrame, int], DataFrame]) -> None:
        """One batch: consume(records, number) returns those that failed, with error; the others are done."""
        new = batch.select("record", "arrived_ms", F.lit(number).cast("long").alias("batch"), F.monotonically_increasing_id().alias("place"), F.lit(0).alias("tries"))
        given = new.unionByName(self.waiting(number - 1).drop("error")).persist()
        failed = consume(given, number).select(*given.columns, "error").withColumn("tries", F.col("tries") + 1).persist()
        over = F.col("tries") >= self.most
        failed.where(over).write.mode("overwrite").parquet(self._folder("dead", number))
        failed.where(~over).write.mode("overwrite").parquet(self._folder("waiting", number))
        for p in self.files.folders(f"{self.path}/waiting"):
            if int(p.removeprefix("batch_no=")) < number - 1:
                self.files.delete(f"{self.path}/waiting/{p}")
        failed.unpersist()
        given.unpersist()

    def attach(self, stream: DataFrame, consume: Callable[[DataFrame, int], DataFrame]) -> DataStreamWriter:
        """A query over records (record, arrived_ms). With pipelines.with_ticks the waiting ones are tried at every trigger, else with the next new ones."""
        return stream.writeStream.foreachBatch(lambda batch, number: self.deliver(batch, number, consume))


def last_number(ledger: Ledger) -> int:
    """The last batch that the ledger has; -1 before the first."""
    found = [int(name_of(p).removeprefix("batch_no=")) for p in ledger.files.folders(f"{ledger.path}/waiting")]
    return max(found, default=-1)
