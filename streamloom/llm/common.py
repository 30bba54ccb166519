"""What the operators share: tables, materialised intermediates, name handling."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session in one process may do without: it gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def number_within(rows: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """rows, written, with _nth: their number from 0 among those of equal keys (not null), in no order of theirs.

    Each task numbers its own, from where those of the tasks before it end, so that no group of rows meets in one task.
    """
    part = F.shiftright("_at", 33).alias("_part")
    written = materialise(rows.sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), tag)
    counts = written.groupBy(*keys, part).agg(F.count("*").alias("_k"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_k").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialise(counts.select(*keys, "_part", "_first", before.alias("_before")), f"{tag}-starts")
    joined = written.withColumn("_part", F.shiftright("_at", 33)).join(starts, [*keys, "_part"])
    return joined.withColumn("_nth", F.col("_before") + F.col("_at") - F.col("_first")).select(*rows.columns, "_nth")


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns an operator is about to add, whatever their case: the operator's own win."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of a few rows, so that only a slice at a time becomes Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


BATCH_ROWS, BATCH_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def lighter_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Smaller Arrow batches than Spark's 10,000 rows and 64 MB for this session's texts on their way to Python and back, as
    several batches are held at once on either side. Settings of the user's own, of any value, stay. No operator's result
    depends on them."""
    own = spark.conf.getAll
    for key, value in ((BATCH_ROWS, rows), (BATCH_BYTES, size)):
        if key not in own:
            spark.conf.set(key, str(value))
