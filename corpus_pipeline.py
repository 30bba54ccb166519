"""From raw documents to shards: the training-data operators in a row.

Each stage takes what its predecessor kept, written as Parquet and read again, and returns the columns of documents;
the last adds each row's shard and slot. An empty table gives an empty result; columns besides those of documents are kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from streamloom.llm import decontamination, language, mixing, neardup, sharding
from streamloom.llm.common import shared_folder, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or of no clear language go, so null and empty texts do. Without labelled rows no language is known and all go. Repeated rows are judged alike."""
    return language.drop_unknown(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by 0.8 of their five-word shingles the document of the smallest id stays: a null id only where none has one, of repeated rows one. Null and blank texts are alike."""
    return neardup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go, each row by its own text. Null texts contain nothing."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by weight: a document stays as often as the mix takes it. Documents without a word count nothing and go with their block; a null source is one of its own."""
    return mixing.mix(docs, shard_column=None)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-equal shards, equal texts together unless they outweigh a shard. Columns named like an output are replaced here only."""
    return sharding.shard(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: SQL can express neither the fitted language model nor the seeded draws. Tests hold what each stage keeps against a plain
#: version of it, the mixing stage's draws against their targets and the last stage's shards against its law.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
