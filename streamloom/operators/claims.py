"""Claiming due deliveries: workers take disjoint sets for a time, and what a worker does not finish comes back.

A claim writes its rows (delivery, worker, lease) first and then tries to create the next numbered commit. Of workers that
claim at once one gets the number, the others look again at what is left. A lease that has run out no longer counts, so
its deliveries are due again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.operators.deliveries import OPEN
from streamloom.sources.files import Files, name_of

CLAIM = "id string, worker string, claimed_ms long, lease_until_ms long"


class Claims:
    """The claims below a folder that all workers share. A commit is a file of a few bytes; prune() keeps them few."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path, Files(spark, path)

    def _commits(self) -> dict[int, dict]:
        out = {}
        for p in self.files.below(f"{self.path}/commits"):
            text = self.files.text(p)
            out[int(name_of(p))] = json.loads(text) if text else {}  # one that is being written holds its number already
        return out

    def held(self, now_ms: int) -> DataFrame:
        """Claims whose lease runs."""
        live = [x["rows"] for x in self._commits().values() if x.get("until", 0) > now_ms]
        return self.spark.read.schema(CLAIM).parquet(*live).where(F.col("lease_until_ms") > now_ms) if live else self.spark.createDataFrame([], CLAIM)

    def claim(self, deliveries: DataFrame, worker: str, limit: int, now_ms: int, lease_ms: int, tries: int = 50) -> DataFrame:
        """The limit oldest open deliveries that are due and that nobody holds, now this worker's, as rows of CLAIM."""
        at = F.timestamp_millis(F.lit(now_ms))
        due = deliveries.where(F.col("status").isin(*OPEN) & (F.col("next_attempt_at") <= at))
        for _ in range(tries):
            seen = self._commits()
            free = due.join(self.held(now_ms).select("id"), "id", "left_anti")
            mine = free.orderBy("next_attempt_at", "id").limit(limit).select("id", F.lit(worker).alias("worker"), F.lit(now_ms).cast("long").alias("claimed_ms"), F.lit(now_ms + lease_ms).cast("long").alias("lease_until_ms"))
            rows = f"{self.path}/rows/{uuid.uuid4().hex}"
            mine.write.parquet(rows)
            if self.files.create(f"{self.path}/commits/{max(seen, default=-1) + 1}", json.dumps({"rows": rows, "until": now_ms + lease_ms})):
                return self.spark.read.schema(CLAIM).parquet(rows)
            self.files.delete(rows)
        raise RuntimeError(f"{worker} lost {tries} times")

    def release(self, worker: str, now_ms: int) -> int:
        """End a worker's leases at once; returns how many claims it had. For one that knows that it stops."""
        own = self.held(now_ms).where(F.col("worker") == worker)
        n = own.count()
        rows = {r["f"] for r in own.select(F.regexp_extract("_metadata.file_path", "/rows/([0-9a-f]+)/", 1).alias("f")).distinct().collect()}
        for number, x in self._commits().items():
            if x and x["rows"].rsplit("/", 1)[-1] in rows:
                self.files.write(f"{self.path}/commits/{number}", json.dumps(x | {"until": now_ms}))
        return n

    def prune(self, now_ms: int) -> int:
        """Delete claims whose lease is over; the newest commit stays, as it has the number. Returns how many went."""
        seen = self._commits()
        old = [n for n, x in seen.items() if x and x["until"] <= now_ms and n != max(seen)]
        for n in old:
            self.files.delete(f"{self.path}/commits/{n}")
            self.files.delete(seen[n]["rows"])
        return len(old)


def in_progress(deliveries: DataFrame, claims: DataFrame) -> DataFrame:
    """deliveries with those claimed as in progress since their claim."""
    own = claims.groupBy("id").agg(F.max("claimed_ms").alias("_at"))
    taken = F.col("_at").isNotNull() & F.col("status").isin(*OPEN)
    joined = deliveries.join(own, "id", "left")
    new = {"status": F.when(taken, "in_progress").otherwise(F.col("status")), "last_attempt_at": F.when(taken, F.timestamp_millis("_at")).otherwise(F.col("last_attempt_at"))}
    return joined.withColumns(new).select(*deliveries.columns)
