import json

import pytest
from pyspark.sql import functions as F

from streamloom.operators import dedup
from streamloom.sources import adapter, warehouse
from streamloom.streaming import pipelines


def run(frame, tmp_path, mode="append"):
    out = f"file://{tmp_path}/out"
    frame.writeStream.outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start(out, format="parquet").awaitTermination()
    return frame.sparkSession.read.parquet(out)


@pytest.fixture
def stream(spark, small, tmp_path):
    """The events in files by week, a file a batch."""
    table = adapter.events(spark, small).orderBy("timestamp_ms")
    for k in range(4):
        table.where(F.pmod(F.floor(F.col("timestamp_ms") / 604_800_000), F.lit(4)) == k).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")


def test_dedup_equals_its_batch_twin(spark, small, stream, tmp_path):
    got = run(pipelines.dedup(stream, "60 days").select("idempotency_key"), tmp_path)
    assert sorted(map(str, got.collect())) == sorted(map(str, dedup.first_of_key(adapter.events(spark, small)).select("idempotency_key").collect()))


def test_sessions_and_windows(spark, tmp_path):
    rows = [("d", "a", t * 1000) for t in (0, 10, 40, 71, 200, 9999)]
    spark.createDataFrame(rows, "device_id string, app_id string, timestamp_ms long").coalesce(1).write.parquet(f"file://{tmp_path}/s")
    source = spark.readStream.schema("device_id string, app_id string, timestamp_ms long").parquet(f"file://{tmp_path}/s")
    (tmp_path / "x").mkdir()
    assert sorted(r["events"] for r in run(pipelines.sessions(source, "30 seconds", "1 second"), tmp_path / "x").collect()) == [1, 1, 3]
    (tmp_path / "y").mkdir()
    got = run(pipelines.window_counts(source, 60, "1 second"), tmp_path / "y")
    assert sorted(r["n"] for r in got.collect()) == [1, 1, 3]


def test_sink_splits_and_replaces_retried_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    ok = {"id": "1", "app_id": "a", "device_id": "d", "timestamp_ms": 1718461800000, "screen_view": {"screen_name": "s"}}
    (tmp_path / "in/a.json").write_text("\n".join([json.dumps(ok), "junk", json.dumps({**ok, "id": "2", "app_id": ""})]))
    for _ in range(2):  # the second run stands for a restart with nothing new
        stream = pipelines.envelopes(spark, f"file://{tmp_path}/in")
        pipelines.sink(stream, f"file://{tmp_path}/w", f"file://{tmp_path}/r", f"file://{tmp_path}/k").trigger(availableNow=True).start().awaitTermination()
    rows = warehouse.read(spark, f"file://{tmp_path}/w").collect()
    assert [(r["id"], r["event_type"], r["hour"]) for r in rows] == [("1", "view", 14)]
    assert sorted(r["error"] for r in spark.read.parquet(f"file://{tmp_path}/r").collect()) == ["app_id is required", "unparsable"]


def test_refresh_and_topics(spark):
    calls, now = [], [0.0]
    held = pipelines.Refreshing(lambda: calls.append(1) or len(calls), 30, lambda: now[0])
    assert [held.get(), held.get()] == [1, 1]
    now[0] = 30.0
    assert held.get() == 2
    df = spark.createDataFrame([("events.a.b",), ("anomalies.a",)], "subject string")
    assert pipelines.subscribed(df, "anomalies.>").count() == 1
