"""Keyed state: every stream equals its batch twin as far as its watermark has come, however its rows are dealt."""

import pytest
from pyspark.sql import functions as F

from streamloom.operators import dedup, folds, sessions
from streamloom.streaming import states

#: The epoch itself would be late: watermarks begin there.
BEGIN = 1_700_000_040_000
SCHEMA = "id string, k string, timestamp_ms long, gap long, event_type string"


@pytest.fixture
def files(spark, tmp_path):
    """Write lists of rows as files, a batch each; returns the stream."""

    def write(*batches, schema=SCHEMA):
        for b in batches:
            spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")

    return write


def run(frame, tmp_path):
    out = f"file://{tmp_path}/out"
    query = frame.writeStream.outputMode("append").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start(out, format="parquet")
    query.awaitTermination()
    return frame.sparkSession.read.parquet(out)


def row(n, k, seconds, gap=60, kind="x"):
    return (None if n is None else f"{n:03}", k, BEGIN + seconds * 1000, gap * 1000, kind)


def test_spaced_rows_in_any_order(spark, files, tmp_path):
    rows = [row(i, "a" if i % 3 else None, i * 17 % 400) for i in range(60)] + [row(60, "a", 34), row(60, "a", 34), row(None, "a", 34)]
    late = [rows[i::3] for i in (2, 0, 1)]
    got = run(states.spaced(files(*late, [row(99, "end", 5000)]), ("k",), "gap", "10 minutes"), tmp_path)
    twin = folds.keep_spaced(spark.createDataFrame(rows, SCHEMA), ["k"], "timestamp_ms", F.col("gap"), "id")
    assert sorted(map(str, got.collect())) == sorted(map(str, twin.collect()))


def test_keys_are_forgotten_and_start_anew(spark, files, tmp_path):
    stream = files([row(1, "a", 0), row(2, "a", 30)], [row(3, "b", 4000)], [row(4, "a", 4100), row(5, "b", 4010)], [row(6, "c", 9000)], [row(7, "c", 9001)])
    got = run(states.spaced(stream, ("k",), "gap", "1 minute", ttl_ms=100_000), tmp_path)
    assert sorted(r["id"] for r in got.collect()) == ["001", "003", "004"]
    held = spark.read.format("statestore").option("stateVarName", "last").load(f"file://{tmp_path}/state")
    assert held.count() == 0  # c is not due yet, a and b are forgotten
    waiting = spark.read.format("statestore").option("stateVarName", "next").load(f"file://{tmp_path}/state")
    assert [r["key"]["k"] for r in waiting.collect()] == ["c"]


def test_a_restart_goes_on_where_it_was(spark, files, tmp_path):
    run(states.spaced(files([row(1, "a", 0)], [row(2, "b", 1000)]), ("k",), "gap", "1 minute"), tmp_path)
    got = run(states.spaced(files([row(3, "a", 955), row(4, "a", 30)], [row(5, "b", 2000)], [row(6, "b", 2001)]), ("k",), "gap", "1 minute"), tmp_path)
    # the row at 30 s is later than the watermark
    assert sorted(r["id"] for r in got.collect()) == ["001", "002", "003"]


def test_first_of_key_and_rows_without_a_key(spark, files, tmp_path):
    schema = "id string, idempotency_key string, timestamp_ms long"
    rows = [(str(i), [None, "", "a", "b", "c"][i % 5], BEGIN + (997 * i) % 600 * 1000) for i in range(50)]
    got = run(states.first_within(files(rows[::2], rows[1::2], [("end", "z", BEGIN + 9_000_000)], schema=schema), 10**9, "10 minutes"), tmp_path)
    twin = dedup.first_of_key(spark.createDataFrame(rows, schema))
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in twin.collect())


def test_rows_over_a_windows_limit(spark, files, tmp_path):
    schema = "id string, config_id string, app_id string, timestamp_ms long, window_start long, window_seconds int, most int"
    rows = [(f"{i:03}", "c", f"a{i % 2}", BEGIN + (7919 * i) % 600 * 1000, BEGIN // 1000 + (7919 * i) % 600 // 60 * 60, 60, 2) for i in range(90)]
    got = run(states.rate_alerts(files(rows[::2], rows[1::2], [("end", "c", "z", BEGIN + 9_000_000, BEGIN // 1000 + 9000, 60, 2)], schema=schema), "10 minutes"), tmp_path)
    expect, seen = [], {}
    for r in sorted(rows, key=lambda r: (r[3], r[0])):
        seen[r[2], r[4]] = seen.get((r[2], r[4]), 0) + 1
        if seen[r[2], r[4]] > 2:
            expect.append((r[0], seen[r[2], r[4]]))
    assert sorted((r["id"], r["running"]) for r in got.collect()) == sorted(expect)
    assert spark.read.format("statestore").option("stateVarName", "count").load(f"file://{tmp_path}/state").count() == 0


def test_sessions_equal_their_batch_twin(spark, files, tmp_path):
    kinds = ["x", "app_background", "x", "app_foreground", "x"]
    at = [0, 10, 35, 45, 60, 100, 110, 125, 150, 151, 400, 405, 437, 438, 500]
    rows = [row(i, f"d{k}", t + k, kind=kinds[(i + k) % 5]) for k in range(3) for i, t in enumerate(at)]
    stream = files(rows[::2], rows[1::2], [row(99, "end", 9000)]).withColumnRenamed("k", "device_id")
    got = run(states.session_boundaries(stream, 30_000, "20 minutes"), tmp_path)
    batch = sessions.summaries(sessions.sessionize(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("k", "device_id"), 30_000))
    ends = {(r["device_id"], r["session_no"], r["end_ms"], r["events"], r["duration_ms"]) for r in batch.collect()}
    own = got.where("device_id <> 'end'").collect()
    assert {(r["device_id"], r["session_no"], r["timestamp_ms"], r["events"], r["duration_ms"]) for r in own if r["event_type"] == "session_end"} == ends
    assert {(r["device_id"], r["session_no"], r["timestamp_ms"]) for r in own if r["event_type"] == "session_start"} == {(r["device_id"], r["session_no"], r["start_ms"]) for r in batch.collect()}


def test_a_timer_of_an_earlier_item_does_not_forget_a_later_one(spark, files, tmp_path):
    """When the timer of the first kept item and that of a waiting one run out together, the item kept then still counts."""
    stream = files([row(1, "a", 0)], [row(2, "b", 10)], [row(3, "a", 61), row(4, "b", 70)], [row(5, "a", 90), row(6, "b", 200)], [row(7, "b", 300)], [row(8, "b", 400)])
    got = run(states.spaced(stream, ("k",), "gap", "1 second"), tmp_path)
    assert sorted(r["id"] for r in got.where("k = 'a'").collect()) == ["001", "003"]


def test_buckets_store_many_keys_in_few_states(spark, files, tmp_path, monkeypatch):
    """Keys of a bucket share one waiting list and one timer; results are those of each key by itself."""
    monkeypatch.setattr(states, "BUCKETS", 4)
    schema = "id string, idempotency_key string, timestamp_ms long"
    rows = [(f"{i:04}", f"k{i % 300}", BEGIN + (997 * i) % 600 * 1000) for i in range(900)]
    got = run(states.first_within(files(rows[::2], rows[1::2], [("end", "z", BEGIN + 9_000_000)], schema=schema), 120_000, "10 minutes"), tmp_path)
    twin = dedup.first_within(spark.createDataFrame(rows, schema), 120_000)
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in twin.collect())
    assert spark.read.format("statestore").option("stateVarName", "next").load(f"file://{tmp_path}/state").count() <= 4


def test_buckets_end_and_forget_sessions_like_single_keys(spark, files, tmp_path):
    rows = [row(i, f"d{i % 5}", (i * 37) % 900, kind=["x", "app_background", "app_foreground"][i % 3]) for i in range(120)]
    stream = files(rows[::2], [row(98, "end", 1600)], [row(97, "d1", 1500), row(99, "end", 4000)], [row(96, "end", 9000)]).withColumnRenamed("k", "device_id")
    given = stream.select("device_id", "id", "timestamp_ms", "event_type")
    kept = []
    for k, buckets in enumerate((None, 2)):
        one = states.Sessions(states._with_time(given.schema), 30_000, 60_000)
        found = run(states._run(given, "10 minutes", ("device_id",), one, states.BOUNDARY, buckets), tmp_path / str(k)).collect()
        kept.append(sorted(map(str, found)))
    assert kept[0] == kept[1] and len(kept[0]) > 10
