import random
from datetime import UTC, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamloom.operators import anomaly, dedup, deliveries, folds, sessions
from streamloom.sources import adapter
from streamloom.sources.schemas import DELIVERY

EVENT = "id string, app_id string, device_id string, event_category string, event_type string, timestamp_ms long, payload_json string, idempotency_key string"


def rows(spark, *given):
    fill = {"app_id": "a", "device_id": "d", "event_category": "c", "event_type": "t", "timestamp_ms": 0, "payload_json": "{}", "idempotency_key": ""}
    names = [x.split()[0] for x in EVENT.split(", ")]
    return spark.createDataFrame([tuple((fill | {"id": f"{i:03}"} | g)[n] for n in names) for i, g in enumerate(given)], EVENT)


def test_threshold(spark):
    e = rows(spark, *[{"payload_json": p} for p in ('{"v":-1}', '{"v":150}', '{"v":0}', '{"v":100}', '{"v":"x"}', "{}", '{"v":"101"}', '{"v":true}')])
    got = anomaly.threshold(e, adapter.configs(spark, {"id": "t", "name": "t", "detection_type": "threshold", "path": "v", "min": 0.0, "max": 100.0}))
    assert {r["id"]: r["violation"] for r in got.collect()} == {"000": "below_min", "001": "above_max", "006": "above_max"}


def test_rate_then_cooldown(spark):
    e = rows(spark, *[{"timestamp_ms": 60_000 + i} for i in range(5)], {"timestamp_ms": 120_000})
    config = adapter.configs(spark, {"id": "r", "name": "r", "detection_type": "rate", "max_per_minute": 3})
    found = anomaly.rate(e, config)
    assert sorted((r["id"], r["running"]) for r in found.collect()) == [("003", 4), ("004", 5)]
    assert [r["id"] for r in anomaly.cooled(found).collect()] == ["003"]
    record = anomaly.records(anomaly.cooled(found), "rate").first()
    assert record["details"] == '{"rate":4,"max_per_minute":3,"window":"1970-01-01T00:01"}' and record["topic"] == "anomalies.a.r"


def test_repeated_and_keyless_items(spark):
    """A redelivered event is kept once, an id may be missing, and a long run without a gap passes in order."""
    e = rows(spark, *[{"id": "x", "idempotency_key": "k", "timestamp_ms": 5}] * 3, {"id": None, "idempotency_key": "k", "timestamp_ms": 2000}, {"id": "y", "idempotency_key": "k", "timestamp_ms": 2000})
    got = dedup.first_within(e, 600).collect()
    assert [(r["id"], r["timestamp_ms"]) for r in sorted(got, key=lambda r: r["timestamp_ms"])] == [("x", 5), (None, 2000)]
    run = spark.range(20_000).selectExpr("cast(id as string) id", "id * 10 timestamp_ms", "'a' app_id", "cast(null as string) config_id", "1 cooldown_seconds")
    assert sorted(r["timestamp_ms"] for r in anomaly.cooled(run.unionByName(run)).collect()) == list(range(0, 200_000, 1000))


def test_cooldown_boundaries(spark):
    at = [0, 100, 299, 300, 301, 599, 600, 900]
    e = rows(spark, *[{"timestamp_ms": s * 1000} for s in at]).withColumns({"config_id": F.lit("x"), "cooldown_seconds": F.lit(300)})
    assert sorted(r["timestamp_ms"] // 1000 for r in anomaly.cooled(e).collect()) == [0, 300, 600, 900]


def test_dedup(spark):
    e = rows(spark, *[{"idempotency_key": k, "timestamp_ms": t} for k, t in (("k", 0), ("k", 5), ("k", 700), ("j", 1), ("", 1), ("", 1))])
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(dedup.first_of_key(e)) == ["000", "003", "004", "005"]
    assert ids(dedup.first_within(e, 600)) == ["000", "002", "003", "004", "005"]
    assert ids(dedup.unseen(e, rows(spark, {"idempotency_key": "k"}))) == ["003", "004", "005"]
    assert ids(dedup.newest(e, 2)) == ["001", "002"]


@pytest.mark.parametrize(
    ("times", "expect"),
    [([0, 10], [(0, 10)]), ([0, 31], [(0, 0), (31, 31)]), ([0, 30], [(0, 30)]), ([0, 10, 15, 25, 56], [(0, 25), (56, 56)])],
)
def test_sessions(spark, times, expect):
    got = sessions.summaries(sessions.sessionize(rows(spark, *[{"timestamp_ms": t * 1000} for t in times])))
    assert sorted((r["start_ms"] // 1000, r["end_ms"] // 1000) for r in got.collect()) == expect
    ends = sessions.boundary_events(got).where("event_type = 'session_end'").collect()
    assert sorted(r["duration_ms"] for r in ends) == sorted((e - s) * 1000 for s, e in expect)


def test_long_background_ends_a_session(spark):
    timeline = [("t", 0), ("app_background", 5), ("t", 20), ("app_foreground", 36), ("t", 40), ("app_background", 50), ("app_foreground", 60)]
    got = sessions.sessionize(rows(spark, *[{"event_type": k, "timestamp_ms": t * 1000} for k, t in timeline]), 30_000)
    assert [r["session_no"] for r in got.orderBy("timestamp_ms").collect()] == [1, 1, 1, 2, 2, 2, 2]


def test_identity(spark):
    e = rows(spark, *[{"timestamp_ms": t} for t in (0, 10, 15, 20, 30)])
    changes = spark.createDataFrame([("d", 10, "u1"), ("d", 20, None), ("d", 25, "u2"), ("other", 0, "x")], "device_id string, timestamp_ms long, user_id string")
    assert [r["user_id"] for r in sessions.identity_as_of(e, changes).orderBy("timestamp_ms").collect()] == [None, "u1", "u1", None, "u2"]


def test_delivery_attempts(spark):
    now = F.lit(datetime(2024, 1, 1, tzinfo=UTC))
    base = {f.name: None for f in DELIVERY.fields} | {"status": "pending", "max_attempts": 5, "next_attempt_at": datetime(2023, 1, 1)}
    given = [("0", "w1", 0), ("3", "w1", 3), ("4", "w1", 4), ("ok", "w2", 1), ("none", "w9", 0), ("off", "w3", 0), ("untried", "w1", 2)]
    table = spark.createDataFrame([tuple((base | {"id": i, "webhook_id": w, "attempts": n})[f.name] for f in DELIVERY.fields) for i, w, n in given], DELIVERY)
    hooks = spark.createDataFrame([("w1", True), ("w2", True), ("w3", False)], "id string, enabled boolean")
    answers = spark.createDataFrame([(i, 200 if i in ("ok", "off", "none") else 503) for i, _, _ in given], "id string, status_code int")
    results = deliveries.attempt_results(table.where("id <> 'untried'"), hooks, answers)
    got = {r["id"]: r for r in deliveries.apply_attempts(table, results, now).collect()}
    at = lambda i: (got[i]["next_attempt_at"] - datetime(2024, 1, 1)).total_seconds()
    assert (got["0"]["status"], got["0"]["attempts"], at("0")) == ("pending", 1, 1.0)
    assert (got["3"]["status"], at("3")) == ("pending", 8.0)
    assert (got["4"]["status"], got["4"]["attempts"], got["4"]["last_status_code"]) == ("dead_letter", 5, 503)
    assert got["ok"]["status"] == "delivered" and got["ok"]["delivered_at"] == datetime(2024, 1, 1)
    assert (got["none"]["last_error"], got["off"]["last_error"]) == ("webhook not found", "webhook is disabled")
    assert got["untried"]["attempts"] == 2 and got["untried"]["last_attempt_at"] is None
    again = {r["id"]: r for r in deliveries.retry_dead(spark.createDataFrame(list(got.values()), DELIVERY), ["4"], now).collect()}
    assert (again["4"]["status"], again["4"]["attempts"]) == ("pending", 0)


def plain_spaced(rows, gap):
    """Row by row: (key, at, id) kept."""
    out, last = [], {}
    for key, at, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        if key not in last or at - last[key] >= gap:
            last[key] = at
            out.append((key, at, i))
    return out


@pytest.mark.parametrize("gap", [0, 1, 7, 60, 5000])
def test_spaced_items_over_many_stretches(spark, gap):
    """A hot key, periodic and random arrivals, single items, negative times."""
    draw = random.Random(gap)
    rows = [("hot", draw.randrange(-4000, 4000), i) for i in range(4000)] + [("even", 3 * i, i) for i in range(900)] + [(None, draw.randrange(300), i) for i in range(100)]
    rows += [(f"k{i}", draw.randrange(1000), i) for i in range(200)] + [(f"k{i % 50}", draw.randrange(1000), i) for i in range(200, 400)]
    table = spark.createDataFrame(rows, "key string, at long, id int").repartition(6)
    with_gap = folds.keep_spaced(table, ["key"], "at", F.lit(gap), "id")
    assert sorted(map(str, map(tuple, with_gap.collect()))) == sorted(map(str, plain_spaced(rows, gap)))


def test_a_batch_is_not_the_end_of_a_stretch(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        test_spaced_items_over_many_stretches(spark, 60)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_a_hot_key_is_sorted_in_many_tasks_and_thinned(spark):
    """One key holds nine tenths of the rows: no task of the first pass sorts twice its share, few rows reach the second."""
    n, parts = 40_000, 16
    rows = spark.range(n).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("key"), (F.xxhash64("id") % 1_000_000).alias("at"), "id")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        dealt = rows.withColumn("_s", F.floor(F.col("at") / (500 * folds.STRETCH))).repartition("key", "_s")
        sizes = [r["n"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert max(sizes) < 2 * n / parts
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    hot = np.sort(np.array([r["at"] for r in rows.where("key = 'hot'").collect()]))
    left = 0
    for s in np.unique(hot // (500 * folds.STRETCH)):
        own = hot[hot // (500 * folds.STRETCH) == s]
        left += int(folds.Chains(int(own[0]), 500).take(own).sum())
    assert left < len(hot) / 3


def test_configurations_of_any_shape(spark):
    """Filters with and without each column, by one row an event and pair, and none at all."""
    given = [{"id": f"c{k}", "name": "n", "detection_type": "threshold", "path": "k", "min": 5.0, **{c: v for bit, (c, v) in enumerate((("app_id", "a"), ("event_category", "c"), ("event_type", "t"))) if k >> bit & 1}} for k in range(8)]
    events = rows(spark, *[{"payload_json": '{"k":1}', **e} for e in ({}, {"app_id": "b"}, {"event_category": None}, {"event_type": "u"})])
    got = sorted((r["id"], r["config_id"]) for r in anomaly.threshold(events, adapter.configs(spark, *given)).collect())
    allowed = {"000": range(8), "001": (0, 2, 4, 6), "002": (0, 1, 4, 5), "003": range(4)}
    assert got == sorted((e, f"c{k}") for e, ks in allowed.items() for k in ks)
    one = adapter.configs(spark, given[3])
    assert [r["id"] for r in anomaly.threshold(events, one).collect()] == ["000", "003"]
    assert anomaly.threshold(events, one.where("false")).count() == 0
