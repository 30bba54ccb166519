"""Logs, counters, claims, ledgers and what streams write to them."""

import json
import os
import threading
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from streamloom.operators import anomaly, claims, rules
from streamloom.sources import adapter, anomaly_log, counters, warehouse
from streamloom.sources.schemas import ANOMALY_RECORD, DELIVERY
from streamloom.streaming import metrics, pipelines, redelivery

BEGIN = 1_700_000_000_000


def records(spark, *given):
    rows = [(config, "a", "c", "t", "threshold", event, at, "{}", "x", "{}") for config, event, at in given]
    return spark.createDataFrame(rows, ANOMALY_RECORD)


def test_log_pages_follow_each_other_and_skip_files(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    given = [("one/é", f"{i:03}", BEGIN + i * 3_600_000 // 2 * 2) for i in range(90)] + [("two", f"{i:03}", BEGIN + i) for i in range(30)]
    for k in range(3):
        anomaly_log.append(records(spark, *given[k::3]), path, k)
        anomaly_log.append(records(spark, *given[k::3]), path, k)
    assert anomaly_log.read(spark, path).count() == 120
    seen, after = [], None
    while rows := anomaly_log.page(spark, path, "one/é", 20, after).collect():
        seen += [r["event_id"] for r in rows]
        after = (rows[-1]["timestamp_ms"], rows[-1]["event_id"])
    assert seen == sorted((e for c, e, _ in given if c == "one/é"), reverse=True)
    page = anomaly_log.page(spark, path, "one/é", 20, (BEGIN + 60 * 3_600_000, "060"))
    assert len(page.inputFiles()) < len(anomaly_log.read(spark, path).inputFiles())
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "anomaly_config_id" in plan.split("PartitionFilters")[1].split("]")[0] and "day" in plan.split("PartitionFilters")[1]
    # rows that come in later do not move the pages that follow
    anomaly_log.append(records(spark, ("one/é", "new", BEGIN + 10**9)), path, 3)
    assert [r["event_id"] for r in anomaly_log.page(spark, path, "one/é", 20, (BEGIN + 60 * 3_600_000, "060")).collect()] == seen[30:50]
    assert anomaly_log.page(spark, path, "none", 20).count() == 0
    assert anomaly_log.drop_before(spark, path, "2023-11-16") > 0
    assert {r["day"] for r in anomaly_log.read(spark, path).select("day").distinct().collect()} == set(anomaly_log.days_of(spark, path, "one/é"))


def test_counters_over_batches_equal_one_batch(spark, tmp_path):
    schema = "config_id string, app_id string, window_key string, timestamp_ms long"
    rows = [(f"c{i % 2}", None if i % 7 == 0 else f"a{i % 3}", f"w{i % 4}", BEGIN + i) for i in range(100)]
    expect = {}
    for c, a, w, at in rows:
        n, last = expect.get((c, a, w), (0, 0))
        expect[c, a, w] = (n + 1, max(last, at))
    path = f"file://{tmp_path}/n"
    for k in range(3):
        for _ in range(2):
            counters.add(spark.createDataFrame(rows[k::3], schema), path, k)
        if k:
            assert counters.fold(spark, path) > 1
    got = {tuple(r)[:3]: tuple(r)[3:] for r in counters.read(spark, path).collect()}
    assert got == expect
    counters.fold(spark, path, forget_before_ms=BEGIN + 95)
    assert {k for k in expect if expect[k][1] >= BEGIN + 95} == {tuple(r)[:3] for r in counters.read(spark, path).collect()}
    assert counters.fold(spark, f"file://{tmp_path}/none") == 0


def test_a_fold_that_broke_off_counts_once(spark, tmp_path, monkeypatch):
    schema, path = "config_id string, app_id string, window_key string, timestamp_ms long", f"file://{tmp_path}/n"
    for k in range(3):
        counters.add(spark.createDataFrame([("c", "a", "w", BEGIN)], schema), path, k)
    real = counters.Files.delete
    monkeypatch.setattr(counters.Files, "delete", lambda self, p: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        counters.fold(spark, path)
    monkeypatch.setattr(counters.Files, "delete", real)
    assert [r["event_count"] for r in counters.read(spark, path).collect()] == [3]
    counters.fold(spark, path)
    assert [r["event_count"] for r in counters.read(spark, path).collect()] == [3]


def deliveries(spark, n):
    at = datetime(2024, 1, 1, tzinfo=UTC)
    rows = [(f"{i:03}", "w", "r", "{}", "pending" if i % 10 else "delivered", 0, 5, at, None, None, None, None) for i in range(n)]
    return spark.createDataFrame(rows, DELIVERY)


def test_claimers_at_once_get_disjoint_sets_and_leases_run_out(spark, tmp_path):
    table, now, got = deliveries(spark, 60), 1_704_100_000_000, {}
    path = f"file://{tmp_path}/claims"

    def work(name):
        got[name] = [r["id"] for r in claims.Claims(spark, path).claim(table, name, 15, now, 1000).collect()]

    threads = [threading.Thread(target=work, args=(f"w{k}",)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    every = [i for ids in got.values() for i in ids]
    assert len(every) == len(set(every)) == 54 and sorted(len(x) for x in got.values()) == [9, 15, 15, 15]
    held = claims.Claims(spark, path)
    assert held.claim(table, "late", 15, now + 999, 1000).count() == 0
    marked = claims.in_progress(table, held.held(now + 500))
    assert marked.where("status = 'in_progress'").count() == 54 and marked.where("status = 'delivered' and last_attempt_at is null").count() == 6
    assert held.claim(table, "next", 15, now + 1000, 1000).count() == 15  # expired leases come back
    assert held.release("next", now + 1100) == 15 and held.held(now + 1100).count() == 0
    assert held.prune(now + 5000) >= 4 and held.claim(table, "last", 60, now + 6000, 1000).count() == 54


def test_a_record_is_dead_after_exactly_so_many_tries(spark, tmp_path):
    ledger = redelivery.Ledger(spark, f"file://{tmp_path}/l", "events.a", "events", "sink", 3)
    batch = spark.createDataFrame([("bad", 5), ("bad", 5), ("slow", 6), ("good", 7)], "record string, arrived_ms long")
    none = batch.where("false")
    seen = []

    def consume(given, number):
        seen.append(sorted((r["record"], r["tries"]) for r in given.collect()))
        return given.where("record = 'bad' or (record = 'slow' and tries < 2)").withColumn("error", F.lit("no"))

    for number, rows in enumerate((batch, none, none, none)):
        for _ in range(2):  # each batch is retried once
            ledger.deliver(rows, number, consume)
        assert ledger.dead().count() == (0 if number < 2 else 2)
    assert seen[::2] == [[("bad", 0), ("bad", 0), ("good", 0), ("slow", 0)], [("bad", 1), ("bad", 1), ("slow", 1)], [("bad", 2), ("bad", 2), ("slow", 2)], []]
    assert seen[::2] == seen[1::2]
    letters = ledger.dead().collect()
    # equal records are told apart by their places, and keep the time when they came
    assert len({r["sequence"] for r in letters}) == 2 and {(r["subject"], r["deliveries"], r["error"], r["arrived_ms"]) for r in letters} == {("dlq.events.a", 3, "no", 5)}
    assert redelivery.last_number(ledger) == 3


def envelope(i, **other):
    return json.dumps({"id": str(i), "app_id": "a", "device_id": "d", "timestamp_ms": 1718461800000 + i, "screen_view": {"screen_name": "s"}} | other)


def test_small_batches_wait_for_their_number_or_time(spark, tmp_path):
    now = [0.0]
    path, source = f"file://{tmp_path}/w", tmp_path / "in"
    source.mkdir()

    def go(n):
        (source / f"{len(os.listdir(source))}.json").write_text("\n".join([*(envelope(len(os.listdir(source)) * 100 + i) for i in range(n)), "junk"]))
        stream = pipelines.envelopes(spark, f"file://{source}", 1)
        query = pipelines.sink(stream, path, f"file://{tmp_path}/r", f"file://{tmp_path}/k", least_rows=10, seconds=60, clock=lambda: now[0]).trigger(availableNow=True).start()
        query.awaitTermination()
        return warehouse.read(spark, path).count(), str(query.id)

    assert go(4)[0] == 0
    assert go(4)[0] == 0
    assert go(4)[0] == 12  # enough rows, over three runs of the query
    now[0] = 100.0
    assert go(3)[0] == 12
    now[0] = 159.0
    assert go(1)[0] == 12
    now[0] = 160.0
    total, query = go(1)
    assert total == 17  # the oldest is a minute old
    assert go(2)[0] == 17
    carried = pipelines.Carried(spark, path, query, 10, 60, lambda: now[0])
    rows = spark.createDataFrame(spark.read.schema(warehouse.EVENT_ROW).parquet(f"{carried.folder}/rows/batch=6").collect(), warehouse.EVENT_ROW)
    carried.add(rows, 6)  # retried
    assert carried.flush(6, now=True) == 2
    carried.add(rows, 6)
    assert carried.flush(7, now=True) == 0 and warehouse.read(spark, path).count() == 19
    assert spark.read.parquet(f"file://{tmp_path}/r").count() == 7


def test_a_crash_between_flush_and_clearing_writes_nothing_twice(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/w"
    carried = pipelines.Carried(spark, path, "q", 3, 60, lambda: 0.0)
    rows = spark.createDataFrame([tuple({"id": str(i), "app_id": "a", "timestamp_ms": BEGIN, "year": 2023, "month": 11, "day": 14, "hour": 22}.get(f.name) for f in warehouse.EVENT_ROW.fields) for i in range(2)], warehouse.EVENT_ROW)
    carried.add(rows, 0)
    carried.add(rows, 1)
    monkeypatch.setattr(carried, "_drop", lambda n: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        carried.flush(1)
    monkeypatch.undo()
    carried.add(rows, 1)  # the batch is tried again
    assert carried.flush(1) == 0
    carried.add(rows, 2)
    assert carried.flush(2, now=True) == 2 and warehouse.read(spark, path).count() == 6


def test_ticks_make_a_batch_without_rows(spark, tmp_path):
    schema = "record string, arrived_ms long"
    spark.createDataFrame([("x", 1)], schema).write.parquet(f"file://{tmp_path}/in")
    numbers = []
    stream = pipelines.with_ticks(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"))
    query = stream.writeStream.foreachBatch(lambda b, n: numbers.append((n, b.count()))).option("checkpointLocation", f"file://{tmp_path}/k").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            query.awaitTermination(1)
            if len(numbers) > 2:
                break
    finally:
        query.stop()
    assert len(numbers) > 2 and sum(n for _, n in numbers) == 1


def test_a_rule_that_is_added_holds_for_the_running_stream(spark, tmp_path):
    schema, now, loads = "id string, app_id string, event_category string, event_type string, payload_json string", [0.0], []
    tables = [adapter.rules(spark, {"id": "r1"}), adapter.rules(spark, {"id": "r1", "enabled": False}, {"id": "r2", "conditions": [("k", "gt", "5")]})]
    got = []

    def write(found, number):
        got.append(sorted((r["id"], r["rule_id"]) for r in found.collect()))
        now[0] += 20

    def load():
        loads.append(now[0])
        return tables[min(len(loads), 2) - 1]

    for k in range(3):
        spark.createDataFrame([(f"{k}{v}", "a", "c", "t", json.dumps({"k": v})) for v in (1, 9)], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    pipelines.live_hits(stream, load, 30, write, clock=lambda: now[0]).option("checkpointLocation", f"file://{tmp_path}/k").trigger(availableNow=True).start().awaitTermination()
    assert got == [[("01", "r1"), ("09", "r1")], [("11", "r1"), ("19", "r1")], [("29", "r2")]]
    assert loads == [0.0, 40.0]


def test_many_rules_by_the_join_equal_few_by_columns(spark):
    schema = "id string, app_id string, event_category string, event_type string, payload_json string"
    rows = [(str(i), f"a{i % 3}", f"c{i % 2}", None if i % 5 == 0 else "t", json.dumps({"k": i, "s": "x" * (i % 4)})) for i in range(40)] + [("0", "a0", "c0", None, '{"k":0}')] * 2
    events = spark.createDataFrame(rows, schema)
    given = [{"id": f"r{i}", "name": f"n{i % 4}", "priority": i % 3, "app_id": f"a{i % 3}" if i % 2 else None, "conditions": [("k", "gt", str(i)), ("s", "exists", None)][: i % 3], "webhooks": [f"w{i}"] if i % 2 else []} for i in range(15)]
    table = adapter.rules(spark, *given, {"id": "off", "enabled": False}, {"id": "bad", "conditions": [("k", "regex", json.dumps("(?=x)"))]})
    few, many = rules.Compiled(table), rules.Compiled(table, most=3)
    assert not few.many and many.many and few.refused == many.refused == ["(?=x)"]
    assert sorted(map(str, few.hits(events).collect())) == sorted(map(str, many.hits(events).collect()))
    assert rules.Compiled(table.where("false"), most=-1).hits(events).count() == 0


def test_cooldown_goes_on_from_the_log(spark):
    schema = "id string, config_id string, app_id string, timestamp_ms long, cooldown_seconds int"
    rows = [(f"{i:02}", "c", "a" if i % 2 else None, BEGIN + i * 20_000, 60) for i in range(20)]
    whole = anomaly.cooled(spark.createDataFrame(rows, schema))
    first = anomaly.cooled(spark.createDataFrame(rows[:9], schema)).collect()
    last = spark.createDataFrame([("c", app, max(r["timestamp_ms"] for r in first if r["app_id"] == app)) for app in ("a", None)], "anomaly_config_id string, app_id string, last_alert_ms long")
    second = anomaly.cooled_after(spark.createDataFrame(rows[9:], schema), last).collect()
    assert sorted(r["id"] for r in [*first, *second]) == sorted(r["id"] for r in whole.collect())


def test_counters_latencies_and_backlog(spark, tmp_path):
    schema = "id string, v long"
    for k in range(4):
        spark.createDataFrame([(str(i), i) for i in range(10 * k + 1)], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    source, state = f"file://{tmp_path}/in", f"file://{tmp_path}/k"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    assert metrics.backlog(spark, source, state) == 4
    with metrics.Progress(spark, f"file://{tmp_path}/m"):
        query = pipelines.observed(stream, "seen", most=F.max("v")).writeStream.queryName("own").format("noop").option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
    assert metrics.backlog(spark, source, state) == 0
    spark.createDataFrame([("x", 1)], schema).coalesce(1).write.mode("append").parquet(source)
    assert metrics.backlog(spark, source, state) == 1
    rows = metrics.read(spark, f"file://{tmp_path}/m").where(F.col("query") == str(query.id)).where("input_rows > 0")
    assert [(r["batches"], r["input_rows"], r["late_rows"]) for r in metrics.counters(rows.unionByName(rows)).collect()] == [(4, 64, 0)]
    assert max(json.loads(r["observed"]).get("seen", {}).get("most") or 0 for r in rows.collect()) == 30
    values = spark.range(1000).selectExpr("id", "id % 4 as h")
    parts, whole = metrics.latency_sketches(values, "id", "h"), metrics.latency_sketches(values, "id")
    both = metrics.quantiles(metrics.merged(parts), 0.5, 0.99).first(), metrics.quantiles(whole, 0.5, 0.99).first()
    for r in both:
        assert r["n"] == 1000 and abs(r["p50"] - 500) <= 25 and abs(r["p99"] - 990) <= 25


def test_one_consumer_fails_the_others_go_on(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(str(k),)], "id string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    got = {name: [] for name in ("good", "flaky", "broken")}
    tries = {"flaky": 0, "broken": 0}

    def start(name):
        def write(batch, number):
            if name != "good":
                tries[name] += 1
                if name == "broken" or tries[name] == 2:
                    raise RuntimeError(name)
            got[name].append((number, batch.count()))

        stream = spark.readStream.schema("id string").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        return lambda: stream.writeStream.foreachBatch(write).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start()

    failed = metrics.Consumers({name: start(name) for name in got}, restarts=2).run()
    assert [len(failed[n]) for n in got] == [0, 1, 3]
    assert got["good"] == got["flaky"] == [(0, 1), (1, 1), (2, 1)] and got["broken"] == []
