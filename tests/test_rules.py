import json

import pytest
from pyspark.sql import functions as F

from streamloom.operators import anomaly, rules
from streamloom.sources import adapter

DOC = '{"a":{"n":5,"s":"5","t":"abc","z":null,"b":true,"arr":[1],"x-y z":{"1":"k"}}}'
#: (path, operator, value, expected); value is JSON or absent.
TABLE = [
    ("a.n", "eq", '"5"', True), ("a.s", "eq", "5", True), ("a.t", "eq", '"abc"', True), ("a.t", "ne", '"x"', True), ("a.t", "ne", '"abc"', False),
    ("a.miss", "ne", '"x"', False), ("a.miss", "exists", None, False), ("a.miss", "not_exists", None, True), ("a.n", "not_exists", None, False),
    ("a.z", "exists", None, True), ("a.z", "eq", "null", True), ("a.n", "eq", "null", False), ("a.z", "ne", "1", True), ("a.z", "eq", "1", False),
    ("a.n", "gt", "4", True), ("a.n", "gte", "5", True), ("a.n", "lt", "5", False), ("a.n", "lte", "5", True), ("a.t", "gt", "1", False), ("a.n", "gt", '"x"', False),
    ("a.b", "eq", "true", True), ("a.b", "gt", "0", False), ("a.b", "eq", "1", False), ("a.t", "contains", '"b"', True), ("a.t", "contains", '"z"', False),
    ("a.t", "regex", '"^a"', True), ("a.t", "regex", '"b"', True), ("a.t", "regex", '"("', False), ("a.t", "regex", '"a(?=b)"', False),
    ("a.n", "in", '[1,"5"]', True), ("a.n", "in", '"5"', False), ("a.t", "in", "[]", False), ("a.arr.0", "exists", None, False), ("$.a.n", "eq", "5", True),
    ("a.n", "foo", "5", False), ("a.x-y z.1", "eq", '"k"', True), ("a.s", "eq", '" 5 "', False),
]


@pytest.mark.parametrize("chunk", [TABLE])
def test_truth_table(spark, chunk):
    doc = F.try_parse_json(F.lit(DOC))
    columns = [rules.condition(doc, p, o, json.loads(v) if v is not None else None, spark).alias(f"c{i}") for i, (p, o, v, _) in enumerate(chunk)]
    got = spark.range(1).select(*columns).first()
    assert [(c[:3], got[i]) for i, c in enumerate(chunk)] == [(c[:3], c[3]) for c in chunk]


def test_empty_conditions_hold_and_bad_documents_match_nothing_else(spark):
    rows = spark.createDataFrame([("1", "app1", "c", "t", "not json"), ("2", "app1", "c", "t", None)], "id string, app_id string, event_category string, event_type string, payload_json string")
    table = adapter.rules(spark, {"id": "all"}, {"id": "some", "conditions": [("k", "eq", "1")]}, {"id": "other", "app_id": "app2"})
    assert sorted((r["id"], r["rule_id"]) for r in rules.hits(rows, table).collect()) == [("1", "all"), ("2", "all")]
    assert rules.hits(rows, adapter.rules(spark, {"id": "off", "enabled": False})).count() == 0


def test_hits_need_no_shuffle_and_fire_in_order(spark, small):
    events = adapter.events(spark, small)
    table = adapter.rules(spark, {"id": "b", "name": "b", "priority": 1}, {"id": "a", "name": "a", "priority": 1}, {"id": "z", "name": "z", "priority": 5})
    found = rules.hits(events, table)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    first = sorted(found.where("id = '0'").collect(), key=lambda r: r["hit_order"])
    assert [r["rule_id"] for r in first] == ["z", "a", "b"]


def test_actions(spark, small):
    events = adapter.events(spark, small).limit(3)
    table = adapter.rules(spark, {"id": "r", "name": "n", "webhooks": ["w1", "w2"], "publish_subjects": ["x.{app_id}"]}, {"id": "q", "name": "q"})
    found = rules.payload(rules.hits(events, table), F.to_timestamp(F.lit("2024-02-01 00:00:00")))
    assert rules.deliveries(found, F.current_timestamp()).count() == 6
    out = rules.publications(found).collect()
    body = json.loads(out[0]["value"])
    assert len(out) == 3 and out[0]["topic"].startswith("x.app")
    assert set(body) == {"rule_id", "rule_name", "event_id", "app_id", "device_id", "timestamp_ms", "correlation_id", "event", "triggered_at"}
    assert body["triggered_at"] == "2024-02-01T00:00:00Z"


def test_patterns_of_other_dialects(spark):
    usable = {r"(?P<year>\d{4})-(?<m_m>\d\d)": True, r"a\\1": True, r"\(?P<x": True, r"(a)\1": False, r"a(?=b)": False, r"(?<!a)b": False, r"\k<a>": False, r"[": False, r"(?i)abc$": True}
    assert {p: rules.usable_pattern(spark, p) for p in usable} == usable
    events = spark.createDataFrame([("1", "a", "c", "t", '{"d":"2024-05"}'), ("2", "a", "c", "t", '{"d":"x"}')], "id string, app_id string, event_category string, event_type string, payload_json string")
    table = adapter.rules(spark, {"id": "r", "conditions": [("d", "regex", json.dumps(r"^(?P<year>\d{4})-(?<m_m>\d\d)$"))]})
    assert [r["id"] for r in rules.hits(events, table).collect()] == ["1"]


def test_filters_without_a_known_size_do_not_gather_the_events(spark, small, monkeypatch):
    """A filter that is all wildcards has all events for its key: few filters are broadcast, more stand in parts."""
    events = adapter.events(spark, small)
    configs = adapter.configs(spark, {"id": "t", "name": "t", "detection_type": "threshold", "path": "k", "min": 5.0, "max": 90.0}, {"id": "r", "name": "r", "detection_type": "rate", "max_per_minute": 1})
    table = adapter.rules(spark, {"id": "any"}, {"id": "app1", "app_id": "app1"})
    made = lambda: (anomaly.threshold(events, configs).select("id", "config_id"), anomaly.rate(events, configs).select("id", "config_id"), rules.wildcard_join(events, table))
    plan = lambda frame: frame._jdf.queryExecution().executedPlan().toString()
    few = made()
    for frame in few:
        assert "BuildRight" in plan(frame) and "hashpartitioning(_key" not in plan(frame)
    expected = [sorted(map(tuple, frame.collect())) for frame in few]
    monkeypatch.setattr(rules, "MOST_BROADCAST", 0)
    many = made()
    assert all("_part" in plan(frame) for frame in many)
    assert [sorted(map(tuple, frame.collect())) for frame in many] == expected


def test_a_document_is_parsed_once(spark, small):
    """No filter that Spark infers from the hits makes and parses the document again at the source."""
    found = rules.hits(adapter.events(spark, small), adapter.rules(spark, {"id": "a", "conditions": [("k", "gt", "40"), ("k", "lt", "60"), ("x", "not_exists", None)]}))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parseJson") + found._jdf.queryExecution().optimizedPlan().toString().count("parse_json") <= 1
    assert [r["hit_order"] for r in found.limit(3).collect()] == [0, 0, 0]
