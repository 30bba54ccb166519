import json

from pyspark.sql import functions as F

from streamloom.functions import scalars
from streamloom.operators import classify, ingest
from streamloom.sources.schemas import ENVELOPE, PAYLOADS


def envelopes(spark, *rows):
    return spark.read.schema(ENVELOPE).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))


FULL = {
    "id": "e-full", "app_id": "gardening", "device_id": "tablet-9", "correlation_id": "tour", "timestamp_ms": 1677622509250,
    "device_context": {"platform": "PLATFORM_ANDROID", "os_version": "11", "app_version": "0.9", "device_model": "Tab S", "manufacturer": "Acme", "screen_width": 1600, "screen_height": 2560, "locale": "pt_BR", "timezone": "America/Recife", "network_type": "NETWORK_TYPE_5G"},
    "screen_view": {"screen_name": "beds", "previous_screen": "seeds", "params": {}},
}


def test_flatten(spark):
    rows = {r["id"]: r for r in classify.flatten(envelopes(spark, FULL, {"id": "e-least", "app_id": "app", "device_id": "dev", "timestamp_ms": 1, "user_login": {"user_id": "", "is_new_user": False}}, {"id": "n", "timestamp_ms": 1, "device_context": {}})).collect()}
    r = rows["e-full"]
    assert (r["event_category"], r["event_type"], r["platform"], r["network_type"], r["screen_width"]) == ("screen", "view", "PLATFORM_ANDROID", "NETWORK_TYPE_5G", 1600)
    assert (r["year"], r["month"], r["day"], r["hour"]) == (2023, 2, 28, 22)
    assert json.loads(r["payload_json"]) == {"screen_name": "beds", "previous_screen": "seeds"}
    assert (rows["e-least"]["event_category"], rows["e-least"]["platform"], rows["e-least"]["payload_json"]) == ("user", "", "{}")
    assert (rows["n"]["event_type"], rows["n"]["platform"], rows["n"]["payload_json"]) == ("unknown", "PLATFORM_UNSPECIFIED", "{}")


def test_every_payload_is_classified(spark):
    rows = [{"id": name, "timestamp_ms": 1, name: {"event_name": "My Thing"} if name == "custom_event" else {}} for name in PAYLOADS]
    got = {r["id"]: (r["event_category"], r["event_type"]) for r in classify.flatten(envelopes(spark, *rows, {"id": "c", "timestamp_ms": 1, "custom_event": {}})).collect()}
    assert len(PAYLOADS) == 29
    assert got == {n: (c, t or "My Thing") for n, (c, t, _) in PAYLOADS.items()} | {"c": ("custom", "unknown")}


def test_validation_order_and_counts(spark):
    good = {"app_id": "a", "timestamp_ms": 5, "screen_view": {"screen_name": "s"}}
    batch = [{"id": "1", **good}, {"id": "2", **good, "app_id": ""}, {"id": "3", "app_id": "a", "timestamp_ms": 5}, {"id": "4", **good, "timestamp_ms": 0}, {"id": "5", "app_id": "", "timestamp_ms": 0}]
    checked = ingest.validate(envelopes(spark, *batch))
    assert {r["id"]: r["error"] for r in checked.collect()} == {"1": None, "2": ingest.NO_APP, "3": ingest.NO_PAYLOAD, "4": ingest.NO_TIME, "5": ingest.NO_APP}
    assert ingest.batch_counts(ingest.results(checked)).first().asDict() == {"accepted_count": 1, "rejected_count": 4}
    strict = ingest.validate(envelopes(spark, {"id": "1", **good}, {"id": "2", **good, "device_id": "d", "screen_view": {}}), device_required=True, fields=True)
    assert {r["id"]: r["error"] for r in strict.collect()} == {"1": "device_id is required", "2": "screen_view.screen_name is required"}


def test_enrichment_keeps_or_makes_ids(spark):
    rows = ingest.enrich(envelopes(spark, {"id": "own", "idempotency_key": "k"}, {"app_id": "x"})).collect()
    assert (rows[0]["id"], rows[0]["idempotency_key"]) == ("own", "k")
    made = rows[1]["id"]
    assert len(made) == 36 and made[14] == "7" and rows[1]["idempotency_key"]


def test_batches_and_poison(spark, tmp_path):
    b = spark.createDataFrame([("b1", ["x", None]), ("b2", []), ("b3", None), ("b4", ["x"] * 4)], "batch string, events array<string>")
    got = [(r["batch"], r["index"], r["event"], r["batch_error"] is None) for r in ingest.explode_batches(b, max_batch=3).collect()]
    assert sorted(got, key=str) == sorted([("b1", 0, "x", True), ("b1", 1, None, True), ("b2", None, None, False), ("b3", None, None, False), ("b4", None, None, False)], key=str)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps(FULL) + "\nno event at all\n")
    good, poison = ingest.decode(spark, f"file://{tmp_path}/in")
    assert [r["id"] for r in good.collect()] == ["e-full"]
    letters = ingest.dead_letters(poison, "events.a.b.c", "events", "sink", 5)
    assert [(r["subject"], r["record"]) for r in letters.collect()] == [("dlq.events.a.b.c", "no event at all")]
    assert ingest.depth(letters, 1).first()["alert"] is True


def test_client_events(spark):
    props = {"event_name": "buy", "s": "t", "i": 3, "w": 2.0, "f": 2.5, "b": True, "o": {"x": [1]}, "n": None}
    meta = {"app_id": "a", "device_id": "d", "timestamp": "2024-06-15T14:30:00.123456789+02:00", "session_id": "se", "user_id": "u", "idempotency_key": "k"}
    rows = [
        {"type": "custom", "properties": props, "metadata": meta},
        {"type": "screen_view", "properties": {"screen_name": "home"}, "metadata": meta},
        {"type": "odd_one", "properties": {"q": 1}, "metadata": {**meta, "timestamp": "never"}},
        {"type": "app_start", "metadata": meta},
    ]
    got = ingest.from_client(spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")).collect()
    c = got[0]["custom_event"]
    assert c["event_name"] == "buy" and c["int_params"] == {"i": 3, "w": 2} and c["float_params"] == {"f": 2.5} and c["bool_params"] == {"b": True}
    assert c["string_params"] == {"s": "t", "o": '{"x":[1]}', "n": "null"}
    assert got[0]["timestamp_ms"] == 1718454600123 and (got[0]["session_id"], got[0]["user_id"]) == ("se", "u")
    assert got[1]["screen_view"]["screen_name"] == "home" and got[1]["custom_event"] is None
    assert got[2]["custom_event"]["event_name"] == "odd_one" and got[2]["custom_event"]["string_params"] == {"_raw_properties": '{"q":1}'} and got[2]["timestamp_ms"] == 0
    assert got[3]["app_start"] is not None


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    lit = F.lit
    assert value(scalars.subject(lit("com.example.app"), lit("screen"), lit("view"))) == "events.com_example_app.screen.view"
    assert value(scalars.subject(lit("MyApp"), lit("custom"), lit("Feature Flag.x"))) == "events.MyApp.custom.feature_flag_x"
    assert value(scalars.anomaly_topic(lit("A.b"), lit("High Rate"))) == "anomalies.a_b.high_rate"
    assert [value(scalars.backoff_ms(lit(n))) for n in (0, 3, 20)] == [1000, 8000, 300_000]
    assert 0 <= value(scalars.full_jitter_ms(lit(3))) <= 8000 and 6000 <= value(scalars.jittered_ms(lit(3))) <= 10_000
    assert value(scalars.window_start(lit(1_704_888_000_000), 604_800)) == 1_704_672_000  # a Monday
    assert value(scalars.minute_key(F.timestamp_millis(lit(1_704_888_061_000)))) == "2024-01-10T12:01"
    assert value(scalars.well_formed_key(scalars.key_hash(lit("k")))) is True and value(scalars.well_formed_key(lit("AB"))) is False
    for pattern, subject, expect in (("events.>", "events.a.b", True), ("events.>", "anomalies.a", False), (">", "x", True), ("a.*.c", "a.b.c", True), ("a.*.c", "a.b.b.c", False), ("a.*.>", "a.b.c.d", True)):
        assert value(scalars.matches_topic(lit(subject), pattern)) is expect
    names = {"ios": "P_IOS"}
    assert value(scalars.named(lit("iOS"), names, "P_NONE")) == "P_IOS" and value(scalars.named(lit(None).cast("string"), names, "P_NONE")) == "P_NONE"
