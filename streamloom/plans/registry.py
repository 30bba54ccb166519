"""Every query of the event library by name, with its SQL counterpart in DuckDB's dialect."""

from __future__ import annotations

import json
import tempfile
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.functions import scalars
from streamloom.operators import anomaly, classify, claims, dedup, deliveries, ingest, reports, rules, sessions
from streamloom.sources import adapter, anomaly_log, counters, warehouse
from streamloom.sources.adapter import events
from streamloom.sources.schemas import DELIVERY, ENVELOPE, EVENT_ROW
from streamloom.streaming import metrics, pipelines, redelivery, states

QUERIES: dict = {}
ORACLES: dict = {}

#: The adapter's rows in SQL.
EV = """ev AS (
  SELECT cast(event_id AS varchar) AS id, concat('app', user_id % 4) AS app_id, concat('d', user_id) AS device_id,
    epoch_us(ts) // 1000 AS timestamp_ms,
    CASE event_type WHEN 'click' THEN 'interaction' WHEN 'view' THEN 'screen' WHEN 'purchase' THEN 'commerce' WHEN 'signup' THEN 'user' ELSE 'system' END AS event_category,
    CASE event_type WHEN 'click' THEN 'button_tap' WHEN 'view' THEN 'view' WHEN 'purchase' THEN 'purchase_complete' WHEN 'signup' THEN 'signup' ELSE 'app_crash' END AS event_type,
    ['PLATFORM_IOS', 'PLATFORM_ANDROID', 'PLATFORM_WEB'][user_id % 3 + 1] AS platform, concat('model', user_id % 7) AS device_model,
    props AS payload_json, cast(json_extract_string(props, '$.k') AS double) AS k,
    cast(year(ts) AS integer) AS year, cast(month(ts) AS integer) AS month, cast(day(ts) AS integer) AS day, cast(hour(ts) AS integer) AS hour,
    concat(user_id, '-', event_type, '-', strftime(ts, '%Y%m%d%H')) AS idempotency_key, value
  FROM events)"""


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name; sql may use the rows ev."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = f"WITH {EV}\n{sql}" if not sql.lstrip().upper().startswith("WITH") else sql.replace("WITH", f"WITH RECURSIVE {EV},", 1)
        return f

    return add


# --- reports


@query("SELECT count(*) AS n FROM ev")
def event_count(spark: SparkSession, d: str) -> DataFrame:
    return reports.total(events(spark, d))


@query("SELECT event_category, event_type, count(*) AS n FROM ev GROUP BY ALL")
def events_by_category_type(spark: SparkSession, d: str) -> DataFrame:
    return reports.by(events(spark, d), "event_category", "event_type")


@query("SELECT event_type, count(*) AS n FROM ev GROUP BY ALL")
def events_by_type(spark: SparkSession, d: str) -> DataFrame:
    return reports.by(events(spark, d), "event_type")


@query("SELECT event_category, count(*) AS n FROM ev WHERE app_id = 'app1' AND year = 2024 AND month = 1 GROUP BY ALL")
def category_for_app_month(spark: SparkSession, d: str) -> DataFrame:
    return reports.by(reports.of_month(events(spark, d), "app1", 2024, 1), "event_category")


@query("SELECT platform, device_model, count(*) AS n FROM ev GROUP BY ALL")
def device_distribution(spark: SparkSession, d: str) -> DataFrame:
    return reports.by(events(spark, d), "platform", "device_model")


@query("SELECT id, app_id, device_id, timestamp_ms FROM ev WHERE event_category = 'screen' AND event_type = 'view' ORDER BY timestamp_ms DESC, id LIMIT 100")
def recent_views_100(spark: SparkSession, d: str) -> DataFrame:
    return reports.latest(events(spark, d), "screen", "view", 100).select("id", "app_id", "device_id", "timestamp_ms")


@query("SELECT id, timestamp_ms FROM ev ORDER BY timestamp_ms, id LIMIT 50 OFFSET 200")
def page_of_events(spark: SparkSession, d: str) -> DataFrame:
    return reports.page(events(spark, d).select("id", "timestamp_ms"), "timestamp_ms", "id", offset=200, limit=50)


@query("SELECT json_extract_string(payload_json, '$.k') AS k, count(*) AS n FROM ev GROUP BY ALL")
def json_extract_k(spark: SparkSession, d: str) -> DataFrame:
    return reports.by(reports.field(events(spark, d), "k", "$.k"), "k")


@query("SELECT app_id, year, month, day, hour, count(*) AS n FROM ev GROUP BY ALL")
def partition_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.partition_sizes(events(spark, d))


@query("SELECT DISTINCT app_id, year, month, day, hour FROM ev WHERE make_timestamp(year, month, day, hour, 0, 0) < TIMESTAMP '2024-01-15 12:00:00'")
def cold_partitions(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("app_id", "year", "month", "day", "hour").distinct().where(warehouse.cold(datetime(2024, 1, 15, 12, 40)))


@query("SELECT id, timestamp_ms FROM ev WHERE timestamp_ms >= 1704844800000 AND timestamp_ms < 1705017600000")
def time_range(spark: SparkSession, d: str) -> DataFrame:
    return warehouse.time_range(events(spark, d), datetime(2024, 1, 10), datetime(2024, 1, 12)).select("id", "timestamp_ms")


@query("SELECT id, timestamp_ms FROM ev WHERE timestamp_ms >= 1706486400000 - 168 * 3600000")
def retention_filter(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit(datetime(2024, 1, 29, tzinfo=UTC))
    return deliveries.retained(warehouse.with_time(events(spark, d)), "ts", now, 168).select("id", "timestamp_ms")


# --- ingest


def odd_envelopes(spark: SparkSession, d: str) -> DataFrame:
    """The events as envelopes, some of them with a part missing, in batches of a user's hour."""
    e = events(spark, d).withColumn("n", F.col("id").cast("long"))
    view = F.when((F.col("n") % 11 != 0) & (F.col("event_type") == "view"), F.struct(F.concat(F.lit("s"), F.col("n") % 5).alias("screen_name"), F.lit("").alias("screen_class")))
    buy = F.when((F.col("n") % 11 != 0) & (F.col("event_type") == "purchase_complete"), F.struct(F.col("id").alias("order_id"), (F.col("n") % 3).cast("int").alias("item_count"), (F.col("n") % 1000).alias("total_cents")))
    own = F.when((F.col("n") % 11 != 0) & ~F.col("event_type").isin("view", "purchase_complete"), F.struct(F.concat(F.lit("My "), F.col("event_type")).alias("event_name")))
    device = F.when(F.col("n") % 5 != 0, F.struct(F.col("platform"), F.lit("en_US").alias("locale")))
    cols = {
        "id": F.col("id"), "app_id": F.when(F.col("n") % 7 == 0, "").otherwise(F.col("app_id")), "device_id": F.col("device_id"),
        "timestamp_ms": F.when(F.col("n") % 13 == 0, F.lit(0)).otherwise(F.col("timestamp_ms")), "correlation_id": F.lit(""), "idempotency_key": F.col("idempotency_key"),
        "device_context": device, "screen_view": view, "purchase_complete": buy, "custom_event": own,
    }
    return e.select(*[cols[f.name].alias(f.name) if f.name in cols else F.lit(None).cast(f.dataType).alias(f.name) for f in ENVELOPE.fields]).to(ENVELOPE)


STATUS = """CASE WHEN cast(id AS bigint) % 7 = 0 THEN 'app_id is required' WHEN cast(id AS bigint) % 11 = 0 THEN 'event payload is required'
  WHEN cast(id AS bigint) % 13 = 0 THEN 'timestamp_ms is required' END"""


@query(f"SELECT id, {STATUS} AS error, CASE WHEN {STATUS} IS NULL THEN 'accepted' ELSE 'rejected' END AS status FROM ev")
def validate_status(spark: SparkSession, d: str) -> DataFrame:
    return ingest.results(ingest.validate(odd_envelopes(spark, d)))


@query(f"SELECT device_id, count(*) FILTER ({STATUS} IS NULL) AS accepted_count, count(*) FILTER ({STATUS} IS NOT NULL) AS rejected_count FROM ev GROUP BY ALL")
def batch_accept_counts(spark: SparkSession, d: str) -> DataFrame:
    return ingest.batch_counts(ingest.results(ingest.validate(odd_envelopes(spark, d)), "device_id"), "device_id")


@query("SELECT device_id, cast(i AS integer) AS index, b[i + 1] AS id, CASE WHEN len(b) > 60 THEN 'batch exceeds 60 events' END AS batch_error FROM (SELECT device_id, list(id ORDER BY id) AS b, unnest(CASE WHEN count(*) > 60 THEN [NULL] ELSE range(count(*)) END) AS i FROM ev GROUP BY 1)")
def batches_exploded(spark: SparkSession, d: str) -> DataFrame:
    batches = events(spark, d).groupBy("device_id").agg(F.array_sort(F.collect_list("id")).alias("events"))
    return ingest.explode_batches(batches, max_batch=60).select("device_id", "index", F.col("event").alias("id"), "batch_error")


KIND = """CASE WHEN cast(id AS bigint) % 11 = 0 THEN 'unknown' WHEN event_type IN ('view', 'purchase_complete') THEN event_type ELSE concat('My ', event_type) END"""
GROUP = """CASE WHEN cast(id AS bigint) % 11 = 0 THEN 'unknown' WHEN event_type = 'view' THEN 'screen' WHEN event_type = 'purchase_complete' THEN 'commerce' ELSE 'custom' END"""


@query(f"SELECT {GROUP} AS event_category, {KIND} AS event_type, count(*) AS n FROM ev GROUP BY ALL")
def classified(spark: SparkSession, d: str) -> DataFrame:
    return reports.by(classify.flatten(odd_envelopes(spark, d)), "event_category", "event_type")


@query("""SELECT id, CASE WHEN cast(id AS bigint) % 5 <> 0 THEN platform ELSE '' END AS platform, CASE WHEN cast(id AS bigint) % 5 <> 0 THEN 'NETWORK_TYPE_UNSPECIFIED' ELSE '' END AS network_type,
  CASE WHEN cast(id AS bigint) % 11 = 0 THEN '{}' WHEN event_type = 'view' THEN concat('{"screen_name":"s', cast(id AS bigint) % 5, '"}')
    WHEN event_type = 'purchase_complete' THEN concat('{"order_id":"', id, '"', CASE WHEN cast(id AS bigint) % 3 > 0 THEN concat(',"item_count":', cast(id AS bigint) % 3) ELSE '' END,
      CASE WHEN cast(id AS bigint) % 1000 > 0 THEN concat(',"total_cents":', cast(id AS bigint) % 1000) ELSE '' END, '}')
    ELSE concat('{"event_name":"My ', event_type, '"}') END AS payload_json FROM ev""")
def flattened(spark: SparkSession, d: str) -> DataFrame:
    return classify.flatten(odd_envelopes(spark, d)).select("id", "platform", "network_type", "payload_json")


@query(f"SELECT id, concat_ws('.', 'events', replace(app_id, '.', '_'), g, CASE WHEN g = 'custom' THEN translate(lower(t), ' .', '__') ELSE t END) AS subject FROM (SELECT id, app_id, {GROUP} AS g, {KIND} AS t FROM ev WHERE cast(id AS bigint) % 7 <> 0)")
def subjects(spark: SparkSession, d: str) -> DataFrame:
    rows = classify.flatten(odd_envelopes(spark, d)).where("app_id <> ''")
    return rows.select("id", scalars.subject(F.col("app_id"), F.col("event_category"), F.col("event_type")).alias("subject"))


@query("SELECT id FROM ev WHERE app_id = 'app2' AND event_category = 'screen'")
def topic_subscription(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).withColumn("s", scalars.subject(F.col("app_id"), F.col("event_category"), F.col("event_type")))
    return rows.where(scalars.matches_topic(F.col("s"), "events.app2.screen.*")).select("id")


@query("SELECT id, event_type, event_type IN ('button_tap', 'purchase_complete') AS known FROM ev")
def client_types(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("id", "event_type", ingest.known_client_type(F.col("event_type")).alias("known"))


@query("""SELECT id, app_id, timestamp_ms, CASE WHEN event_type IN ('button_tap', 'purchase_complete') THEN event_type ELSE 'custom_event' END AS payload,
  CASE WHEN event_type NOT IN ('button_tap', 'purchase_complete') THEN replace(payload_json, ' ', '') END AS raw FROM ev""")
def client_conversion(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    stamp = F.date_format(F.timestamp_millis("timestamp_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    meta = F.struct(F.lit("s").alias("session_id"), "device_id", F.lit("u").alias("user_id"), stamp.alias("timestamp"), F.col("id").alias("idempotency_key"), "app_id")
    text = F.concat(F.lit('{"type":"'), F.col("event_type"), F.lit('","properties":'), F.col("payload_json"), F.lit(',"metadata":'), F.to_json(meta), F.lit("}"))
    made = ingest.from_client(e.select(text.alias("value")))
    return made.select(F.col("idempotency_key").alias("id"), "app_id", "timestamp_ms", classify.payload_name().alias("payload"), F.col("custom_event.string_params")["_raw_properties"].alias("raw"))


# --- rules

#: One condition for each operator: (value, SQL over ev).
CONDITIONS = {
    "exists": (None, "true"),
    "not_exists": (None, "cast(id AS bigint) % 3 = 0"),
    "eq": ("7", "k = 7"),
    "ne": (7, "k <> 7"),
    "gt": (50, "k > 50"),
    "gte": ("50", "k >= 50"),
    "lt": (20, "k < 20"),
    "lte": (20, "k <= 20"),
    "contains": ("9", "contains(json_extract_string(payload_json, '$.k'), '9')"),
    "regex": ("^1.$", "regexp_matches(json_extract_string(payload_json, '$.k'), '^1.$')"),
    "in": ([1, "5", "x"], "k IN (1, 5)"),
}


def _operator_query(operator: str) -> None:
    value, sql = CONDITIONS[operator]

    @query(f"SELECT id, 'r-{operator}' AS rule_id FROM ev WHERE app_id = 'app1' AND {sql}", name=f"rule_hits_{operator}")
    def hits(spark: SparkSession, d: str) -> DataFrame:
        table = adapter.rules(spark, {"id": f"r-{operator}", "app_id": "app1", "conditions": [("$.k", operator, json.dumps(value))]})
        rows = events(spark, d)
        if operator == "not_exists":  # a third of the events lacks the path
            rows = rows.withColumn("payload_json", F.when(F.col("id").cast("long") % 3 == 0, "{}").otherwise(F.col("payload_json")))
        return rules.hits(rows, table).select("id", "rule_id")


for _operator in CONDITIONS:
    _operator_query(_operator)

RULES = (
    {"id": "r1", "name": "any", "priority": 1, "webhooks": ["w1"], "publish_subjects": ["alerts.{app_id}"]},
    {"id": "r2", "name": "views", "event_category": "screen", "event_type": "view", "priority": 9, "conditions": [("k", "gt", "40"), ("k", "lt", "60")], "webhooks": ["w1", "w2"]},
    {"id": "r3", "name": "app1 views", "app_id": "app1", "event_category": "screen", "priority": 9, "conditions": [("missing", "not_exists", None)]},
    {"id": "r4", "name": "off", "enabled": False, "webhooks": ["w1"]},
)
HITS = """hits AS (
  SELECT id, app_id, 'r1' AS rule_id, 1 AS priority, 'any' AS rule_name FROM ev
  UNION ALL SELECT id, app_id, 'r2', 9, 'views' FROM ev WHERE event_category = 'screen' AND event_type = 'view' AND k > 40 AND k < 60
  UNION ALL SELECT id, app_id, 'r3', 9, 'app1 views' FROM ev WHERE app_id = 'app1' AND event_category = 'screen')"""


@query(f"WITH {HITS} SELECT id, rule_id, cast(row_number() OVER (PARTITION BY id ORDER BY priority DESC, rule_name) - 1 AS integer) AS hit_order FROM hits")
def rule_priority(spark: SparkSession, d: str) -> DataFrame:
    return rules.hits(events(spark, d), adapter.rules(spark, *RULES)).select("id", "rule_id", "hit_order")


@query("""SELECT id, unnest(['r1'] || CASE WHEN event_category = 'screen' THEN ['r2'] ELSE [] END || CASE WHEN event_category = 'screen' AND app_id = 'app1' THEN ['r3'] ELSE [] END) AS rule_id FROM ev""")
def rule_wildcard_join(spark: SparkSession, d: str) -> DataFrame:
    return rules.wildcard_join(events(spark, d), adapter.rules(spark, *RULES))


@query(f"""WITH {HITS} SELECT id AS event_id, rule_id, unnest(CASE rule_id WHEN 'r1' THEN ['w1'] WHEN 'r2' THEN ['w1', 'w2'] ELSE [] END) AS webhook_id,
  'pending' AS status, 0 AS attempts, 5 AS max_attempts FROM hits""")
def rule_deliveries(spark: SparkSession, d: str) -> DataFrame:
    made = rules.deliveries(rules.hits(events(spark, d), adapter.rules(spark, *RULES)), F.lit(datetime(2024, 2, 1, tzinfo=UTC)))
    return made.select("event_id", "rule_id", "webhook_id", "status", "attempts", "max_attempts")


@query("SELECT concat('alerts.', app_id) AS topic, id AS event_id, 'r1' AS rule_id FROM ev")
def rule_publications(spark: SparkSession, d: str) -> DataFrame:
    found = rules.payload(rules.hits(events(spark, d), adapter.rules(spark, *RULES)), F.lit(datetime(2024, 2, 1, tzinfo=UTC)))
    out = rules.publications(found)
    return out.select("topic", F.get_json_object("value", "$.event_id").alias("event_id"), F.get_json_object("value", "$.rule_id").alias("rule_id"))


# --- anomalies

THRESHOLD = {"id": "t", "name": "Big K", "detection_type": "threshold", "path": "k", "min": 5.0, "max": 90.0}
CANDIDATES = "cand AS (SELECT id, app_id, timestamp_ms, k, row_number() OVER (PARTITION BY app_id ORDER BY timestamp_ms, id) AS rn FROM ev WHERE k < 5 OR k > 90)"
KEPT = """nxt AS (SELECT a.app_id, a.rn, min(b.rn) AS nrn FROM cand a JOIN cand b ON a.app_id = b.app_id AND b.rn > a.rn AND b.timestamp_ms >= a.timestamp_ms + 3600000 GROUP BY ALL),
kept AS (SELECT app_id, cast(1 AS bigint) AS rn FROM cand WHERE rn = 1 UNION ALL SELECT n.app_id, n.nrn FROM kept q JOIN nxt n ON q.app_id = n.app_id AND q.rn = n.rn)"""


@query("SELECT id, k AS value, CASE WHEN k < 5 THEN 'below_min' ELSE 'above_max' END AS violation FROM ev WHERE k < 5 OR k > 90")
def threshold_anomalies(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.threshold(events(spark, d), adapter.configs(spark, THRESHOLD)).select("id", "value", "violation")


@query("SELECT * FROM (SELECT id, app_id, row_number() OVER (PARTITION BY app_id, timestamp_ms // 60000 ORDER BY timestamp_ms, id) AS running FROM ev) WHERE running > 1")
def rate_anomalies(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.rate(events(spark, d), adapter.configs(spark, {"id": "r", "name": "r", "detection_type": "rate", "max_per_minute": 1})).select("id", "app_id", "running")


@query("SELECT * FROM (SELECT id, app_id, row_number() OVER (PARTITION BY app_id, (timestamp_ms // 1000 + 62135596800) // 604800 ORDER BY timestamp_ms, id) AS running FROM ev WHERE event_category = 'system') WHERE running > 40")
def count_anomalies(spark: SparkSession, d: str) -> DataFrame:
    config = {"id": "c", "name": "c", "event_category": "system", "detection_type": "count", "window_seconds": 604_800, "max_count": 40}
    return anomaly.count(events(spark, d), adapter.configs(spark, config)).select("id", "app_id", "running")


def _alerts(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.cooled(anomaly.threshold(events(spark, d), adapter.configs(spark, THRESHOLD | {"cooldown_seconds": 3600})))


@query(f"WITH {CANDIDATES}, {KEPT} SELECT c.id, c.app_id, c.timestamp_ms FROM kept JOIN cand c ON c.app_id = kept.app_id AND c.rn = kept.rn")
def cooldown_alerts(spark: SparkSession, d: str) -> DataFrame:
    return _alerts(spark, d).select("id", "app_id", "timestamp_ms")


@query(f"""WITH {CANDIDATES}, {KEPT} SELECT c.id AS event_id, concat('anomalies.', c.app_id, '.big_k') AS topic, CASE WHEN k < 5 THEN 'below_min' ELSE 'above_max' END AS violation
  FROM kept JOIN cand c ON c.app_id = kept.app_id AND c.rn = kept.rn""")
def anomaly_records(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.records(_alerts(spark, d), "threshold").select("event_id", "topic", F.get_json_object("value", "$.details.violation").alias("violation"))


@query(f"WITH {CANDIDATES}, {KEPT} SELECT 't' AS anomaly_config_id, c.app_id, max(c.timestamp_ms) AS last_alert_ms FROM kept JOIN cand c ON c.app_id = kept.app_id AND c.rn = kept.rn GROUP BY ALL")
def last_alerts(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.last_alerts(anomaly.records(_alerts(spark, d), "threshold"))


@query("SELECT app_id, (timestamp_ms // 1000 + 62135596800) // 604800 * 604800 - 62135596800 AS window_start, count(*) AS n FROM ev GROUP BY ALL")
def aligned_windows(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("app_id", scalars.window_start(F.col("timestamp_ms"), 604_800).alias("window_start")).agg(F.count("*").alias("n"))


# --- deduplication, sessions, identity


@query("SELECT id, idempotency_key FROM ev QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY timestamp_ms, id) = 1")
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    return dedup.first_of_key(events(spark, d)).select("id", "idempotency_key")


@query("""WITH cand AS (SELECT id, device_id AS app_id, timestamp_ms, row_number() OVER (PARTITION BY device_id ORDER BY timestamp_ms, id) AS rn FROM ev),
nxt AS (SELECT a.app_id, a.rn, min(b.rn) AS nrn FROM cand a JOIN cand b ON a.app_id = b.app_id AND b.rn > a.rn AND b.timestamp_ms >= a.timestamp_ms + 21600000 GROUP BY ALL),
kept AS (SELECT app_id, cast(1 AS bigint) AS rn FROM cand WHERE rn = 1 UNION ALL SELECT n.app_id, n.nrn FROM kept q JOIN nxt n ON q.app_id = n.app_id AND q.rn = n.rn)
SELECT c.id FROM kept JOIN cand c ON c.app_id = kept.app_id AND c.rn = kept.rn""")
def dedup_within_window(spark: SparkSession, d: str) -> DataFrame:
    keyed = events(spark, d).withColumn("idempotency_key", F.col("device_id"))
    return dedup.first_within(keyed, 6 * 3600 * 1000).select("id")


@query("SELECT id FROM ev WHERE idempotency_key NOT IN (SELECT idempotency_key FROM ev WHERE cast(id AS bigint) % 3 = 0)")
def dedup_unseen(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return dedup.unseen(e, e.where(F.col("id").cast("long") % 3 == 0)).select("id")


@query("SELECT idempotency_key, min(id) AS id FROM ev GROUP BY ALL")
def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("idempotency_key", "id")
    old = e.groupBy("idempotency_key").agg(F.min("id").alias("id")).where(F.xxhash64("idempotency_key") % 2 == 0)
    return dedup.insert_ignore(old, e, "idempotency_key")


@query("SELECT device_id, id, timestamp_ms FROM ev QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY timestamp_ms DESC, id DESC) <= 3")
def newest_n_per_device(spark: SparkSession, d: str) -> DataFrame:
    return dedup.newest(events(spark, d), 3).select("device_id", "id", "timestamp_ms")


SESSIONS = """s AS (SELECT *, sum(new) OVER (PARTITION BY device_id ORDER BY timestamp_ms, id) AS session_no FROM (
  SELECT *, CASE WHEN timestamp_ms - lag(timestamp_ms) OVER (PARTITION BY device_id ORDER BY timestamp_ms, id) <= 10800000 THEN 0 ELSE 1 END AS new FROM ev)),
sums AS (SELECT device_id, cast(session_no AS bigint) AS session_no, min(timestamp_ms) AS start_ms, max(timestamp_ms) AS end_ms, count(*) AS events, max(timestamp_ms) - min(timestamp_ms) AS duration_ms FROM s GROUP BY 1, 2)"""


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions.summaries(sessions.sessionize(events(spark, d), 3 * 3600 * 1000))


@query(f"WITH {SESSIONS} SELECT * FROM sums", name="sessions")
def sessions_(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d)


@query(f"""WITH {SESSIONS} SELECT device_id, session_no, 'session_start' AS event_type, start_ms AS timestamp_ms, NULL::bigint AS duration_ms FROM sums
UNION ALL SELECT device_id, session_no, 'session_end', end_ms, duration_ms FROM sums""")
def session_start_end(spark: SparkSession, d: str) -> DataFrame:
    return sessions.boundary_events(_sessions(spark, d))


@query("""WITH sides AS (SELECT device_id, timestamp_ms, 1 AS side, cast(NULL AS varchar) AS u, id FROM ev WHERE event_type = 'view'
  UNION ALL SELECT device_id, timestamp_ms, 0, CASE WHEN event_type = 'signup' THEN concat('u', id) ELSE '' END, NULL FROM ev WHERE event_type IN ('signup', 'app_crash'))
SELECT id, nullif(who, '') AS user_id FROM (SELECT id, side, last_value(u IGNORE NULLS) OVER (PARTITION BY device_id ORDER BY timestamp_ms, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS who FROM sides) WHERE side = 1""")
def identity_asof(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    changes = e.where("event_type in ('signup', 'app_crash')").select("device_id", "timestamp_ms", F.when(F.col("event_type") == "signup", F.concat(F.lit("u"), "id")).alias("user_id"))
    return sessions.identity_as_of(e.where("event_type = 'view'"), changes).select("id", "user_id")


# --- keys and deliveries


def _keys(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.select(scalars.key_hash(F.concat(F.lit("key"), F.col("c_custkey"))).alias("key_hash"), F.concat(F.lit("app"), F.col("c_nationkey")).alias("app_id"), (F.col("c_acctbal") < 0).alias("revoked"))


def _requests(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select("o_orderkey", F.concat(F.lit("key"), F.col("o_custkey") + F.when(F.col("o_orderkey") % 10 == 0, 100_000_000).otherwise(0)).alias("key"))


KEYS = "FROM orders JOIN customer ON c_custkey = o_custkey AND c_acctbal >= 0 AND o_orderkey % 10 <> 0"


@query(f"SELECT o_orderkey, concat('app', c_nationkey) AS key_app_id {KEYS}")
def api_key_semi(spark: SparkSession, d: str) -> DataFrame:
    return deliveries.audited(_requests(spark, d), _keys(spark, d)).select("o_orderkey", "key_app_id")


@query(f"SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey {KEYS})")
def api_key_anti(spark: SparkSession, d: str) -> DataFrame:
    return deliveries.audited(_requests(spark, d), _keys(spark, d), accepted=False).select("o_orderkey")


@query("SELECT o_orderkey, length(sha256(concat('key', o_custkey))) = 64 AND o_orderkey % 4 <> 0 AS ok FROM orders")
def api_key_format(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    key = scalars.key_hash(F.concat(F.lit("key"), F.col("o_custkey")))
    return o.select("o_orderkey", scalars.well_formed_key(F.when(F.col("o_orderkey") % 4 == 0, F.upper(F.concat(key, F.lit("g")))).otherwise(key)).alias("ok"))


def _deliveries(spark: SparkSession, d: str) -> DataFrame:
    o, at = spark.read.parquet(f"{d}/orders.parquet"), F.col("o_orderdate").cast("timestamp")
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("w"), F.col("o_custkey") % 6).alias("webhook_id"), F.lit("r").alias("rule_id"), F.lit("{}").alias("payload"),
        F.when(F.col("o_orderstatus") == "F", "delivered").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("pending").alias("status"),
        (F.col("o_orderkey") % 5).cast("int").alias("attempts"), F.lit(5).alias("max_attempts"), at.alias("next_attempt_at"),
        *[F.lit(None).cast(DELIVERY[c].dataType).alias(c) for c in ("last_attempt_at", "delivered_at", "last_error", "last_status_code")],
    ).to(DELIVERY)


def _webhooks(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/region.parquet").select(F.concat(F.lit("w"), F.col("r_regionkey")).alias("id"), (F.col("r_regionkey") != 3).alias("enabled"))


DELIVERIES = """dl AS (SELECT cast(o_orderkey AS varchar) AS id, o_custkey % 6 AS w, o_orderkey,
  CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'P' THEN 'in_progress' ELSE 'pending' END AS status, cast(o_orderkey % 5 AS integer) AS attempts, o_orderdate AS next_attempt_at FROM orders)"""
NOW = datetime(1998, 1, 1, tzinfo=UTC)


@query(f"WITH {DELIVERIES} SELECT status, count(*) AS n FROM dl GROUP BY ALL")
def delivery_stats(spark: SparkSession, d: str) -> DataFrame:
    return deliveries.stats(_deliveries(spark, d))


@query(f"WITH {DELIVERIES} SELECT id, status FROM dl WHERE status IN ('pending', 'in_progress') AND next_attempt_at <= TIMESTAMP '1998-01-01' ORDER BY next_attempt_at, id LIMIT 100")
def due_deliveries(spark: SparkSession, d: str) -> DataFrame:
    return deliveries.due(_deliveries(spark, d), F.lit(NOW), 100).select("id", "status")


@query(f"""WITH {DELIVERIES}, t AS (SELECT *, w NOT IN (3, 5) AND o_orderkey % 3 <> 0 AS ok FROM dl)
SELECT id, CASE WHEN status = 'delivered' THEN status WHEN ok THEN 'delivered' WHEN attempts + 1 >= 5 THEN 'dead_letter' ELSE 'pending' END AS status,
  CASE WHEN status = 'delivered' THEN attempts ELSE attempts + 1 END AS attempts,
  CASE WHEN status = 'delivered' OR ok THEN NULL WHEN w = 5 THEN 'webhook not found' WHEN w = 3 THEN 'webhook is disabled' ELSE 'status 500' END AS last_error,
  epoch_ms(CASE WHEN status = 'delivered' OR ok OR attempts + 1 >= 5 THEN next_attempt_at ELSE TIMESTAMP '1998-01-01' END) +
    CASE WHEN status = 'delivered' OR ok OR attempts + 1 >= 5 THEN 0 ELSE least(1000 * 2 ** attempts, 300000) END::bigint AS next_ms FROM t""")
def delivery_apply_attempts(spark: SparkSession, d: str) -> DataFrame:
    rows = _deliveries(spark, d)
    sent = rows.where("status <> 'delivered'")
    answers = sent.select("id", F.when(F.col("id").cast("long") % 3 == 0, 500).otherwise(204).alias("status_code"))
    done = deliveries.apply_attempts(rows, deliveries.attempt_results(sent, _webhooks(spark, d), answers), F.lit(NOW))
    return done.select("id", "status", "attempts", "last_error", F.unix_millis("next_attempt_at").alias("next_ms"))


@query("SELECT o_orderkey, least(1000 * 2 ** (o_orderkey % 12), 300000)::bigint AS delay_ms FROM orders")
def backoff_schedule(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", scalars.backoff_ms(F.col("o_orderkey") % 12).alias("delay_ms"))


@query("SELECT concat('w', r_regionkey) AS id FROM region WHERE r_regionkey IN (SELECT o_custkey % 6 FROM orders)")
def webhooks_by_ids(spark: SparkSession, d: str) -> DataFrame:
    return deliveries.by_ids(_webhooks(spark, d), _deliveries(spark, d).select(F.col("webhook_id").alias("id"))).select("id")


# --- files


FILES = """f AS (SELECT app_id AS part, concat(lpad(cast(hour AS varchar), 2, '0'), '-', day, '.parquet') AS path, count(*) AS size FROM ev GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY path) AS rn FROM f WHERE size < 40),
p AS (SELECT part, rn, path, cast(0 AS bigint) AS pack, size AS total FROM o WHERE rn = 1
  UNION ALL SELECT o.part, o.rn, o.path, CASE WHEN p.total + o.size > 40 THEN p.pack + 1 ELSE p.pack END, CASE WHEN p.total + o.size > 40 THEN o.size ELSE p.total + o.size END FROM p JOIN o ON o.part = p.part AND o.rn = p.rn + 1)"""


@query(f"WITH {FILES} SELECT part AS partition, pack, array_to_string(list(path ORDER BY path), ',') AS paths FROM p GROUP BY 1, 2 HAVING count(*) >= 2")
def small_file_packing(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lpad(F.col("hour").cast("string"), 2, "0"), F.lit("-"), F.col("day"), F.lit(".parquet"))
    files = events(spark, d).groupBy(F.col("app_id").alias("partition"), path.alias("path")).agg(F.count("*").alias("size"))
    return warehouse.pack_files(files, 40).withColumn("paths", F.array_join("paths", ","))


def _folder(spark: SparkSession, tag: str) -> str:
    """A new folder where all executors can write."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-events-')}"
    return f"{base}/{tag}-{uuid.uuid4().hex}"


ROWS = ("id", "app_id", "device_id", "timestamp_ms", "event_category", "event_type", "payload_json", "year", "month", "day", "hour")


def _warehouse_rows(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return e.select(*[F.col(f.name) if f.name in e.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in EVENT_ROW.fields])


SINK = "SELECT id, app_id, device_id, timestamp_ms, event_category, event_type, payload_json, year, month, day, hour FROM ev"


@query(SINK)
def sink_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "warehouse")
    warehouse.append(_warehouse_rows(spark, d), path)
    return warehouse.read(spark, path).select(*ROWS)


@query(SINK)
def compaction_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "warehouse")
    rows = _warehouse_rows(spark, d)
    for part in range(2):
        warehouse.append(rows.where(F.pmod(F.xxhash64("id"), F.lit(2)) == part), path)
    warehouse.compact(spark, path, datetime(2024, 6, 1))
    return warehouse.read(spark, path).select(*ROWS)


# --- streams over the same table


def _stream(spark: SparkSession, d: str, build, mode: str = "append") -> DataFrame:
    """Run a streaming query over the events as the files give them and return what it wrote; a complete query's last batch is all of it, windows that are still open included."""
    path = _folder(spark, "stream")
    # a file source wants folders or patterns
    raw = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parque[t]")
    writer = build(adapter.adapted(raw)).writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True)
    if mode == "complete":
        writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start().awaitTermination()
    else:
        writer.start(path, format="parquet").awaitTermination()
    return spark.read.parquet(path)


@query("SELECT DISTINCT idempotency_key FROM ev")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    return _stream(spark, d, lambda e: pipelines.dedup(e, "60 days").select("idempotency_key"))


@query(f"WITH {SESSIONS} SELECT device_id, start_ms, events FROM sums")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    found = _stream(spark, d, lambda e: pipelines.sessions(e, "3 hours", "1 minute"), "complete")
    return found.select("device_id", F.unix_millis("start").alias("start_ms"), "events")


@query("SELECT app_id, timestamp_ms // 3600000 * 3600000 AS start_ms, count(*) AS n FROM ev GROUP BY ALL")
def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    found = _stream(spark, d, lambda e: pipelines.window_counts(e, 3600, "1 minute"), "complete")
    return found.select("app_id", F.unix_millis("start").alias("start_ms"), "n")


@query("SELECT id FROM ev QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY timestamp_ms, id) = 1")
def dedup_redelivered(spark: SparkSession, d: str) -> DataFrame:
    """Deduplication within a window longer than the table over events that each came twice."""
    e = events(spark, d)
    return dedup.first_within(e.unionByName(e), 60 * 24 * 3600 * 1000).select("id")


@query(f"WITH {CANDIDATES}, {KEPT} SELECT c.id, c.app_id, c.timestamp_ms FROM kept JOIN cand c ON c.app_id = kept.app_id AND c.rn = kept.rn")
def cooldown_redelivered(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    alerts = anomaly.threshold(e.unionByName(e), adapter.configs(spark, THRESHOLD | {"cooldown_seconds": 3600}))
    return anomaly.cooled(alerts).select("id", "app_id", "timestamp_ms")


# --- streams with state, over events that come in no order over several batches

DAY_MS = 86_400_000
#: Days of a file, and of the watermark's delay: a tenth of the events comes a file late.
FILE_DAYS, LATE_DAYS = 6, 12


#: Files of a batch, each written by a task of its own.
PARTS = 8


def _deal(rows: DataFrame, path: str) -> None:
    """Write rows as the files of one batch of _dealt, in no order."""
    own = rows.withColumn("_n", F.xxhash64(*[c for c in ("id", "event_id") if c in rows.columns])).withColumn("part", F.pmod("_n", F.lit(PARTS)))
    own.repartition(PARTS, "part").sortWithinPartitions("part", "_n").drop("_n").write.mode("append").partitionBy("part").parquet(path)


def _dealt(spark: SparkSession, schema, path: str) -> DataFrame:
    """The stream of what has been dealt; files are taken by age."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", PARTS).parquet(path)


def _late_stream(spark: SparkSession, d: str, build) -> DataFrame:
    """Run a query in append mode over the events, a few days a file in no order, some of them a file late; return what it wrote."""
    path = _folder(spark, "late-stream")
    raw = spark.read.parquet(f"{d}/events.parquet")
    day = F.floor((F.unix_millis(F.col("ts").cast("timestamp")) - 1_704_067_200_000) / DAY_MS)
    dealt = raw.withColumn("_file", F.floor(day / FILE_DAYS) + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0))
    for k in range(30 // FILE_DAYS + 1):
        _deal(dealt.where(F.col("_file") == k).drop("_file"), f"{path}-in")
    stream = _dealt(spark, raw.schema, f"{path}-in")
    writer = build(adapter.adapted(stream)).writeStream.outputMode("append").option("checkpointLocation", f"{path}-state").trigger(availableNow=True)
    writer.start(path, format="parquet").awaitTermination()
    return spark.read.parquet(path)


def _until(rows: str) -> str:
    """Where the watermark has come to in the end, over rows."""
    return f"timestamp_ms <= (SELECT max(timestamp_ms) FROM {rows}) - {LATE_DAYS * DAY_MS}"


LATE = f"{LATE_DAYS} days"


@query(f"SELECT id, idempotency_key, timestamp_ms FROM (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY timestamp_ms, id) = 1) WHERE {_until('ev')}")
def stream_first_of_key(spark: SparkSession, d: str) -> DataFrame:
    """The earliest event of each key, whichever came first."""
    return _late_stream(spark, d, lambda e: states.first_within(e.select("id", "idempotency_key", "timestamp_ms"), 60 * DAY_MS, LATE))


@query(f"WITH {CANDIDATES}, {KEPT} SELECT c.id, c.app_id, c.timestamp_ms FROM kept JOIN cand c ON c.app_id = kept.app_id AND c.rn = kept.rn WHERE c.{_until('cand')}")
def stream_cooldown(spark: SparkSession, d: str) -> DataFrame:
    """The batch row's alerts as far as the watermark comes; the time to live is no longer than the cooldown, so most keys expire on the way."""
    config = adapter.configs(spark, THRESHOLD | {"cooldown_seconds": 3600})
    candidates = lambda e: anomaly.threshold(e, config).select("config_id", "app_id", "id", "timestamp_ms", (F.col("cooldown_seconds").cast("long") * 1000).alias("cooldown_ms"))
    return _late_stream(spark, d, lambda e: states.cooled(candidates(e), LATE, ttl_ms=3_600_000).select("id", "app_id", "timestamp_ms"))


@query(f"SELECT * FROM (SELECT id, app_id, timestamp_ms, row_number() OVER (PARTITION BY app_id, timestamp_ms // 3600000 ORDER BY timestamp_ms, id) AS running FROM ev) WHERE running > 3 AND {_until('ev')}")
def stream_rate_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Each event after the first three of its app and hour."""
    columns = {"config_id": F.lit("r"), "window_seconds": F.lit(3600), "window_start": scalars.window_start(F.col("timestamp_ms"), 3600), "most": F.lit(3)}
    return _late_stream(spark, d, lambda e: states.rate_alerts(e.select("id", "app_id", "timestamp_ms").withColumns(columns), LATE).select("id", "app_id", "timestamp_ms", "running"))


#: Sign-ups stand for the app going to the background and crashes for its coming back.
SWITCHED = "sw AS (SELECT id, device_id, timestamp_ms, CASE event_type WHEN 'signup' THEN 'app_background' WHEN 'app_crash' THEN 'app_foreground' ELSE event_type END AS event_type FROM ev)"
BACKGROUND = f"""{SWITCHED},
b AS (SELECT *, lag(timestamp_ms) OVER o AS before, last_value(CASE event_type WHEN 'app_background' THEN timestamp_ms WHEN 'app_foreground' THEN -1 END IGNORE NULLS) OVER (PARTITION BY device_id ORDER BY timestamp_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS away
  FROM sw WINDOW o AS (PARTITION BY device_id ORDER BY timestamp_ms, id)),
bs AS (SELECT *, sum(CASE WHEN before IS NULL OR timestamp_ms - before > 10800000 OR (event_type = 'app_foreground' AND away >= 0 AND timestamp_ms - away > 10800000) THEN 1 ELSE 0 END) OVER (PARTITION BY device_id ORDER BY timestamp_ms, id) AS session_no FROM b),
sums AS (SELECT device_id, cast(session_no AS bigint) AS session_no, min(timestamp_ms) AS start_ms, max(timestamp_ms) AS end_ms, count(*) AS events, max(timestamp_ms) - min(timestamp_ms) AS duration_ms FROM bs GROUP BY 1, 2)"""


def _switched(events_: DataFrame) -> DataFrame:
    return events_.withColumn("event_type", F.when(F.col("event_type") == "signup", "app_background").when(F.col("event_type") == "app_crash", "app_foreground").otherwise(F.col("event_type")))


@query(f"WITH {BACKGROUND} SELECT * FROM sums")
def sessions_background(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that also end when the app comes back from a long time in the background."""
    return sessions.summaries(sessions.sessionize(_switched(events(spark, d)), 3 * 3600 * 1000))


@query(f"""WITH {BACKGROUND}, w AS (SELECT max(timestamp_ms) - {LATE_DAYS * DAY_MS} AS w FROM ev), n AS (SELECT *, lead(start_ms) OVER (PARTITION BY device_id ORDER BY session_no) AS next_ms FROM sums)
SELECT device_id, session_no, 'session_start' AS event_type, start_ms AS timestamp_ms, NULL::bigint AS events, NULL::bigint AS duration_ms FROM n, w WHERE start_ms <= w
UNION ALL SELECT device_id, session_no, 'session_end', end_ms, events, duration_ms FROM n, w WHERE end_ms + 10800000 <= w OR next_ms <= w""")
def stream_session_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Starts and ends of sessions as the watermark comes to know them."""
    return _late_stream(spark, d, lambda e: states.session_boundaries(_switched(e), 3 * 3600 * 1000, LATE))


@query(f"SELECT * FROM (SELECT app_id, timestamp_ms // 3600000 * 3600000 AS start_ms, count(*) AS n FROM ev GROUP BY ALL) WHERE start_ms + 3600000 <= (SELECT max(timestamp_ms) FROM ev) - {LATE_DAYS * DAY_MS}")
def stream_closed_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows that the watermark has closed, each once."""
    found = _late_stream(spark, d, lambda e: pipelines.window_counts(e, 3600, LATE))
    return found.select("app_id", F.unix_millis("start").alias("start_ms"), "n")


# --- rules over the whole event document


@query("""SELECT id, 'device' AS rule_id FROM ev WHERE cast(id AS bigint) % 5 <> 0 AND platform = 'PLATFORM_IOS'
UNION ALL SELECT id, 'order' FROM ev WHERE cast(id AS bigint) % 11 <> 0 AND event_type = 'purchase_complete' AND cast(id AS bigint) % 3 >= 2
UNION ALL SELECT id, 'no device' FROM ev WHERE cast(id AS bigint) % 5 = 0""")
def rule_hits_document(spark: SparkSession, d: str) -> DataFrame:
    """Rules on a field of the device, on the payload by its name, and on a path that a part of the events lacks."""
    table = adapter.rules(
        spark,
        {"id": "device", "conditions": [("device_context.platform", "eq", json.dumps("PLATFORM_IOS"))]},
        {"id": "order", "conditions": [("purchase_complete.item_count", "gte", json.dumps(2))]},
        {"id": "no device", "conditions": [("device_context.locale", "not_exists", json.dumps(None))]},
    )
    return rules.hits(classify.with_document(odd_envelopes(spark, d)), table, "document").select("id", "rule_id")


@query("""SELECT id FROM ev WHERE cast(id AS bigint) % 11 <> 0 AND event_type = 'purchase_complete'""")
def document_narrow(spark: SparkSession, d: str) -> DataFrame:
    """The narrower document has the purchase but not the view."""
    rows = classify.with_document(odd_envelopes(spark, d), classify.STRICT_DEVICE, classify.STRICT_PAYLOADS)
    has = lambda name: F.get_json_object("document", f"$.{name}").isNotNull()
    return rows.where(has("purchase_complete") | has("screen_view")).select("id")


# --- ingest and scalars, one by one


@query(f"SELECT id, {STATUS} IS NULL AS kept FROM ev")
def enriched(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers stay where given and are filled where not; only accepted envelopes are."""
    rows = ingest.validate(odd_envelopes(spark, d))
    filled = ingest.enrich(rows.where("error is null").drop("error"))
    return rows.select("id").join(filled.select("id", F.lit(True).alias("kept")), "id", "left").select("id", F.coalesce("kept", F.lit(False)).alias("kept"))


@query("SELECT id, strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m-%dT%H:%M') AS minute FROM ev")
def minute_keys(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("id", scalars.minute_key(F.timestamp_millis("timestamp_ms")).alias("minute"))


@query("SELECT concat('h', cast(o_custkey AS varchar)) AS key_hash, concat('app', o_custkey % 4) AS app_id, max(o_orderdate) AS created_at FROM orders WHERE o_custkey % 4 = 1 GROUP BY ALL")
def keys_of_app(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    table = o.groupBy(F.concat(F.lit("h"), "o_custkey").alias("key_hash"), F.concat(F.lit("app"), F.col("o_custkey") % 4).alias("app_id")).agg(F.max("o_orderdate").alias("created_at"))
    return deliveries.keys_of(table.withColumn("id", F.col("key_hash")), "app1").select("key_hash", "app_id", "created_at")


# --- tables that batches add to


def _logged(spark: SparkSession, d: str) -> str:
    """Threshold alerts in the anomaly log, in three batches, one of them tried twice."""
    path = _folder(spark, "anomaly-log")
    found = anomaly.records(anomaly.threshold(events(spark, d), adapter.configs(spark, THRESHOLD, THRESHOLD | {"id": "other/one", "max": 50.0})), "threshold")
    for k in (0, 1, 1, 2):
        anomaly_log.append(found.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k), path, k)
    return path


def _page_query(number: int, size: int = 40) -> None:
    @query(f"WITH {CANDIDATES} SELECT id AS event_id, app_id, timestamp_ms FROM cand ORDER BY timestamp_ms DESC, id DESC LIMIT {size} OFFSET {size * (number - 1)}", name=f"anomaly_log_page_{number}")
    def page(spark: SparkSession, d: str) -> DataFrame:
        path, after = _logged(spark, d), None
        for _ in range(number - 1):  # each page goes on from the last row of the one before
            last = anomaly_log.page(spark, path, "t", size, after).orderBy("timestamp_ms", "event_id").first()
            after = (last["timestamp_ms"], last["event_id"]) if last else after
        return anomaly_log.page(spark, path, "t", size, after).select("event_id", "app_id", "timestamp_ms")


for _number in (1, 3):
    _page_query(_number)


@query("SELECT 'c' AS config_id, app_id, strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m-%dT%H') AS window_key, count(*) AS event_count, max(timestamp_ms) AS updated_ms FROM ev GROUP BY ALL")
def counter_upserts(spark: SparkSession, d: str) -> DataFrame:
    """Counters by hour over three batches, one tried twice, folded between the second and the third."""
    path = _folder(spark, "counters")
    e = events(spark, d).select(F.lit("c").alias("config_id"), "app_id", F.date_format(F.timestamp_millis("timestamp_ms"), "yyyy-MM-dd'T'HH").alias("window_key"), "timestamp_ms", "id")
    for k in (0, 1, 1, 2):
        counters.add(e.where(F.pmod(F.xxhash64("id"), F.lit(3)) == k), path, k)
        if k == 1:
            counters.fold(spark, path)
    return counters.read(spark, path)


@query(f"""WITH {DELIVERIES}, q AS (SELECT id, row_number() OVER (ORDER BY next_attempt_at, id) AS n FROM dl WHERE status IN ('pending', 'in_progress') AND next_attempt_at <= TIMESTAMP '1998-01-01')
SELECT id, CASE WHEN n <= 60 THEN 'c' WHEN n <= 120 THEN 'b' ELSE 'a' END AS worker FROM q WHERE n <= 160""")
def claimed_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """a's claim runs out before c's, which gets the same again; b's holds; a then takes what is left."""
    held, rows = claims.Claims(spark, _folder(spark, "claims")), _deliveries(spark, d)
    now = int(NOW.timestamp() * 1000)
    held.claim(rows, "a", 60, now, 1000)
    held.claim(rows, "b", 60, now, 60_000)
    held.claim(rows, "c", 60, now + 2000, 60_000)
    held.claim(rows, "a", 40, now + 3000, 60_000)
    return held.held(now + 4000).select("id", "worker")


@query("SELECT id, timestamp_ms FROM ev WHERE timestamp_ms >= 1705307696789")
def retention_within_hour(spark: SparkSession, d: str) -> DataFrame:
    """The table cut at 08:34:56.789 of a day."""
    path = _folder(spark, "warehouse")
    warehouse.append(_warehouse_rows(spark, d), path)
    warehouse.keep_since(spark, path, datetime(2024, 1, 15, 8, 34, 56, 789_000))
    return warehouse.read(spark, path).select("id", "timestamp_ms")


# --- streams end to end


def _lines(spark: SparkSession, d: str, n_files: int) -> str:
    """The odd envelopes as JSON lines, a folder for each part of the time; every seventeenth line is cut off."""
    path = _folder(spark, "lines")
    text = F.to_json(F.struct(*ENVELOPE.names))
    cut = F.when(F.col("id").cast("long") % 17 == 0, F.substring(text, 1, 20)).otherwise(text)
    # by time, so that a batch has hours of its own
    rows = odd_envelopes(spark, d).select(cut.alias("value"), F.pmod(F.floor(F.col("timestamp_ms") / (30 * DAY_MS / n_files)), F.lit(n_files)).alias("_k"))
    for k in range(n_files):
        rows.where(F.col("_k") == k).drop("_k").coalesce(1).write.text(f"{path}/{k}")
    return path


@query(f"SELECT id, app_id, 1 AS times FROM ev WHERE {STATUS} IS NULL AND cast(id AS bigint) % 17 <> 0")
def sink_of_two_queries(spark: SparkSession, d: str) -> DataFrame:
    """Two queries with checkpoints of their own, so with the same batch numbers, write into one table, one at once and one in a carried batch."""
    source, path = _lines(spark, d, 2), _folder(spark, "warehouse")
    for k, (name, least) in enumerate((("a", 0), ("b", 10**9))):
        stream = pipelines.envelopes(spark, f"{source}/{k}", 1)
        started = pipelines.sink(stream, path, f"{path}-rejects", f"{path}-{name}", least_rows=least, seconds=3600).trigger(availableNow=True).start()
        started.awaitTermination()
        if least:
            pipelines.Carried(spark, path, str(started.id), least, 0).flush(10**6, now=True)
    return warehouse.read(spark, path).groupBy("id", "app_id").agg(F.count("*").cast("int").alias("times"))


@query("""SELECT id, 'r1' AS rule_id FROM ev WHERE event_category = 'screen'
UNION ALL SELECT id, 'r2' FROM ev WHERE cast(id AS bigint) % 2 = 1 AND app_id = 'app1'""")
def live_rules(spark: SparkSession, d: str) -> DataFrame:
    """A running query over two batches, between which a rule is added."""
    path = _folder(spark, "live")
    e = events(spark, d).drop("value")
    for k in range(2):
        _deal(e.where(F.col("id").cast("long") % 2 == k), f"{path}-in")
    first = {"id": "r1", "event_category": "screen"}
    tables = iter((adapter.rules(spark, first), adapter.rules(spark, first, {"id": "r2", "app_id": "app1"})))
    stream = _dealt(spark, e.schema, f"{path}-in")
    writer = pipelines.live_hits(stream, lambda: next(tables), 0, lambda found, k: found.select("id", "rule_id").write.mode("overwrite").parquet(f"{path}/batch={k}"))
    writer.option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).select("id", "rule_id")


@query(f"WITH {CANDIDATES}, {KEPT} SELECT c.id AS event_id, c.app_id FROM kept JOIN cand c ON c.app_id = kept.app_id AND c.rn = kept.rn")
def live_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Alerts with a cooldown over the batches of a stream, which come in order of time, by way of the log."""
    path = _folder(spark, "live-alerts")
    e = events(spark, d).drop("value")
    for k in range(3):
        third = F.least(F.floor((F.col("timestamp_ms") - 1_704_067_200_000) / (10 * DAY_MS)), F.lit(2))
        _deal(e.where(third == k), f"{path}-in")
    stream = _dealt(spark, e.schema, f"{path}-in")
    load = lambda: adapter.configs(spark, THRESHOLD | {"cooldown_seconds": 3600})
    pipelines.live_alerts(stream, load, 30, path, "one").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return anomaly_log.read(spark, path).select("event_id", "app_id")


@query("SELECT id, 3 AS deliveries, 'refused' AS error FROM ev WHERE cast(id AS bigint) % 29 = 0")
def dead_after_tries(spark: SparkSession, d: str) -> DataFrame:
    """A consumer refuses some records always and others once; after three tries a record is dead."""
    path = _folder(spark, "ledger")
    rows = events(spark, d)
    for k in range(2):
        rows.where(F.col("id").cast("long") % 2 == k).select("id").coalesce(1).write.mode("append").text(f"{path}-in")
    ledger = redelivery.Ledger(spark, path, "events.app1.screen.view", "events", "one", 3)
    always, once = F.col("record").cast("long") % 29 == 0, (F.col("record").cast("long") % 31 == 0) & (F.col("tries") == 0)
    consume = lambda given, _: given.where(always | once).withColumn("error", F.lit("refused"))
    ledger.attach(redelivery.lines(spark, f"{path}-in", 1), consume).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    number = redelivery.last_number(ledger)
    while not ledger.waiting(number).isEmpty():  # nothing new comes, the rest is tried again
        number += 1
        ledger.deliver(spark.createDataFrame([], "record string, arrived_ms long"), number, consume)
    return ledger.dead().select(F.col("record").alias("id"), "deliveries", "error")


@query("SELECT 'a' AS consumer, event_category AS category, count(*) AS n FROM ev GROUP BY ALL UNION ALL SELECT 'b', event_type, count(*) FROM ev GROUP BY ALL")
def independent_consumers(spark: SparkSession, d: str) -> DataFrame:
    """Two queries on one source; b fails once after its first batch and goes on from its own checkpoint."""
    path = _folder(spark, "consumers")
    e = events(spark, d).drop("value")
    for k in range(2):
        _deal(e.where(F.col("id").cast("long") % 2 == k), f"{path}-in")
    failed: list[int] = []

    def start(name: str, column: str):
        def write(batch: DataFrame, number: int) -> None:
            if name == "b" and number == 1 and not failed:
                failed.append(number)
                raise RuntimeError("b stops")
            batch.select(F.lit(name).alias("consumer"), F.col(column).alias("category")).write.mode("overwrite").parquet(f"{path}/of={name}/batch={number}")

        stream = _dealt(spark, e.schema, f"{path}-in")
        return lambda: stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}-{name}").trigger(availableNow=True).start()

    metrics.Consumers({"a": start("a", "event_category"), "b": start("b", "event_type")}).run()
    return spark.read.parquet(path).groupBy("consumer", "category").agg(F.count("*").alias("n"))


@query("SELECT 2 AS batches, count(*) AS input_rows, cast(0 AS bigint) AS late_rows FROM ev")
def stream_counters(spark: SparkSession, d: str) -> DataFrame:
    """What the listener's table says of a query over two files."""
    path = _folder(spark, "metrics")
    e = events(spark, d).select("id", "timestamp_ms", "app_id")
    for k in range(2):
        _deal(e.where(F.col("id").cast("long") % 2 == k), f"{path}-in")
    stream = _dealt(spark, e.schema, f"{path}-in")
    with metrics.Progress(spark, path):
        started = stream.writeStream.format("noop").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
        started.awaitTermination()
    own = metrics.read(spark, path).where(F.col("query") == str(started.id)).where("input_rows > 0")
    return metrics.counters(own).select(F.col("batches").cast("int").alias("batches"), "input_rows", "late_rows")


# --- what had no row of its own


@query("""SELECT cast(id AS bigint) AS n, cast(id AS bigint) % 6 = 0 AS id_made, cast(id AS bigint) % 4 = 0 AS key_made FROM ev""")
def enriched_fields(spark: SparkSession, d: str) -> DataFrame:
    """Envelopes of which some lack an id or a key: what was there stays, a made id is a time-ordered UUID, a made key unlike any other."""
    e = odd_envelopes(spark, d).withColumn("_n", F.col("id").cast("long"))
    given = e.withColumns({"id": F.when(F.col("_n") % 6 == 0, "").otherwise(F.col("id")), "idempotency_key": F.when(F.col("_n") % 8 == 0, None).when(F.col("_n") % 4 == 0, "").otherwise(F.col("idempotency_key")), "_key": F.col("idempotency_key")})
    path = _folder(spark, "enriched")
    ingest.enrich(given).select("_n", "id", "idempotency_key", "_key").write.parquet(path)
    made, keys = spark.read.parquet(path), spark.read.parquet(path).groupBy("idempotency_key").count().withColumnRenamed("count", "_uses")
    uuid7 = F.col("id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$") & F.col("id").startswith(F.substring(F.lower(F.lpad(F.hex(F.unix_millis(F.current_timestamp())), 12, "0")), 1, 4))
    return made.join(keys, "idempotency_key").select(
        F.col("_n").alias("n"), F.when(F.col("id") == F.col("_n").cast("string"), False).when(uuid7, True).alias("id_made"),
        F.when(F.col("idempotency_key") == F.col("_key"), False).when(F.col("idempotency_key").rlike("^[0-9a-f-]{36}$") & (F.col("_uses") == 1), True).alias("key_made"),
    )


@query(f"""SELECT id, coalesce({STATUS}, CASE WHEN cast(id AS bigint) % 19 = 0 THEN 'device_id is required' WHEN event_type = 'view' AND cast(id AS bigint) % 23 = 0 THEN 'screen_view.screen_name is required' END) AS error FROM ev""")
def field_errors(spark: SparkSession, d: str) -> DataFrame:
    """Validation that also wants a device and the payloads' required fields."""
    n = F.col("id").cast("long")
    given = odd_envelopes(spark, d).withColumn("device_id", F.when(n % 19 == 0, "").otherwise(F.col("device_id")))
    view = F.when(F.col("screen_view").isNotNull(), F.col("screen_view").withField("screen_name", F.when(n % 23 == 0, "").otherwise(F.col("screen_view.screen_name"))))
    return ingest.validate(given.withColumn("screen_view", view), device_required=True, fields=True).select("id", "error")


@query("SELECT o_orderkey, true AS near, true AS below FROM orders")
def jitter_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Jittered delays lie within a quarter of the back-off, fully jittered ones between nothing and it."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") % 12).alias("n"))
    drawn = o.select("o_orderkey", scalars.backoff_ms(F.col("n")).alias("b"), scalars.jittered_ms(F.col("n")).alias("j"), scalars.full_jitter_ms(F.col("n")).alias("f"))
    return drawn.select("o_orderkey", F.col("j").between(F.col("b") * 0.75 - 1, F.col("b") * 1.25).alias("near"), F.col("f").between(0, F.col("b")).alias("below"))


@query("SELECT id, CASE lower(split_part(platform, '_', 2)) WHEN 'ios' THEN 'PLATFORM_IOS' WHEN 'web' THEN 'PLATFORM_WEB' ELSE 'PLATFORM_UNSPECIFIED' END AS platform, 'NETWORK_TYPE_CELLULAR_4G' AS network FROM ev")
def enumeration_names(spark: SparkSession, d: str) -> DataFrame:
    """Client spellings of platforms and networks as enumeration names; an unknown one is unspecified."""
    said = F.when(F.col("platform") == "PLATFORM_IOS", "iOS").when(F.col("platform") == "PLATFORM_WEB", "web").otherwise("Toaster")
    raw = F.struct(*[(said if f.name == "platform" else F.lit("4G") if f.name == "network_type" else F.lit(None).cast("string")).alias(f.name) for f in ENVELOPE["device_context"].dataType.fields])
    return events(spark, d).select("id", ingest.device_context(raw).alias("c")).select("id", "c.platform", F.col("c.network_type").alias("network"))


def _letters(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit('{"id":"'), F.col("id"), F.lit('"'), F.when(F.col("id").cast("long") % 17 == 0, "").otherwise("}"))
    _, poison = ingest.split_poison(ingest.decoded(events(spark, d).select(text.alias("value"))))
    return ingest.dead_letters(poison, "events", "stream", "sink", 5)


@query("SELECT id, 'dlq.events' AS subject, 'sink' AS consumer, 'unparsable' AS error, 5 AS deliveries FROM ev WHERE cast(id AS bigint) % 17 = 0")
def dead_letters(spark: SparkSession, d: str) -> DataFrame:
    """Lines that do not parse, with where they came from."""
    return _letters(spark, d).select(F.regexp_extract("record", '"id":"([0-9]+)"', 1).alias("id"), "subject", "consumer", "error", "deliveries")


@query("SELECT count(*) AS depth, count(*) >= 10 AS alert FROM ev WHERE cast(id AS bigint) % 17 = 0")
def dead_letter_depth(spark: SparkSession, d: str) -> DataFrame:
    return ingest.depth(_letters(spark, d), 10)


@query("SELECT id, 'known' AS rule_id FROM ev WHERE app_id = 'app1'")
def rule_hits_unknown(spark: SparkSession, d: str) -> DataFrame:
    """A rule with an operator that is not known matches nothing, and so does one with a pattern that is refused."""
    table = adapter.rules(
        spark, {"id": "known", "app_id": "app1"}, {"id": "unknown", "conditions": [("$.k", "sounds_like", json.dumps("7"))]},
        {"id": "refused", "conditions": [("$.k", "regex", json.dumps("(?=7)"))]},
    )
    return rules.hits(events(spark, d), table).select("id", "rule_id")


@query(f"WITH {HITS} SELECT id, rule_id, cast(row_number() OVER (PARTITION BY id ORDER BY priority DESC, rule_name) - 1 AS integer) AS hit_order FROM hits")
def rule_priority_joined(spark: SparkSession, d: str) -> DataFrame:
    """The same hits as rule_priority by way of the join that many rules take."""
    return rules.Compiled(adapter.rules(spark, *RULES), most=0).hits(events(spark, d)).select("id", "rule_id", "hit_order")


@query("SELECT DISTINCT app_id, year, month, day, hour FROM ev")
def partition_paths(spark: SparkSession, d: str) -> DataFrame:
    """Partitions as the paths of the table's files tell them."""
    path = _folder(spark, "warehouse")
    warehouse.append(_warehouse_rows(spark, d), path)
    return warehouse.partitions_in(spark, path)


@query("SELECT id, concat('v', cast(user_id % 9 AS varchar)) AS app_version FROM (SELECT cast(event_id AS varchar) AS id, user_id FROM events)")
def with_device_context(spark: SparkSession, d: str) -> DataFrame:
    """Events with the context that their device last gave."""
    e = events(spark, d)
    contexts = e.groupBy("device_id").agg(F.max("timestamp_ms").alias("seen_ms")).select("device_id", F.concat(F.lit("v"), (F.substring("device_id", 2, 20).cast("long") % 9).cast("string")).alias("app_version"))
    return sessions.with_context(e, contexts, "device_id").select("id", "app_version")
