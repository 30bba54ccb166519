"""The benchmark's events table as warehouse rows, and the small configuration tables of the registered queries.

The table has no app, device or payload, so these are derived by expressions that SQL can repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.operators.classify import partition_columns
from streamloom.sources.schemas import ANOMALY_CONFIG, RULE

# Event type of the table -> (category, type).
KINDS = {
    "click": ("interaction", "button_tap"),
    "view": ("screen", "view"),
    "purchase": ("commerce", "purchase_complete"),
    "signup": ("user", "signup"),
    "error": ("system", "app_crash"),
}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapted(spark.read.parquet(f"{sf_dir}/events.parquet"))


def adapted(raw: DataFrame) -> DataFrame:
    """The table, read or streamed, as warehouse rows with an idempotency key that repeats."""
    ts = F.col("ts").cast("timestamp")
    pick = lambda k: F.element_at(F.create_map(*[F.lit(x) for name, pair in KINDS.items() for x in (name, pair[k])]), F.col("event_type"))
    device = F.concat(F.lit("d"), F.col("user_id"))
    return raw.select(
        F.col("event_id").cast("string").alias("id"),
        F.concat(F.lit("app"), F.col("user_id") % 4).alias("app_id"),
        device.alias("device_id"),
        F.unix_millis(ts).alias("timestamp_ms"),
        F.lit("").alias("correlation_id"),
        pick(0).alias("event_category"),
        pick(1).alias("event_type"),
        F.element_at(F.array(F.lit("PLATFORM_IOS"), F.lit("PLATFORM_ANDROID"), F.lit("PLATFORM_WEB")), (F.col("user_id") % 3 + 1).cast("int")).alias("platform"),
        F.concat(F.lit("model"), F.col("user_id") % 7).alias("device_model"),
        F.col("props").alias("payload_json"),
        *[c.alias(n) for n, c in partition_columns(ts).items()],
        F.concat_ws("-", F.col("user_id"), F.col("event_type"), F.date_format(ts, "yyyyMMddHH")).alias("idempotency_key"),
        F.col("value"),
    )


def rules(spark: SparkSession, *rows: dict) -> DataFrame:
    fill = {"name": "", "app_id": None, "event_category": None, "event_type": None, "conditions": [], "webhooks": [], "publish_subjects": [], "priority": 0, "enabled": True}
    full = [fill | r for r in rows]
    return spark.createDataFrame([tuple([tuple(c) for c in r[f.name]] if f.name == "conditions" else r[f.name] for f in RULE.fields) for r in full], RULE)


def configs(spark: SparkSession, *rows: dict) -> DataFrame:
    fill = dict.fromkeys(ANOMALY_CONFIG.names) | {"cooldown_seconds": 300, "enabled": True}
    return spark.createDataFrame([tuple((fill | r)[f.name] for f in ANOMALY_CONFIG.fields) for r in rows], ANOMALY_CONFIG)
