"""Anomaly detection in batches: thresholds, rates, counts, cooldowns and alert records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamloom.functions.scalars import anomaly_topic, event_time, minute_key, number, window_start
from streamloom.operators.folds import keep_spaced
from streamloom.operators.rules import event_keys, few, filter_key, json_path, key_join, shapes_of

CONFIG = ("config_id", "config_name", "detection_type", "path", "min", "max", "max_per_minute", "window_seconds", "max_count", "cooldown_seconds")


class Configured:
    """The enabled configurations of a kind with the shapes of their filters and their distinct paths, read once: for the batches of a stream."""

    def __init__(self, configs: DataFrame, detection: str):
        self.table = configs.where(F.col("enabled") & (F.col("detection_type") == detection))
        self.shapes, self.few = shapes_of(self.table), few(self.table)
        self.paths = [r[0] for r in self.table.select("path").distinct().collect() if r[0]] if detection == "threshold" else []


def with_configs(events: DataFrame, configs: DataFrame | Configured, detection: str) -> DataFrame:
    """Events with each enabled configuration of that detection whose filter (null: any) they pass.

    Each event has a key for each choice of wildcards that occurs among the filters, eight at most, so this is an equality
    join for any number of configurations (see key_join).
    """
    own = configs if isinstance(configs, Configured) else Configured(configs, detection)
    renamed = own.table.select(filter_key(wildcards=True).alias("_key"), F.col("id").alias("config_id"), F.col("name").alias("config_name"), *[c for c in CONFIG if c not in ("config_id", "config_name")])
    return key_join(events.withColumn("_key", F.explode(event_keys(own.shapes))), renamed, own.few)


def threshold(events: DataFrame, configs: DataFrame | Configured, document: str = "payload_json") -> DataFrame:
    """Alert candidates: below the least, else above the most; a missing or non-numeric value gives none."""
    own = configs if isinstance(configs, Configured) else Configured(configs, "threshold")
    joined = with_configs(events.withColumn("_doc", F.try_parse_json(document)), own, "threshold")
    # paths differ by configuration, so they are looked up one by one: a handful of distinct literals
    value = F.coalesce(
        F.lit(None).cast("double"),
        *[
            F.when(
                (F.col("path") == p) & (F.schema_of_variant(F.try_variant_get("_doc", json_path(p), "variant")) != "BOOLEAN"),
                number(F.try_variant_get("_doc", json_path(p), "string")),
            )
            for p in own.paths
        ],
    )
    violation = F.when(F.col("value") < F.col("min"), "below_min").when(F.col("value") > F.col("max"), "above_max")
    return joined.withColumn("value", value).withColumn("violation", violation).where("violation is not null").drop("_doc")


def _running(joined: DataFrame, start: Column, most: str) -> DataFrame:
    order = Window.partitionBy("config_id", "app_id", "window_start").orderBy("timestamp_ms", "id")
    counted = joined.withColumn("window_start", start).withColumn("running", F.row_number().over(order).cast("long"))
    return counted.where(F.col("running") > F.col(most))


def rate(events: DataFrame, configs: DataFrame) -> DataFrame:
    """Each event after the first max_per_minute of its configuration, app and minute of event time."""
    return _running(with_configs(events, configs, "rate"), window_start(F.col("timestamp_ms"), 60), "max_per_minute")


def count(events: DataFrame, configs: DataFrame) -> DataFrame:
    """Each event after the first max_count of its configuration, app and window."""
    return _running(with_configs(events, configs, "count"), window_start(F.col("timestamp_ms"), F.col("window_seconds")), "max_count")


def cooled(candidates: DataFrame) -> DataFrame:
    """Candidates at least cooldown_seconds after the last kept alert of their configuration and app."""
    return keep_spaced(candidates, ["config_id", "app_id"], "timestamp_ms", F.col("cooldown_seconds").cast("long") * 1000, "id")


def cooled_after(candidates: DataFrame, last: DataFrame) -> DataFrame:
    """The same with alerts given before: last (anomaly_config_id, app_id, last_alert_ms) counts as kept."""
    before = last.select(F.col("anomaly_config_id").alias("config_id"), "app_id", "last_alert_ms")
    # an equal null app is the same app
    same = (candidates["config_id"] == before["config_id"]) & candidates["app_id"].eqNullSafe(before["app_id"])
    far = F.col("last_alert_ms").isNull() | (F.col("timestamp_ms") - F.col("last_alert_ms") >= F.col("cooldown_seconds").cast("long") * 1000)
    return cooled(candidates.join(before, same, "left").where(far).select(*[candidates[c] for c in candidates.columns]))


def details(detection: str) -> Column:
    """What the alert says, as JSON; null fields are left out."""
    if detection == "threshold":
        below = F.col("violation") == "below_min"
        return F.to_json(F.struct("value", F.when(below, F.col("min")).alias("threshold_min"), F.when(~below, F.col("max")).alias("threshold_max"), "violation"))
    start = F.timestamp_seconds("window_start")
    if detection == "rate":
        return F.to_json(F.struct(F.col("running").alias("rate"), "max_per_minute", minute_key(start).alias("window")))
    return F.to_json(F.struct(F.col("running").alias("count"), "max_count", "window_seconds", F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("window_start")))


def records(alerts: DataFrame, detection: str) -> DataFrame:
    """Alerts as rows of the append-only anomaly log, with topic and message."""
    text = details(detection)
    message = F.to_json(
        F.struct(
            F.col("config_id").alias("anomaly_config_id"), F.col("config_name").alias("anomaly_config_name"), "detection_type", "app_id", "event_category", "event_type",
            F.col("id").alias("event_id"), "device_id", "timestamp_ms", F.try_parse_json(text).alias("details"),
            F.date_format(event_time(F.col("timestamp_ms")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("detected_at"),
        )
    )
    return alerts.select(
        F.col("config_id").alias("anomaly_config_id"), "app_id", "event_category", "event_type", "detection_type", F.col("id").alias("event_id"),
        "timestamp_ms", text.alias("details"), anomaly_topic(F.col("app_id"), F.col("config_name")).alias("topic"), message.alias("value"),
    )


def last_alerts(log: DataFrame) -> DataFrame:
    return log.groupBy("anomaly_config_id", "app_id").agg(F.max("timestamp_ms").alias("last_alert_ms"))
