"""Delivery state: attempts, back-off, dead letters, statistics; and the audit of requests by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamloom.functions.scalars import backoff_ms, key_hash

OPEN = ("pending", "in_progress")


def due(deliveries: DataFrame, now: Column, limit: int) -> DataFrame:
    """The oldest open deliveries whose next attempt has come."""
    return deliveries.where(F.col("status").isin(*OPEN) & (F.col("next_attempt_at") <= now)).orderBy("next_attempt_at", "id").limit(limit)


def attempt_results(deliveries: DataFrame, webhooks: DataFrame, responses: DataFrame) -> DataFrame:
    """(id, ok, error, status_code) of an attempt: a missing or disabled webhook is a failure, else the response decides."""
    hooks = webhooks.select(F.col("id").alias("webhook_id"), F.col("enabled").alias("_enabled"))
    joined = deliveries.join(hooks, "webhook_id", "left").join(responses.select("id", "status_code"), "id", "left")
    live, good = F.coalesce(F.col("_enabled"), F.lit(False)), F.coalesce(F.col("status_code").between(200, 299), F.lit(False))
    error = F.when(F.col("_enabled").isNull(), "webhook not found").when(~live, "webhook is disabled").when(~good, F.concat(F.lit("status "), F.coalesce(F.col("status_code").cast("string"), F.lit("none"))))
    return joined.select("id", (live & good).alias("ok"), error.alias("error"), F.when(live, F.col("status_code")).alias("status_code"))


def apply_attempts(deliveries: DataFrame, results: DataFrame, now: Column, **backoff) -> DataFrame:
    """Deliveries after one attempt each where results has one: delivered, pending again after a back-off, or dead at the last attempt."""
    r = results.select("id", F.col("ok").alias("_ok"), F.col("error").alias("_error"), F.col("status_code").alias("_code"))
    joined, tried = deliveries.join(r, "id", "left"), F.col("_ok").isNotNull()
    failed, attempts = tried & ~F.col("_ok"), F.col("attempts") + 1
    dead = failed & (attempts >= F.col("max_attempts"))
    later = F.timestamp_millis(F.unix_millis(now) + backoff_ms(F.col("attempts"), **backoff))
    new = {
        "status": F.when(dead, "dead_letter").when(failed, "pending").when(tried, "delivered").otherwise(F.col("status")),
        "attempts": F.when(tried, attempts).otherwise(F.col("attempts")),
        "next_attempt_at": F.when(failed & ~dead, later).otherwise(F.col("next_attempt_at")),
        "last_attempt_at": F.when(tried, now).otherwise(F.col("last_attempt_at")),
        "delivered_at": F.when(tried & F.col("_ok"), now).otherwise(F.col("delivered_at")),
        "last_error": F.when(failed, F.col("_error")).otherwise(F.col("last_error")),
        "last_status_code": F.when(tried, F.col("_code")).otherwise(F.col("last_status_code")),
    }
    return joined.withColumns(new).select(*deliveries.columns)


def retry_dead(deliveries: DataFrame, ids: list[str], now: Column) -> DataFrame:
    """Dead deliveries put back by hand."""
    again = (F.col("status") == "dead_letter") & F.col("id").isin(ids)
    return deliveries.withColumns({"status": F.when(again, "pending").otherwise(F.col("status")), "attempts": F.when(again, 0).otherwise(F.col("attempts")), "next_attempt_at": F.when(again, now).otherwise(F.col("next_attempt_at"))})


def stats(deliveries: DataFrame) -> DataFrame:
    return deliveries.groupBy("status").agg(F.count("*").alias("n"))


def by_ids(webhooks: DataFrame, ids: DataFrame) -> DataFrame:
    return webhooks.join(ids.select("id").distinct(), "id", "left_semi")


def audited(requests: DataFrame, keys: DataFrame, accepted: bool = True) -> DataFrame:
    """Requests whose key is known and not revoked, with the key's app; or, not accepted, the others."""
    live = keys.where(~F.col("revoked")).select("key_hash", F.col("app_id").alias("key_app_id"))
    hashed = requests.withColumn("key_hash", key_hash(F.col("key")))
    return hashed.join(live, "key_hash") if accepted else hashed.join(live, "key_hash", "left_anti")


def keys_of(keys: DataFrame, app_id: str) -> DataFrame:
    return keys.where(F.col("app_id") == app_id).orderBy(F.desc("created_at"), "id")


def retained(log: DataFrame, at: str, now: Column, hours: int) -> DataFrame:
    """Rows not older than so many hours."""
    return log.where(F.col(at) >= now - F.make_dt_interval(hours=F.lit(hours)))
