"""From requests to accepted envelopes: decoding, validation, enrichment, per-event results, client conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamloom.functions.scalars import millis_of, named, uuid7
from streamloom.operators.classify import payload_name
from streamloom.sources.schemas import CLIENT_TYPES, ENVELOPE, NETWORKS, PAYLOADS, PLATFORMS, REQUIRED

CORRUPT = "_corrupt_record"
MAX_BATCH = 1000
#: Messages that results carry.
NO_APP, NO_PAYLOAD, NO_TIME = "app_id is required", "event payload is required", "timestamp_ms is required"


def decoded(lines: DataFrame) -> DataFrame:
    """Text lines (value), read or streamed, as envelopes; what does not parse keeps its text in a column of its own."""
    schema = T.StructType([*ENVELOPE.fields, T.StructField(CORRUPT, T.StringType())])
    return lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("_e")).select("_e.*")


def decode(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(envelopes, poison) of a folder of JSON lines: what does not parse is kept apart and never retried."""
    return split_poison(decoded(spark.read.text(path)))


def split_poison(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT), rows.where(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("record"))


def explode_batches(requests: DataFrame, events: str = "events", max_batch: int = MAX_BATCH) -> DataFrame:
    """One row for each event of a request with its index; a request without events or over the limit is one row with batch_error."""
    n = F.coalesce(F.size(events), F.lit(0))
    error = F.when(n <= 0, F.lit("batch must contain at least one event")).when(n > max_batch, F.lit(f"batch exceeds {max_batch} events"))
    kept = F.when(error.isNull(), F.col(events))
    others = [c for c in requests.columns if c != events]
    return requests.withColumn("batch_error", error).select(*others, "batch_error", F.posexplode_outer(kept).alias("index", "event"))


def validation_error(app_id: Column, has_payload: Column, timestamp_ms: Column) -> Column:
    """First failure of: app, payload, time; null if valid."""
    return (
        F.when(F.coalesce(app_id, F.lit("")) == "", NO_APP)
        .when(~F.coalesce(has_payload, F.lit(False)), NO_PAYLOAD)
        .when(F.coalesce(timestamp_ms, F.lit(0)) <= 0, NO_TIME)
    )


def validate(envelopes: DataFrame, device_required: bool = False, fields: bool = False) -> DataFrame:
    """envelopes with a column error; options also require a device id and the payloads' required fields."""
    error = validation_error(F.col("app_id"), payload_name().isNotNull(), F.col("timestamp_ms"))
    if device_required:
        error = F.coalesce(error, F.when(F.coalesce("device_id", F.lit("")) == "", F.lit("device_id is required")))
    if fields:
        empty = [F.when(F.col(p).isNotNull() & (F.coalesce(F.col(f"{p}.{f}"), F.lit("")) == ""), F.lit(f"{p}.{f} is required")) for p, f in REQUIRED.items()]
        error = F.coalesce(error, *empty)
    return envelopes.withColumn("error", error)


def enrich(envelopes: DataFrame) -> DataFrame:
    """Missing ids become time-ordered UUIDs, missing idempotency keys random ones (so they never match)."""
    fill = lambda name, made: F.coalesce(F.nullif(F.col(name), F.lit("")), made)
    return envelopes.withColumns({"id": fill("id", uuid7(F.unix_millis(F.current_timestamp()))), "idempotency_key": fill("idempotency_key", F.uuid())})


def results(validated: DataFrame, *keys: str) -> DataFrame:
    """Status of each event. A duplicate is accepted too, although it is not written."""
    return validated.select(*keys, "id", F.when(F.col("error").isNull(), "accepted").otherwise("rejected").alias("status"), "error")


def batch_counts(result: DataFrame, *keys: str) -> DataFrame:
    return result.groupBy(*keys).agg(F.count_if(F.col("status") == "accepted").alias("accepted_count"), F.count_if(F.col("status") == "rejected").alias("rejected_count"))


def dead_letters(poison: DataFrame, subject: str, stream: str, consumer: str, deliveries: int = 1) -> DataFrame:
    """Poison records with where they came from, for an append-only table.

    Records of a redelivery ledger bring their own place in the stream, time of arrival, number of tries and last error;
    others have none of the first two, count as delivered so often, and are unparsable.
    """
    own = lambda name, other: F.col(name) if name in poison.columns else other
    sequence = F.concat_ws("-", "batch", "place") if "place" in poison.columns else F.lit(None).cast("string")
    return poison.select(
        F.lit(f"dlq.{subject}").alias("subject"), F.lit(subject).alias("original_subject"), F.lit(stream).alias("stream"),
        F.lit(consumer).alias("consumer"), sequence.alias("sequence"), own("arrived_ms", F.lit(None).cast("long")).alias("arrived_ms"),
        own("tries", F.lit(deliveries)).alias("deliveries"), own("error", F.lit("unparsable")).alias("error"), "record",
    )


def depth(dlq: DataFrame, alert_at: int) -> DataFrame:
    return dlq.agg(F.count("*").alias("depth")).withColumn("alert", F.col("depth") >= alert_at)


def device_context(raw: Column) -> Column:
    """A client's device context (JSON fields as strings) with platform and network as enumeration names."""
    fields = []
    for f in ENVELOPE["device_context"].dataType.fields:
        own = raw[f.name]
        if f.name == "platform":
            own = named(own, PLATFORMS, "PLATFORM_UNSPECIFIED")
        elif f.name == "network_type":
            own = named(own, NETWORKS, "NETWORK_TYPE_UNSPECIFIED")
        fields.append(own.cast(f.dataType).alias(f.name))
    return F.struct(*fields)


def _typed_maps(properties: Column) -> Column:
    """A custom event's properties split by JSON type: text and nested values, whole numbers, fractions, booleans."""
    raw = F.from_json(properties, "map<string,variant>")
    rest = F.map_filter(raw, lambda k, v: ~((k == "event_name") & (F.schema_of_variant(v) == "STRING")))
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    num = lambda v: F.try_variant_get(v, "$", "double")
    is_num = lambda v: kind(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)")
    whole = lambda v: is_num(v) & (num(v) == F.floor(num(v)))
    plain = lambda v: ~is_num(v) & (kind(v) != "BOOLEAN")
    text = lambda v: F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string")).when(kind(v) == "VOID", "null").otherwise(F.to_json(v))
    return F.struct(
        F.coalesce(F.try_variant_get(F.element_at(raw, "event_name"), "$", "string"), F.lit("")).alias("event_name"),
        F.transform_values(F.map_filter(rest, lambda k, v: plain(v)), lambda k, v: text(v)).alias("string_params"),
        F.transform_values(F.map_filter(rest, lambda k, v: whole(v)), lambda k, v: num(v).cast("bigint")).alias("int_params"),
        F.transform_values(F.map_filter(rest, lambda k, v: is_num(v) & ~whole(v)), lambda k, v: num(v)).alias("float_params"),
        F.transform_values(F.map_filter(rest, lambda k, v: kind(v) == "BOOLEAN"), lambda k, v: F.try_variant_get(v, "$", "boolean")).alias("bool_params"),
    )


def from_client(events: DataFrame, text: str = "value") -> DataFrame:
    """Client events, JSON text {type, properties, metadata}, as envelopes; session_id and user_id are kept as extra columns.

    A type that the format does not know becomes a custom event of that name, its properties kept as they came.
    """
    outer = "type string, properties string, metadata struct<session_id:string,device_id:string,user_id:string,timestamp:string,idempotency_key:string,app_id:string>"
    e = F.from_json(F.col(text), outer)
    rows = events.withColumn("_e", e)
    kind, props = F.col("_e.type"), F.col("_e.properties")
    columns = [
        F.lit("").alias("id"), F.col("_e.metadata.app_id").alias("app_id"), F.col("_e.metadata.device_id").alias("device_id"),
        millis_of(F.col("_e.metadata.timestamp")).alias("timestamp_ms"), F.lit("").alias("correlation_id"),
        F.col("_e.metadata.idempotency_key").alias("idempotency_key"),
        (device_context(F.col("device_context")) if "device_context" in events.columns else F.lit(None).cast(ENVELOPE["device_context"].dataType)).alias("device_context"),
    ]
    for name in PAYLOADS:
        schema = ENVELOPE[name].dataType
        if name == "custom_event":
            unknown = F.struct(kind.alias("event_name"), F.create_map(F.lit("_raw_properties"), props).alias("string_params"), *[F.lit(None).cast(schema[f].dataType).alias(f) for f in ("int_params", "float_params", "bool_params")])
            bare = F.struct(kind.alias("event_name"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields[1:]])
            own = F.when(kind == "custom", _typed_maps(props)).when(kind.isin(*CLIENT_TYPES), F.lit(None)).when(props.isNull(), bare).when(kind.isNotNull(), unknown)
        elif name in CLIENT_TYPES:
            own = F.when(kind == name, F.from_json(F.coalesce(props, F.lit("{}")), schema))
        else:
            own = F.lit(None)
        columns.append(own.cast(schema).alias(name))
    return rows.select(*columns, F.col("_e.metadata.session_id").alias("session_id"), F.col("_e.metadata.user_id").alias("user_id"))


def known_client_type(kind: Column) -> Column:
    return kind.isin(*CLIENT_TYPES)


