"""Classification of events and their flat warehouse row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamloom.functions.scalars import event_time
from streamloom.sources.schemas import ENVELOPE, EVENT_ROW, PAYLOADS


def payload_name() -> Column:
    """Name of the payload that is set, null if none is."""
    return F.coalesce(*[F.when(F.col(name).isNotNull(), F.lit(name)) for name in PAYLOADS])


def category_and_type() -> tuple[Column, Column]:
    """(category, type); a custom event is of its own name's type; without a payload both are 'unknown'."""
    category = F.coalesce(*[F.when(F.col(name).isNotNull(), F.lit(c)) for name, (c, _, _) in PAYLOADS.items()], F.lit("unknown"))
    kinds = [F.when(F.col(name).isNotNull(), F.lit(t) if t else F.coalesce(F.nullif(F.col("custom_event.event_name"), F.lit("")), F.lit("unknown"))) for name, (_, t, _) in PAYLOADS.items()]
    return category, F.coalesce(*kinds, F.lit("unknown"))


def _without_zeros(value: Column, kind: T.DataType) -> Column:
    """value with zero, empty and false parts as null at every level of structs, so that to_json leaves them out."""
    if isinstance(kind, T.StructType):
        parts = [_without_zeros(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(kind, T.ArrayType):
        inner = F.transform(value, lambda x: _without_zeros(x, kind.elementType)) if isinstance(kind.elementType, T.StructType) else value
        return F.when(F.size(value) > 0, inner)
    if isinstance(kind, T.MapType):
        return F.when(F.size(value) > 0, value)
    if isinstance(kind, T.StringType):
        return F.nullif(value, F.lit(""))
    if isinstance(kind, T.BooleanType):
        return F.when(value, value)
    return F.when(value != 0, value)


def payload_json() -> Column:
    """The set payload as JSON without zero, empty or false fields; {} without a payload."""
    each = [F.when(F.col(name).isNotNull(), F.to_json(_without_zeros(F.col(name), ENVELOPE[name].dataType))) for name in PAYLOADS]
    return F.coalesce(*each, F.lit("{}"))


def partition_columns(ts: Column) -> dict[str, Column]:
    return {"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts), "hour": F.hour(ts)}


def flatten(envelopes: DataFrame) -> DataFrame:
    """One warehouse row for each envelope. Enumerations of an absent device context are empty, of a present one unspecified."""
    category, kind = category_and_type()
    context = []
    for f in ENVELOPE["device_context"].dataType.fields:
        own, none = F.col(f"device_context.{f.name}"), F.lit("").cast(f.dataType) if isinstance(f.dataType, T.StringType) else F.lit(0).cast(f.dataType)
        if f.name in ("platform", "network_type"):
            none = F.when(F.col("device_context").isNotNull(), f"{f.name.upper()}_UNSPECIFIED").otherwise("")
            own = F.nullif(own, F.lit(""))
        context.append(F.coalesce(own, none).alias(f.name))
    ts = event_time(F.col("timestamp_ms"))
    return envelopes.select(
        "id", "app_id", "device_id", "timestamp_ms", "correlation_id", category.alias("event_category"), kind.alias("event_type"),
        *context, payload_json().alias("payload_json"), *[c.alias(n) for n, c in partition_columns(ts).items()],
    ).to(EVENT_ROW)


#: Device fields and payloads of the narrower document that anomaly detection reads; by default all are given.
STRICT_DEVICE = ("platform", "os_version", "app_version", "device_model", "manufacturer", "screen_width", "screen_height", "locale", "timezone", "network_type", "is_jailbroken", "is_emulator")
STRICT_PAYLOADS = ("purchase_complete", "add_to_cart", "product_view", "custom_event")


def document(device: tuple[str, ...] | None = None, payloads: tuple[str, ...] | None = None) -> Column:
    """The event as a JSON document: its own five fields, the device context and the set payload by its name."""
    context = [f.name for f in ENVELOPE["device_context"].dataType.fields if device is None or f.name in device]
    parts = [F.col(c) for c in ("id", "app_id", "device_id", "timestamp_ms", "correlation_id")]
    parts.append(F.when(F.col("device_context").isNotNull(), F.struct(*[F.col(f"device_context.{c}").alias(c) for c in context])).alias("device_context"))
    parts += [F.col(name) for name in PAYLOADS if payloads is None or name in payloads]
    return F.to_json(F.struct(*parts))


def with_document(envelopes: DataFrame, device: tuple[str, ...] | None = None, payloads: tuple[str, ...] | None = None) -> DataFrame:
    """Each envelope's category and type with its whole JSON document, as rules and thresholds read it."""
    category, kind = category_and_type()
    own = ("id", "app_id", "device_id", "timestamp_ms", "correlation_id")
    return envelopes.select(*own, category.alias("event_category"), kind.alias("event_type"), payload_json().alias("payload_json"), document(device, payloads).alias("document"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
