"""Schemas of events, warehouse rows, rules, anomaly configurations and deliveries."""

from __future__ import annotations

from pyspark.sql import types as T

# The event format. Payload name -> (category, event type, fields).
PAYLOADS: dict[str, tuple[str, str, str]] = {
    "user_login": ("user", "login", "user_id string, method string, is_new_user boolean"),
    "user_logout": ("user", "logout", "user_id string, reason string"),
    "user_signup": ("user", "signup", "user_id string, method string, referral_source string"),
    "user_profile_update": ("user", "profile_update", "user_id string, fields_updated array<string>"),
    "screen_view": ("screen", "view", "screen_name string, screen_class string, previous_screen string, params map<string,string>"),
    "screen_exit": ("screen", "exit", "screen_name string, duration_ms bigint, next_screen string"),
    "button_tap": ("interaction", "button_tap", "button_id string, button_text string, screen_name string, coordinates coordinates"),
    "swipe_gesture": ("interaction", "swipe", "direction int, screen_name string, start coordinates, end coordinates, duration_ms bigint"),
    "scroll_event": ("interaction", "scroll", "screen_name string, container_id string, scroll_depth_percent int, direction int"),
    "text_input": ("interaction", "text_input", "field_id string, field_type string, screen_name string, text_length int, input_duration_ms bigint"),
    "long_press": ("interaction", "long_press", "element_id string, screen_name string, coordinates coordinates, duration_ms bigint"),
    "double_tap": ("interaction", "double_tap", "element_id string, screen_name string, coordinates coordinates"),
    "product_view": ("commerce", "product_view", "product_id string, product_name string, category string, price_cents bigint, currency string, source string"),
    "add_to_cart": ("commerce", "add_to_cart", "product_id string, product_name string, quantity int, price_cents bigint, currency string, cart_id string"),
    "remove_from_cart": ("commerce", "remove_from_cart", "product_id string, quantity int, cart_id string, reason string"),
    "checkout_start": ("commerce", "checkout_start", "cart_id string, item_count int, total_cents bigint, currency string"),
    "checkout_step": ("commerce", "checkout_step", "cart_id string, step_number int, step_name string, step_duration_ms bigint"),
    "purchase_complete": (
        "commerce",
        "purchase_complete",
        "order_id string, cart_id string, item_count int, total_cents bigint, currency string, payment_method string, "
        "items array<item>",
    ),
    "purchase_failed": ("commerce", "purchase_failed", "cart_id string, error_code string, error_message string, payment_method string, checkout_step int"),
    "app_start": ("system", "app_start", "is_cold_start boolean, launch_duration_ms bigint, launch_source string, deeplink_url string"),
    "app_background": ("system", "app_background", "foreground_duration_ms bigint, current_screen string"),
    "app_foreground": ("system", "app_foreground", "background_duration_ms bigint, resume_screen string"),
    "app_crash": ("system", "app_crash", "crash_type string, crash_message string, stack_trace string, current_screen string"),
    "network_change": ("system", "network_change", "previous_type int, current_type int"),
    "permission_request": ("system", "permission_request", "permission_type string, trigger_screen string"),
    "permission_result": ("system", "permission_result", "permission_type string, status int"),
    "memory_warning": ("system", "memory_warning", "available_memory_bytes bigint, used_memory_bytes bigint, level int"),
    "battery_change": ("system", "battery_change", "battery_level int, state int"),
    "custom_event": ("custom", "", "event_name string, string_params map<string,string>, int_params map<string,bigint>, float_params map<string,double>, bool_params map<string,boolean>"),
}
#: Payload fields that must not be empty.
REQUIRED: dict[str, str] = {
    "screen_view": "screen_name",
    "screen_exit": "screen_name",
    "button_tap": "button_id",
    "text_input": "field_id",
    "product_view": "product_id",
    "add_to_cart": "product_id",
    "remove_from_cart": "product_id",
    "purchase_complete": "order_id",
    "custom_event": "event_name",
}
DEVICE_CONTEXT = (
    "platform string, os_version string, app_version string, build_number string, device_model string, manufacturer string, "
    "screen_width int, screen_height int, locale string, timezone string, network_type string, carrier string, "
    "is_jailbroken boolean, is_emulator boolean, sdk_version string"
)
PLATFORMS = {"ios": "PLATFORM_IOS", "android": "PLATFORM_ANDROID", "web": "PLATFORM_WEB"}
NETWORKS = {
    "wifi": "NETWORK_TYPE_WIFI",
    "cellular": "NETWORK_TYPE_CELLULAR_4G",
    "cellular_4g": "NETWORK_TYPE_CELLULAR_4G",
    "4g": "NETWORK_TYPE_CELLULAR_4G",
    "cellular_5g": "NETWORK_TYPE_CELLULAR_5G",
    "5g": "NETWORK_TYPE_CELLULAR_5G",
    "cellular_3g": "NETWORK_TYPE_CELLULAR_3G",
    "3g": "NETWORK_TYPE_CELLULAR_3G",
    "cellular_2g": "NETWORK_TYPE_CELLULAR_2G",
    "2g": "NETWORK_TYPE_CELLULAR_2G",
    "ethernet": "NETWORK_TYPE_ETHERNET",
    "offline": "NETWORK_TYPE_OFFLINE",
}
#: Event types that the client library accepts by name.
CLIENT_TYPES = (
    "screen_view", "screen_exit", "button_tap", "user_login", "user_logout", "user_signup", "product_view",
    "add_to_cart", "purchase_complete", "app_start", "app_background", "app_foreground", "custom",
)
# End of the fixed values.


_COORDINATES = T.StructType([T.StructField("x", T.FloatType()), T.StructField("y", T.FloatType())])
_ITEM = T.StructType([T.StructField("product_id", T.StringType()), T.StructField("product_name", T.StringType()), T.StructField("quantity", T.IntegerType()), T.StructField("price_cents", T.LongType())])
_CONDITION = T.StructType([T.StructField(c, T.StringType()) for c in ("path", "operator", "value")])
_TYPES = {
    "string": T.StringType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()), "array<item>": T.ArrayType(_ITEM), "array<condition>": T.ArrayType(_CONDITION), "coordinates": _COORDINATES,
    "map<string,string>": T.MapType(T.StringType(), T.StringType()), "map<string,bigint>": T.MapType(T.StringType(), T.LongType()),
    "map<string,double>": T.MapType(T.StringType(), T.DoubleType()), "map<string,boolean>": T.MapType(T.StringType(), T.BooleanType()),
}


def struct(fields: str) -> T.StructType:
    """'name type, name type' as a schema, without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split(" ") for f in fields.split(", "))])


ENVELOPE = T.StructType(
    [
        *struct("id string, app_id string, device_id string, timestamp_ms bigint, correlation_id string, idempotency_key string").fields,
        T.StructField("device_context", struct(DEVICE_CONTEXT)),
        *[T.StructField(name, struct(fields)) for name, (_, _, fields) in PAYLOADS.items()],
    ]
)
EVENT_ROW = struct(
    "id string, app_id string, device_id string, timestamp_ms bigint, correlation_id string, event_category string, event_type string, "
    f"{DEVICE_CONTEXT}, payload_json string, year int, month int, day int, hour int"
)
RULE = struct(
    "id string, name string, app_id string, event_category string, event_type string, "
    "conditions array<condition>, webhooks array<string>, publish_subjects array<string>, priority int, enabled boolean"
)
ANOMALY_CONFIG = struct(
    "id string, name string, app_id string, event_category string, event_type string, detection_type string, path string, min double, max double, "
    "max_per_minute int, window_seconds int, max_count int, cooldown_seconds int, enabled boolean"
)
ANOMALY_RECORD = struct(
    "anomaly_config_id string, app_id string, event_category string, event_type string, detection_type string, event_id string, "
    "timestamp_ms bigint, details string, topic string, value string"
)
DELIVERY = struct(
    "id string, webhook_id string, rule_id string, payload string, status string, attempts int, max_attempts int, "
    "next_attempt_at timestamp, last_attempt_at timestamp, delivered_at timestamp, last_error string, last_status_code int"
)
PARTITIONS = ("app_id", "year", "month", "day", "hour")
