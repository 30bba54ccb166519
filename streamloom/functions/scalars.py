"""Scalar expressions on event data. All are Spark columns; none runs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text that counts as a number in rules: no white space, suffix, NaN or hexadecimal, as try_cast alone would take or refuse.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
KEY = "^[0-9a-f]{64}$"


def sanitized(name: Column) -> Column:
    """Lower case, with blanks and dots as underscores."""
    return F.translate(F.lower(name), " .", "__")


def subject(app_id: Column, category: Column, event_type: Column) -> Column:
    """events.<app>.<category>.<type>; the app keeps its case, only a custom type is sanitized."""
    own = F.when(category == "custom", sanitized(event_type)).otherwise(event_type)
    return F.concat_ws(".", F.lit("events"), F.replace(app_id, F.lit("."), F.lit("_")), category, own)


def topic(template: Column, app_id: Column) -> Column:
    return F.replace(template, F.lit("{app_id}"), sanitized(app_id))


def anomaly_topic(app_id: Column, config_name: Column) -> Column:
    return F.concat_ws(".", F.lit("anomalies"), sanitized(app_id), sanitized(config_name))


def event_time(timestamp_ms: Column) -> Column:
    return F.timestamp_millis(timestamp_ms)


def millis_of(text: Column) -> Column:
    """Epoch milliseconds of an RFC 3339 text, 0 where it is none."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(text)), F.lit(0).cast("long"))


def minute_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm")


#: Seconds from 0001-01-01 to 1970-01-01.
YEAR_ONE = 62_135_596_800


def window_start(timestamp_ms: Column, seconds: Column | int) -> Column:
    """Epoch seconds of the window of that length which holds the time, windows counted from the year 1."""
    s = F.lit(seconds) if isinstance(seconds, int) else seconds
    at = F.floor(timestamp_ms / 1000)
    return (at - F.pmod(at + YEAR_ONE, s)).cast("long")


def backoff_ms(attempts: Column, first_ms: int = 1000, factor: float = 2.0, most_ms: int = 300_000) -> Column:
    """first * factor^attempts, at most most."""
    return F.least(F.lit(first_ms) * F.pow(F.lit(factor), attempts), F.lit(most_ms)).cast("long")


def jittered_ms(attempts: Column, share: float = 0.25, **backoff) -> Column:
    """Back-off spread by plus or minus a share of itself."""
    return (backoff_ms(attempts, **backoff) * (1 + share * (2 * F.rand() - 1))).cast("long")


def full_jitter_ms(attempts: Column, **backoff) -> Column:
    """A delay anywhere between zero and the back-off."""
    return (backoff_ms(attempts, **backoff) * F.rand()).cast("long")


def uuid7(ms: Column) -> Column:
    """Time-ordered UUID: 48 bits of milliseconds, version 7, the rest random. Materialise before use: it differs on each evaluation."""
    time, random = F.lower(F.lpad(F.hex(ms), 12, "0")), F.replace(F.uuid(), F.lit("-"), F.lit(""))
    return F.concat_ws("-", F.substring(time, 1, 8), F.substring(time, 9, 4), F.concat(F.lit("7"), F.substring(random, 14, 3)), F.substring(random, 17, 4), F.substring(random, 21, 12))


def key_hash(key: Column) -> Column:
    return F.sha2(key, 256)


def well_formed_key(key: Column) -> Column:
    return F.coalesce(key.rlike(KEY), F.lit(False))


def number(text: Column) -> Column:
    """The text as a double where it is a plain number, else null."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def named(value: Column, names: dict[str, str], other: str) -> Column:
    """Case-insensitive name -> enumeration name."""
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(value)), F.lit(other))


def matches_topic(value: Column, pattern: str) -> Column:
    """Topic patterns: '*' is one level, a final '>' one level or more."""
    levels = pattern.split(".")
    if levels == [">"]:
        return F.length(value) > 0
    if levels[-1] == ">" and "*" not in levels:
        head = ".".join(levels[:-1]) + "."
        return value.startswith(head) & (F.length(value) > len(head))
    parts = [r"[^.]+" if x == "*" else ".+" if x == ">" else "".join("\\" + c if not c.isalnum() and c != "_" else c for c in x) for x in levels]
    return value.rlike("^" + r"\.".join(parts) + "$")
