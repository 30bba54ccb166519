"""Rules as data, compiled to Spark columns.

A rule filters by app, category and type (null: any) and holds conditions, all of which must be true, on paths of the
event's JSON document. Rules are few, so each becomes one column of a projection: matching needs no join and no shuffle.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamloom.functions.scalars import NUMBER, number, topic
from streamloom.operators.classify import any_of
from streamloom.sources.schemas import RULE

OPERATORS = ("exists", "not_exists", "eq", "ne", "gt", "gte", "lt", "lte", "contains", "regex", "in")
#: Rules that are compiled to columns of every event; more are joined to the events that pass their filters.
MOST_COMPILED = 64
#: Filters that are broadcast, and the parts in which each of more stands.
MOST_BROADCAST, SPREAD = 10_000, 64
#: Dialects differ on these, so they are refused: look-around and back-references, where the backslash is not escaped itself.
_REFUSED = re.compile(r"(?<!\\)(?:\\\\)*(?:\(\?<?[=!]|\\[1-9k])")
_NAMED_GROUP = re.compile(r"(?<!\\)((?:\\\\)*)\(\?P?<[A-Za-z_]\w*>")


def json_path(path: str) -> str:
    """Dots separate map keys; an optional '$.' leads. Each key is quoted, so that it only ever means a key of a map."""
    keys = path.removeprefix("$.").split(".") if path else []
    return "$" + "".join('["' + k.replace("\\", "\\\\").replace('"', '\\"') + '"]' for k in keys)


def unnamed(pattern: str) -> str:
    """The pattern with its named groups as plain ones: nothing reads their names, and dialects differ on them."""
    return _NAMED_GROUP.sub(r"\1(", pattern)


def usable_pattern(spark: SparkSession, pattern: str) -> bool:
    """Whether the executors' regular expressions take the pattern; a bad one matches nothing instead of failing the job."""
    if _REFUSED.search(pattern):
        return False
    try:
        spark.range(1).select(F.lit("").rlike(unnamed(pattern))).collect()
    except Exception as e:  # the parser's error, in whatever class this Spark has it
        if "PATTERN" in str(e).upper() or "REGEX" in str(e).upper():
            return False
        raise
    return True


def literal_text(value: object) -> str | None:
    """A condition's value as it prints."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    return value if isinstance(value, str) else json.dumps(value, separators=(",", ":"))


def literal_number(value: object) -> float | None:
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float)):
        return float(value)
    return float(value) if isinstance(value, str) and re.match(NUMBER, value) else None


class Value:
    """A path of the document as columns: whether it exists, is null, its text and its number."""

    def __init__(self, document: Column, path: str):
        raw = F.try_variant_get(document, json_path(path), "variant")
        self.exists = raw.isNotNull()
        self.null = F.coalesce(F.is_variant_null(raw), F.lit(False))
        self.text = F.coalesce(F.try_variant_get(document, json_path(path), "string"), F.when(self.exists & ~self.null, F.to_json(raw)))
        self.number = F.when(F.schema_of_variant(raw) != "BOOLEAN", number(self.text))


def equals(value: Value, x: object) -> Column:
    """Both null; or equal as numbers if both are, else as text."""
    if x is None:
        return value.null
    as_text, as_number = value.text == F.lit(literal_text(x)), literal_number(x)
    same = as_text if as_number is None else F.coalesce(value.number == F.lit(as_number), as_text)
    return ~value.null & F.coalesce(same, F.lit(False))


def condition(document: Column, path: str, operator: str, value: object, spark: SparkSession) -> Column:
    """One condition as a column that is never null. value is the JSON value to compare with."""
    v, false = Value(document, path), F.lit(False)
    if operator == "exists":
        return v.exists
    if operator == "not_exists":
        return ~v.exists
    if operator == "eq":
        out = equals(v, value)
    elif operator == "ne":
        out = ~equals(v, value)
    elif operator in ("gt", "gte", "lt", "lte"):
        n = literal_number(value)
        if n is None:
            return false
        out = {"gt": v.number > n, "gte": v.number >= n, "lt": v.number < n, "lte": v.number <= n}[operator]
    elif operator == "contains":
        out = F.contains(v.text, F.lit(literal_text(value) or ""))
    elif operator == "regex":
        pattern = literal_text(value) or ""
        out = v.text.rlike(unnamed(pattern)) if usable_pattern(spark, pattern) else false
    elif operator == "in":
        out = any_of([equals(v, x) for x in value]) if isinstance(value, list) else false
    else:
        out = false
    return v.exists & F.coalesce(out, false)


def conditions(document: Column, wanted: list, spark: SparkSession) -> Column:
    return reduce(and_, [condition(document, c["path"], c["operator"], json.loads(c["value"]) if c["value"] is not None else None, spark) for c in wanted or []], F.lit(True))


def applies(rule: dict) -> Column:
    """The rule's filter: null is any."""
    parts = [F.col(c) == rule[c] for c in ("app_id", "event_category", "event_type") if rule[c] is not None]
    return reduce(and_, parts, F.lit(True))


class Compiled:
    """The enabled rules of a table, read once, as columns by priority (highest first), then name.

    Up to MOST_COMPILED rules are all columns of every event. Of more, an event only sees those whose filter it passes:
    they are joined to it by wildcard_join, and each distinct condition is one column of the joined rows; so the plan grows
    with the distinct conditions, not with the rules. A rule with a pattern that executors do not take matches nothing;
    refused names these patterns.
    """

    def __init__(self, rules: DataFrame, document: str = "payload_json", most: int | None = None):
        self.spark, self.document = rules.sparkSession, document
        self.many = rules.where("enabled").count() > (MOST_COMPILED if most is None else most)
        self.table = rules.where("enabled")
        self.shapes = shapes_of(self.table) if self.many else []
        self.few = few(self.table)
        patterns = self.table.select(F.explode("conditions").alias("c")).where("c.operator = 'regex'").select(F.col("c.value").alias("v")).distinct()
        self.refused = sorted(p for p in (literal_text(json.loads(r["v"])) or "" for r in patterns.where("v is not null").collect()) if not usable_pattern(self.spark, p))
        self.own = [] if self.many else sorted((r.asDict(recursive=True) for r in self.table.collect()), key=lambda r: (-(r["priority"] or 0), r["name"] or "", r["id"]))

    def hits(self, events: DataFrame) -> DataFrame:
        """A row for each event and rule that matches it, with hit_order from 0 in the event. events may be a stream while the rules are few."""
        parsed = events.withColumn("_doc", F.try_parse_json(F.col(self.document)))
        return self._joined(events, parsed) if self.many else self._projected(events, parsed)

    def _projected(self, events: DataFrame, parsed: DataFrame) -> DataFrame:
        # the filter stands outside the conditions, so that documents are only looked into where it holds
        made = [
            F.when(
                F.coalesce(applies(r), F.lit(False)),
                F.when(
                    conditions(F.col("_doc"), r["conditions"], self.spark),
                    F.struct(
                        F.lit(r["id"]).alias("rule_id"), F.lit(r["name"]).alias("rule_name"), F.lit(r["priority"] or 0).alias("priority"),
                        F.array(*[F.lit(w) for w in r["webhooks"] or []]).cast("array<string>").alias("webhooks"),
                        F.array(*[F.lit(s) for s in r["publish_subjects"] or []]).cast("array<string>").alias("publish_subjects"),
                    ),
                ),
            )
            for r in self.own
        ]
        if not made:
            none = "struct<rule_id:string,rule_name:string,priority:int,webhooks:array<string>,publish_subjects:array<string>>"
            made = [F.lit(None).cast(none)]
        found = parsed.withColumn("_hits", F.array_compact(F.array(*made))).drop("_doc")
        # of a plain posexplode Spark infers a filter on the hits and pushes it to the source, where it makes the document anew for each condition
        each = found.select(*events.columns, F.posexplode_outer("_hits").alias("hit_order", "_hit")).where("hit_order is not null")
        return each.select(*events.columns, "hit_order", "_hit.*")

    def _joined(self, events: DataFrame, parsed: DataFrame) -> DataFrame:
        distinct = [r["c"] for r in self.table.select(F.explode("conditions").alias("c")).distinct().collect()]
        truths = [F.when(condition(F.col("_doc"), c["path"], c["operator"], json.loads(c["value"]) if c["value"] is not None else None, self.spark), F.lit(i)) for i, c in enumerate(distinct)]
        numbers = self.spark.createDataFrame([(c, i) for i, c in enumerate(distinct)], T.StructType([T.StructField("c", RULE["conditions"].dataType.elementType), T.StructField("i", T.IntegerType())]))
        each = self.table.select("id", F.explode("conditions").alias("c")).select("id", F.to_json("c").alias("_t")).join(numbers.select(F.to_json("c").alias("_t"), "i"), "_t")
        needs = each.groupBy("id").agg(F.collect_set("i").alias("_needs"))
        keyed = self.table.join(needs, "id", "left").select(
            filter_key(wildcards=True).alias("_key"), F.col("id").alias("rule_id"), F.col("name").alias("rule_name"), F.coalesce("priority", F.lit(0)).alias("priority"),
            *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("webhooks", "publish_subjects")], F.coalesce("_needs", F.array().cast("array<int>")).alias("_needs"),
        )
        true = F.array_compact(F.array(*truths)) if truths else F.array().cast("array<int>")
        numbered = parsed.select(F.monotonically_increasing_id().alias("_row"), F.struct(*events.columns).alias("_e"), true.alias("_true"), event_keys(self.shapes).alias("_keys"))
        found = key_join(numbered.select("_row", "_e", "_true", F.explode("_keys").alias("_key")), keyed, self.few)
        found = found.where(F.size(F.array_except("_needs", "_true")) == 0)
        hit = F.struct((-F.col("priority")).alias("_p"), F.coalesce("rule_name", F.lit("")).alias("_n"), "rule_id", "rule_name", "priority", "webhooks", "publish_subjects")
        listed = found.groupBy("_row").agg(F.first("_e").alias("_e"), F.array_sort(F.collect_list(hit)).alias("_hits"))
        ordered = listed.select("_e.*", F.posexplode("_hits").alias("hit_order", "_hit"))
        return ordered.select(*events.columns, "hit_order", *[F.col(f"_hit.{c}") for c in ("rule_id", "rule_name", "priority", "webhooks", "publish_subjects")])


def hits(events: DataFrame, rules: DataFrame, document: str = "payload_json") -> DataFrame:
    """A row for each event and enabled rule that matches it, by rule priority (highest first), then name."""
    return Compiled(rules, document).hits(events)


FILTERED = ("app_id", "event_category", "event_type")


def filter_key(wildcards: bool = False, given: tuple[bool, ...] = (True, True, True)) -> Column:
    """The three filtered columns as one key; those that are null (with wildcards) or not given are any."""
    parts = [F.concat(F.lit("="), F.col(c)) if use else F.lit("*") for c, use in zip(FILTERED, given)]
    return F.concat_ws("\u0001", *[F.coalesce(p, F.lit("*")) if wildcards else F.coalesce(p, F.lit("")) for p in parts])


def shapes_of(filters: DataFrame) -> list[tuple[bool, ...]]:
    """Which of the three columns the filters of a table give: eight shapes at most."""
    return sorted(tuple(r) for r in filters.select(*[F.col(c).isNotNull().alias(c) for c in FILTERED]).distinct().collect())


def event_keys(shapes: list[tuple[bool, ...]]) -> Column:
    """The keys of an event that filters of these shapes may have."""
    return F.array(*[filter_key(given=x) for x in shapes]).cast("array<string>")


def few(filters: DataFrame) -> bool:
    """Whether a table of filters is small enough to be broadcast."""
    return filters.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST


def key_join(keyed: DataFrame, filters: DataFrame, broadcast: bool) -> DataFrame:
    """Events that are dealt by _key joined to the filters of that key.

    Spark does not know the size of a table made of rows of the driver and would shuffle the events by their key, and a
    filter that is all wildcards has one key: all events in one task. So few filters are
    broadcast; of more, each stands in SPREAD parts and each event in one of them.
    """
    if broadcast:
        return keyed.join(F.broadcast(filters), "_key").drop("_key")
    spread = filters.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    part = F.pmod(F.xxhash64(*[c for c in ("id", "timestamp_ms", "_row") if c in keyed.columns]), F.lit(SPREAD)).cast("int")
    return keyed.withColumn("_part", part).join(spread, ["_key", "_part"]).drop("_key", "_part")


def wildcard_join(events: DataFrame, rules: DataFrame) -> DataFrame:
    """(event id, rule id) by the filters alone, for rules that are too many to compile.

    Each event has a key for each choice of wildcards that occurs, eight at most, so this is an equality join, not a
    nested loop.
    """
    live = rules.where("enabled")
    keyed = live.select(F.col("id").alias("rule_id"), filter_key(wildcards=True).alias("_key"))
    return key_join(events.select("id", F.explode(event_keys(shapes_of(live))).alias("_key")), keyed, few(live)).select("id", "rule_id")


def payload(found: DataFrame, triggered_at: Column) -> DataFrame:
    """hits with the JSON payload that is delivered and published."""
    fields = [F.col(c) for c in ("rule_id", "rule_name")] + [F.col("id").alias("event_id")] + [F.col(c) for c in ("app_id", "device_id", "timestamp_ms", "correlation_id")]
    event = F.try_parse_json("payload_json").alias("event")
    return found.withColumn("payload", F.to_json(F.struct(*fields, event, F.date_format(triggered_at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("triggered_at"))))


def deliveries(found: DataFrame, now: Column, max_attempts: int = 5) -> DataFrame:
    """One pending delivery for each webhook of each hit; a hit without webhooks has none."""
    return found.select(
        F.col("id").alias("event_id"), "rule_id", F.explode("webhooks").alias("webhook_id"),
        *([F.col("payload")] if "payload" in found.columns else []),
    ).withColumns({"status": F.lit("pending"), "attempts": F.lit(0), "max_attempts": F.lit(max_attempts), "next_attempt_at": now})


def publications(found: DataFrame) -> DataFrame:
    """(topic, value) for each subject of each hit, the app filled in."""
    return found.select("app_id", F.explode("publish_subjects").alias("_t"), F.col("payload").alias("value")).select(topic(F.col("_t"), F.col("app_id")).alias("topic"), "value")
