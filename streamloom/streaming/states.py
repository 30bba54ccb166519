"""Streams with state by key: cooldowns, windowed deduplication, rate limits and sessions, in the order of event time.

Rows of a key wait until the watermark has passed them and are then taken in order, so that results do not depend on how
rows are dealt to batches: they equal those of the batch operators as far as the watermark has come. What a key keeps
besides is a few numbers; timers of event time tell when rows are due, a session is over or a key can be forgotten. Rows
later than the watermark are dropped by Spark.

State lies in RocksDB, of which each task holds the keys of its partition on disk. A task reads the waiting rows of one
key at a time: as many as come in a watermark's delay.

Each call of a key's state is a round trip between Python and the JVM, and a key takes some fifteen of them, which is
too much where keys are as many as events. So keys are dealt to BUCKETS buckets by a hash of theirs; a bucket waits, wakes
and is stored as a whole, in a few calls, and its keys are followed in memory by the same rules. A batch reads and writes
all that its buckets hold, so that its time grows with the state; a task holds one bucket at a time.

Defined cases: equal times are taken by id, null ids first; a null key is a key; repeated rows are rows of their own;
rows without a time are dropped.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from streamloom.functions.scalars import event_time

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TIME, TIE = "timestamp_ms", "id"
#: Buckets of keys, and the rows or keys of one stored value.
BUCKETS, CHUNK = 512, 5000
_BYTES = T.StructType([T.StructField("v", T.BinaryType())])
_LONG = T.StructType([T.StructField("v", T.LongType())])
#: A number and the time until which it holds.
_UNTIL = T.StructType([T.StructField("v", T.LongType()), T.StructField("until", T.LongType())])


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that these operators need; it holds for queries that start later."""
    spark.conf.set(PROVIDER, ROCKSDB)


class InOrder(StatefulProcessor):
    """Hands a key's rows on in order once the watermark has passed them. Subclasses say what becomes of them."""

    #: Name of the subclass's own state, in the store and as an attribute.
    own: str

    def __init__(self, schema: T.StructType):
        self.schema = schema
        self.time, self.tie = schema.names.index(TIME), schema.names.index(TIE)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.next = handle.getValueState("next", _LONG)
        self.open()

    def open(self) -> None:
        """Get the subclass's own state."""

    def wanted(self, rows: Iterator[tuple]) -> Iterator[tuple]:
        """Rows less those that are known to be of no use."""
        return rows

    def due(self, key: tuple, rows: list[tuple], watermark: int) -> Iterator[Row]:
        """What follows from rows, all of the key up to the watermark that have not been seen before; also called when a timer has expired without any."""
        raise NotImplementedError

    def wake(self, at: int) -> None:
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first, known = None, self.next.get()  # none where nothing waits: each call is a round trip, so exists() is left out
        own = self.wanted(map(tuple, rows))
        while some := list(islice(own, 1000)):
            self.waiting.appendList(some)
            least = min(r[self.time] for r in some)
            first = least if first is None else min(first, least)
        if first is not None and (known is None or first < known[0]):
            if known is not None:
                self.handle.deleteTimer(known[0])
            self.next.update((first,))
            self.wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        ready: list[tuple] = []
        known = self.next.get()
        if known is not None and known[0] <= watermark:
            later: list[tuple] = []
            for r in map(tuple, self.waiting.get()):
                (ready if r[self.time] <= watermark else later).append(r)
            if later:
                self.waiting.put(later[:1000])
                for at in range(1000, len(later), 1000):
                    self.waiting.appendList(later[at : at + 1000])
                first = min(r[self.time] for r in later)
                self.next.update((first,))
                self.wake(first)
            else:
                self.waiting.clear()
                self.next.clear()
            self.order(ready)
        yield from self.due(key, ready, watermark)

    def order(self, rows: list[tuple]) -> None:
        rows.sort(key=lambda r: (r[self.time], r[self.tie] is not None, r[self.tie]))


class Held:
    """The state of the key that is looked at, in memory: what a bucket's keys have in the place of a state of the store."""

    def __init__(self):
        self.of: dict[tuple, tuple] = {}
        self.key: tuple = ()

    def get(self) -> tuple | None:
        return self.of.get(self.key)

    def exists(self) -> bool:
        return self.key in self.of

    def update(self, value: tuple) -> None:
        self.of[self.key] = value

    def clear(self) -> None:
        self.of.pop(self.key, None)


def _chunks(items: list) -> list[tuple[bytes]]:
    return [(pickle.dumps(items[at : at + CHUNK], 5),) for at in range(0, len(items), CHUNK)]


def _unpacked(state) -> Iterator:
    return (x for v in state.get() for x in pickle.loads(v[0]))


class Bucket(StatefulProcessor):
    """An InOrder processor over all keys of a bucket, with one timer: the earliest time at which a row is due or a key wants to be woken."""

    def __init__(self, one: InOrder, keys: tuple[str, ...]):
        self.one, self.keys = one, [one.schema.names.index(k) for k in keys]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _BYTES)
        self.next = handle.getValueState("next", _LONG)
        self.stored = handle.getListState(self.one.own, _BYTES)

    def _set(self, state, items: list) -> None:
        if items:
            state.put(_chunks(items))
        else:
            state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first, at, known = None, self.one.time, self.next.get()
        own = map(tuple, rows)
        while some := list(islice(own, CHUNK)):
            self.waiting.appendList(_chunks(some))
            least = min(r[at] for r in some)
            first = least if first is None else min(first, least)
        if first is not None and (known is None or first < known[0]):
            if known is not None:
                self.handle.deleteTimer(known[0])
            self.next.update((first,))
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark, one = timerValues.getCurrentWatermarkInMs(), self.one
        ready: dict[tuple, list[tuple]] = {}
        later: list[tuple] = []
        for r in _unpacked(self.waiting):
            if r[one.time] > watermark:
                later.append(r)
            else:
                ready.setdefault(tuple(r[k] for k in self.keys), []).append(r)
        held, wakes, more = Held(), {}, Held()
        for k, value, wake in _unpacked(self.stored):
            held.of[k] = value
            if wake is not None:
                wakes[k] = wake
        more.of = {tuple(r[k] for k in self.keys): () for r in later}
        setattr(one, one.own, held)
        one.next, one.wake = more, lambda at: wakes.__setitem__(held.key, at)
        for k in [*ready, *(k for k, at in wakes.items() if at <= watermark and k not in ready)]:
            held.key = more.key = k
            rows = ready.pop(k, [])
            one.order(rows)
            if wakes.get(k, watermark + 1) <= watermark:
                del wakes[k]
            yield from one.due(k, rows, watermark)
            while wakes.get(k, watermark + 1) <= watermark:
                del wakes[k]
                yield from one.due(k, [], watermark)
        self._set(self.waiting, later)
        self._set(self.stored, [(k, value, wakes.get(k)) for k, value in held.of.items()])
        first = min([*(r[one.time] for r in later), *(at for k, at in wakes.items() if k in held.of)], default=None)
        if first is None:
            self.next.clear()
        else:
            self.next.update((first,))
            self.handle.registerTimer(first)


class Spaced(InOrder):
    """Keeps a row if it is its key's first or lies at least its gap after the last kept one; a key is forgotten a time to live after that."""

    own = "last"

    def __init__(self, schema: T.StructType, gap: str, ttl_ms: int):
        super().__init__(schema)
        self.gap, self.ttl_ms = schema.names.index(gap), ttl_ms

    def open(self) -> None:
        self.last = self.handle.getValueState("last", _UNTIL)

    def wanted(self, rows: Iterator[tuple]) -> Iterator[tuple]:
        last = (self.last.get() or (None,))[0]
        # what is taken from now on comes after the last kept row
        return rows if last is None else (r for r in rows if r[self.time] - last >= r[self.gap])

    def due(self, key: tuple, rows: list[tuple], watermark: int) -> Iterator[Row]:
        held = self.last.get()
        last, until = held or (None, None)
        for r in rows:
            if last is None or r[self.time] - last >= r[self.gap]:
                last, until = r[self.time], r[self.time] + max(self.ttl_ms, r[self.gap])
                yield Row(**dict(zip(self.schema.names, r)))
        # timers of items kept earlier run out too: only the last one's time counts
        if last is not None and until <= watermark:
            self.last.clear()
        elif rows and (held is None or last != held[0]):
            self.last.update((last, until))
            self.wake(until)


class Counted(InOrder):
    """Numbers the rows of a window and keeps those after the first most; the window is forgotten when it is over."""

    own = "count"

    def __init__(self, schema: T.StructType):
        super().__init__(schema)
        self.most, self.end = schema.names.index("most"), schema.names.index("window_end_ms")

    def open(self) -> None:
        self.count = self.handle.getValueState("count", _UNTIL)

    def due(self, key: tuple, rows: list[tuple], watermark: int) -> Iterator[Row]:
        n, end = self.count.get() or (0, None)
        for r in rows:
            n, end = n + 1, r[self.end]
            if n > r[self.most]:
                yield Row(**dict(zip(self.schema.names, r)), running=n)
        if end is not None and end <= watermark:
            self.count.clear()
        elif rows:
            self.count.update((n, end))
            self.wake(end)


_SESSION = T.StructType([T.StructField(c, T.LongType()) for c in ("no", "start", "last", "events", "away", "open")])
BOUNDARY = "device_id string, session_no long, event_type string, timestamp_ms long, events long, duration_ms long"


class Sessions(InOrder):
    """session_start and session_end of a device. A session ends after a gap over the timeout, or when the app comes back from a longer time in the background."""

    own = "session"

    def __init__(self, schema: T.StructType, timeout_ms: int, ttl_ms: int | None):
        super().__init__(schema)
        self.timeout_ms, self.ttl_ms, self.kind = timeout_ms, ttl_ms, schema.names.index("event_type")

    def open(self) -> None:
        self.session = self.handle.getValueState("session", _SESSION)

    def due(self, key: tuple, rows: list[tuple], watermark: int) -> Iterator[Row]:
        held = self.session.get()
        no, start, last, n, away, is_open = held or (0, 0, 0, 0, None, 0)
        device = key[0]

        def ended() -> Row:
            return Row(device_id=device, session_no=no, event_type="session_end", timestamp_ms=last, events=n, duration_ms=last - start)

        for r in rows:
            at, kind = r[self.time], r[self.kind]
            back = kind == "app_foreground" and away is not None and at - away > self.timeout_ms
            if not is_open or at - last > self.timeout_ms or back:
                if is_open:
                    yield ended()
                no, start, n, is_open = no + 1, at, 0, 1
                yield Row(device_id=device, session_no=no, event_type="session_start", timestamp_ms=at, events=None, duration_ms=None)
            last, n = at, n + 1
            if kind in ("app_background", "app_foreground"):
                away = at if kind == "app_background" else None
        if is_open and last + self.timeout_ms <= watermark:
            yield ended()
            is_open = 0
        if (no, start, last, n, away, is_open) != (tuple(held) if held else None) and no:
            self.session.update((no, start, last, n, away, is_open))
            self.wake(last + (self.timeout_ms if is_open else max(self.ttl_ms or 0, 1)))
        elif held and self.ttl_ms and not is_open and not rows and not self.next.exists() and last + self.ttl_ms <= watermark:
            self.session.clear()


def _run(rows: DataFrame, late: str, keys: tuple[str, ...], processor: InOrder, out: T.StructType | str, buckets: int | None = BUCKETS) -> DataFrame:
    """rows through a processor, by buckets of keys or each key by itself, with a watermark on their event time."""
    use_rocksdb(rows.sparkSession)
    timed = rows.where(F.col(TIME).isNotNull()).withColumn("_at", event_time(F.col(TIME))).withWatermark("_at", late)
    if buckets is None:
        return timed.groupBy(*keys).transformWithState(processor, out, "append", "eventTime")
    dealt = timed.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    return dealt.groupBy("_bucket").transformWithState(Bucket(processor, keys), out, "append", "eventTime")


def _with_time(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("_at", T.TimestampType())])


def spaced(rows: DataFrame, keys: tuple[str, ...], gap: str, late: str = "10 minutes", ttl_ms: int = 0, buckets: int | None = None) -> DataFrame:
    """rows (id, timestamp_ms, gap, ...) that lie at least the milliseconds in gap after the last kept one of their keys. A key is forgotten when neither its gap nor a time to live covers it any more. buckets: None keeps the state of each key by itself, for few keys of which a batch touches a small part."""
    schema = _with_time(rows.schema)
    return _run(rows, late, keys, Spaced(schema, gap, ttl_ms), schema, buckets).drop("_at")


def cooled(candidates: DataFrame, late: str = "10 minutes", ttl_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """Alert candidates (config_id, app_id, id, timestamp_ms, cooldown_ms, ...) that pass the cooldown."""
    return spaced(candidates, ("config_id", "app_id"), "cooldown_ms", late, ttl_ms, BUCKETS)


def first_within(events: DataFrame, window_ms: int, late: str = "10 minutes") -> DataFrame:
    """The earliest event of each idempotency key, and those a window or more after the last kept one. Events without a key pass at once."""
    none = F.coalesce(F.col("idempotency_key"), F.lit("")) == ""
    kept = spaced(events.where(~none).withColumn("_gap", F.lit(window_ms).cast("long")), ("idempotency_key",), "_gap", late, buckets=BUCKETS).drop("_gap")
    return kept.unionByName(events.where(none))


def rate_alerts(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events (config_id, app_id, id, timestamp_ms, window_start in seconds, window_seconds, most, ...) over their window's limit, with running."""
    given = events.withColumn("window_end_ms", ((F.col("window_start") + F.col("window_seconds")) * 1000).cast("long"))
    schema = _with_time(given.schema)
    out = T.StructType([*schema.fields, T.StructField("running", T.LongType())])
    return _run(given, late, ("config_id", "app_id", "window_start"), Counted(schema), out).drop("_at", "window_end_ms")


def session_boundaries(events: DataFrame, timeout_ms: int = 30_000, late: str = "10 minutes", ttl_ms: int | None = None) -> DataFrame:
    """(device_id, session_no, event_type, timestamp_ms, events, duration_ms): a session_start and a session_end of each session. A device that is forgotten after ttl_ms counts from 1 again."""
    rows = events.select("device_id", "id", TIME, "event_type")
    return _run(rows, late, ("device_id",), Sessions(_with_time(rows.schema), timeout_ms, ttl_ms), BOUNDARY)
