"""State machines over streams: an answer cache kept by last use and time, and a circuit breaker.

Rows of a key wait in its state until the watermark has passed them and are then played in order of time, so a stream whose
rows come late or in any order (within the watermark's delay) gives what a loop over the sorted rows gives. A timer of the
event time wakes a key when its next row or deadline is due.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_WAITING = StructType([StructField("ts", LongType()), StructField("seq", LongType()), StructField("what", StringType())])


class InOrder(StatefulProcessor):
    """Plays the rows (ts in microseconds, seq, what) of a key in order once they are due. A subclass says how."""

    #: Columns that play() gives, after the key.
    columns: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.timer = handle.getValueState("timer", StructType([StructField("at", LongType())]))
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        """Make the subclass's own state."""

    def play(self, rows: list[tuple[int, int, str]], now: int) -> list[tuple]:
        """What the rows give, in order, and all that is due by now (microseconds)."""
        raise NotImplementedError

    def deadline(self) -> int | None:
        """When something is due without a row."""
        return None

    def _wake(self, waiting: list[tuple[int, int, str]]) -> None:
        due = [r[0] for r in waiting] + [d for d in (self.deadline(),) if d is not None]
        at = -(-min(due) // 1000) if due else None
        old = self.timer.get()[0] if self.timer.exists() else None
        if old != at:
            if old is not None and old in list(self._timers()):
                self.handle.deleteTimer(old)
            if at is None:
                self.timer.clear()
            else:
                self.handle.registerTimer(at)
                self.timer.update((at,))

    def _timers(self) -> Iterator[int]:
        for t in self.handle.listTimers():
            yield t if isinstance(t, int) else t[0]

    def _held(self) -> list[tuple[int, int, str]]:
        return [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        new = [(int(t), int(s), w) for df in rows for t, s, w in zip(df["ts"], df["seq"], df["what"], strict=True)]
        self.waiting.appendList(new)
        self._wake(self._held())
        yield pd.DataFrame(columns=["key", *self.columns])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000 + 999
        held = self._held()
        due, rest = sorted(r for r in held if r[0] <= now), [r for r in held if r[0] > now]
        if rest:
            self.waiting.put(rest)
        elif held:
            self.waiting.clear()
        self.timer.clear()
        out = self.play(due, now)
        self._wake(rest)
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["key", *self.columns])

    def close(self) -> None:
        pass


class Lru:
    """The cache of one namespace: entries by last use with the time when they expire."""

    def __init__(self, ttl: int, capacity: int, entries: OrderedDict[str, int] | None = None):
        self.ttl, self.capacity, self.entries = ttl, capacity, entries if entries is not None else OrderedDict()

    def expire(self, now: int) -> list[tuple]:
        gone = sorted((at, k) for k, at in self.entries.items() if at < now)
        for _, k in gone:
            del self.entries[k]
        return [(at, k, "expired") for at, k in gone]

    def ask(self, now: int, key: str) -> list[tuple]:
        """A hit, or a miss after which the answer is stored; the entry used longest ago makes room."""
        out = self.expire(now)
        if key in self.entries:
            self.entries.move_to_end(key)
            return [*out, (now, key, "hit")]
        if len(self.entries) >= self.capacity:
            old, _ = self.entries.popitem(last=False)
            out.append((now, old, "evicted"))
        self.entries[key] = now + self.ttl
        return [*out, (now, key, "miss")]


class _Cache(InOrder):
    columns = ("ts", "what", "outcome")

    def __init__(self, ttl: int, capacity: int):
        self.ttl, self.capacity = ttl, capacity

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", StructType([StructField("key", StringType())]), StructType([StructField("expires", LongType()), StructField("used", LongType())]))

    def _read(self) -> list[tuple[int, str, int]]:
        """Entries by last use."""
        return sorted((used, k[0], expires) for k, (expires, used) in self.entries.iterator()) if self.entries.exists() else []

    def play(self, rows: list[tuple[int, int, str]], now: int) -> list[tuple]:
        before = self._read()
        cache = Lru(self.ttl, self.capacity, OrderedDict((k, expires) for _, k, expires in before))
        out = [x for ts, _, key in rows for x in cache.ask(ts, key)] + cache.expire(now)
        used = {k: u for u, k, _ in before}
        for k in used.keys() - cache.entries.keys():
            self.entries.removeKey((k,))
        for place, (k, expires) in enumerate(cache.entries.items()):
            if used.get(k) != place:
                self.entries.updateValue((k,), (expires, place))
        return out

    def deadline(self) -> int | None:
        return min((expires + 1 for _, _, expires in self._read()), default=None)


class Breaker:
    """Closed until `threshold` calls fail one after another, then open for `cool` microseconds, then half-open: the next call
    goes through and counts from nothing."""

    def __init__(self, threshold: int, cool: int, failures: int = 0, until: int = 0, half: bool = False):
        self.threshold, self.cool, self.failures, self.until, self.half = threshold, cool, failures, until, half

    def wait(self, now: int) -> list[tuple]:
        if self.until and now >= self.until:
            at, self.until, self.failures, self.half = self.until, 0, 0, True
            return [(at, None, "half_open")]
        return []

    def call(self, now: int, seq: int, failed: bool) -> list[tuple]:
        out = self.wait(now)
        if self.until:
            return [*out, (now, seq, "rejected")]
        if failed:
            self.failures += 1
            out.append((now, seq, "failed"))
            self.half = False
            if self.failures >= self.threshold:
                self.until = now + self.cool
                out.append((now, None, "open"))
            return out
        out.append((now, seq, "passed"))
        if self.half:
            out.append((now, None, "closed"))
        self.failures, self.half = 0, False
        return out


class _Breaker(InOrder):
    columns = ("ts", "seq", "outcome")

    def __init__(self, threshold: int, cool: int):
        self.threshold, self.cool = threshold, cool

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("breaker", StructType([StructField(n, LongType()) for n in ("failures", "until", "half")]))

    def _read(self) -> Breaker:
        failures, until, half = self.state.get() if self.state.exists() else (0, 0, 0)
        return Breaker(self.threshold, self.cool, failures, until, bool(half))

    def play(self, rows: list[tuple[int, int, str]], now: int) -> list[tuple]:
        own = self._read()
        out = [x for ts, seq, what in rows for x in own.call(ts, seq, what == "failed")] + own.wait(now)
        self.state.update((own.failures, own.until, int(own.half)))
        # a call's number may be missing, so it goes out as text
        return [(ts, None if seq is None else str(seq), outcome) for ts, seq, outcome in out]

    def deadline(self) -> int | None:
        return self._read().until or None


def _run(rows: DataFrame, key: str, processor: InOrder, kinds: tuple[str, ...], delay: str) -> DataFrame:
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    schema = "key string, " + ", ".join(f"{c} {k}" for c, k in zip(processor.columns, kinds, strict=True))
    watched = rows.withColumn("at", F.col("ts")).withWatermark("at", delay)
    made = watched.select(F.col(key).cast("string").alias("key"), "at", F.unix_micros("ts").alias("ts"), F.col("seq").cast("long").alias("seq"), F.col("what").cast("string").alias("what"))
    out = made.groupBy("key").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return out.withColumn("ts", F.timestamp_micros("ts"))


def answer_cache(requests: DataFrame, ttl_seconds: int = 86_400, capacity: int = 1000, delay: str = "1 hour") -> DataFrame:
    """key (the namespace), ts, what (the question), outcome of a stream of requests (namespace, question, ts timestamp, seq).

    outcome: hit; miss, after which the answer is stored; evicted, the entry used longest ago, which makes room for a new one in
    a namespace of capacity entries; expired, ttl_seconds after an entry was stored, at that time and by a timer if nobody
    asks. A stored answer isn't prolonged by use. Requests of one time go by seq. Rows later than delay are dropped.
    """
    own = requests.select("namespace", "ts", "seq", F.lower(F.trim("question")).alias("what"))
    return _run(own, "namespace", _Cache(ttl_seconds * 1_000_000, capacity), ("long", "string", "string"), delay)


def circuit_breaker(calls: DataFrame, key: str, threshold: int = 5, cool_seconds: int = 30, delay: str = "1 hour") -> DataFrame:
    """key, ts, seq, outcome of a stream of calls (key, ts timestamp, seq, failed): passed, failed or rejected for each call; and,
    without seq, the changes of state: open, half_open (by a timer if no call comes) and closed, after a half-open circuit's
    first call if it passes. Rejected calls count for nothing."""
    own = calls.select(key, "ts", "seq", F.when(F.col("failed"), "failed").otherwise("passed").alias("what"))
    return _run(own, key, _Breaker(threshold, cool_seconds * 1_000_000), ("long", "string", "string"), delay)
