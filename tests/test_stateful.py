"""Stateful streams against loops over the sorted rows."""

import random

from pyspark.sql import functions as F

from docgrain.streaming.jobs import run_once
from docgrain.streaming.stateful import Breaker, Lru, answer_cache, circuit_breaker

BASE = 1_700_000_000


def land(spark, tmp_path, parts, schema):
    """Each part becomes a file of a landing folder, read as a micro-batch of its own."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        for f in (tmp_path / f"p{i}").glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{i:03}.parquet")
    kind = spark.read.parquet(str(tmp_path / "in")).schema
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def seen(spark, name):
    return sorted((r.key, int(round(r.ts.timestamp())) - BASE, str(r[2]), r.outcome) for r in spark.table(name).collect())


def shuffled(rows, parts, rng):
    """Parts in which rows come out of order, by less than 100 seconds."""
    late = sorted(rows, key=lambda r: r[1] + rng.randint(0, 90))
    n = -(-len(late) // parts)
    return [late[i : i + n] for i in range(0, len(late), n)]


def test_cache_equals_a_loop_on_conversations(spark, small, tmp_path):
    rng = random.Random(1)
    turns = spark.read.parquet(f"{small}/conversations.parquet").orderBy("conv_id", "turn").collect()
    rows = [(r.role, BASE + 7 * i, i, (r.text or "")[:1]) for i, r in enumerate(turns)]
    want, caches = [], {}
    for role, ts, _, text in rows:
        cache = caches.setdefault(role, Lru(400, 5))
        want += [(role, at - BASE, k, o) for at, k, o in cache.ask(ts, text.strip().lower())]
    end = rows[-1][1] + 10_000
    for role, cache in caches.items():
        want += [(role, at - BASE, k, o) for at, k, o in cache.expire(end)]
    last = [("other", end + 200, 10**6, "x"), ("other", end + 201, 10**6 + 1, "y")]
    stream = land(spark, tmp_path, [*shuffled(rows, 4, rng), last[:1], last[1:]], "namespace string, s long, seq long, question string").withColumn("ts", F.timestamp_seconds("s"))
    run_once(answer_cache(stream, 400, 5, "100 seconds"), "cache_loop", str(tmp_path / "cp"), "append").awaitTermination()
    got = [r for r in seen(spark, "cache_loop") if r[0] != "other"]
    assert got == sorted(want)
    assert {r[3] for r in got} == {"hit", "miss", "evicted", "expired"}


def test_breaker_equals_a_loop_on_events(spark, small, tmp_path):
    rng = random.Random(2)
    events = spark.read.parquet(f"{small}/events.parquet").orderBy("event_id").limit(600).collect()
    rows = [(f"u{r.user_id % 3}", BASE + 5 * i, r.event_id, rng.random() < 0.6) for i, r in enumerate(events)]
    want, own = [], {}
    for key, ts, seq, failed in rows:
        breaker = own.setdefault(key, Breaker(3, 30))
        want += [(key, at - BASE, str(s), o) for at, s, o in breaker.call(ts, seq, failed)]
    end = rows[-1][1] + 10_000
    for key, breaker in own.items():
        want += [(key, at - BASE, str(s), o) for at, s, o in breaker.wait(end)]
    last = [("other", end + 200, 10**6, False), ("other", end + 201, 10**6 + 1, False)]
    stream = land(spark, tmp_path, [*shuffled(rows, 4, rng), last[:1], last[1:]], "k string, s long, seq long, failed boolean").withColumn("ts", F.timestamp_seconds("s"))
    run_once(circuit_breaker(stream, "k", 3, 30, "100 seconds"), "breaker_loop", str(tmp_path / "cp"), "append").awaitTermination()
    got = [r for r in seen(spark, "breaker_loop") if r[0] != "other"]
    assert got == sorted(want)
    assert {r[3] for r in got} == {"passed", "failed", "rejected", "open", "half_open", "closed"}
