"""The states' sink and stalled runs, against the batch form and a loop."""

import random

from pyspark.sql import functions as F
from test_stateful import BASE, land, seen, shuffled

from docgrain.streaming import events as E
from docgrain.streaming.jobs import latest_state, run_once


def test_stream_and_batch_agree_after_a_second_run(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"j{rng.randint(0, 20)}", rng.choice(["QUEUED", "PARSING", "READY", "FAILED"]), BASE + rng.randint(0, 50), i) for i in range(300)]
    schema = "job_id string, state string, s long, seq long"
    stream = land(spark, tmp_path, [rows[:100], rows[100:150], rows[150:]], schema).withColumn("ts", F.timestamp_seconds("s"))
    target = str(tmp_path / "states")
    E.keep_states(stream, target, str(tmp_path / "cp")).awaitTermination()
    every = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s"))
    want = sorted((r.job_id, r.state, r.ts, r.n_events) for r in latest_state(every).collect())
    got = lambda: sorted((r.job_id, r.state, r.ts, r.n_events) for r in E.states(spark, target).collect())
    assert got() == want
    # the last batch comes again, as after a lost driver
    E.merge(spark.createDataFrame(rows[150:], schema).withColumn("ts", F.timestamp_seconds("s")), 2, target)
    assert got() == want and E._versions(spark, target) == [1, 2]


def test_stalls_equal_a_loop(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"r{rng.randint(0, 8)}", BASE + 9 * i, i, rng.choice(["route", "retrieve", "rerank", "generate", "verify", "final" if rng.random() < 0.2 else "verify"])) for i in range(150)]
    want, own = [], {}
    for run, ts, _, stage in rows:
        want += [(run, at - BASE, s, o) for at, s, o in own.setdefault(run, E.Progress(60)).event(ts, stage)]
    end = rows[-1][1] + 10_000
    for run, progress in own.items():
        want += [(run, at - BASE, s, o) for at, s, o in progress.wait(end)]
    last = [("other", end + 200, 10**6, "final"), ("other", end + 201, 10**6 + 1, "final")]
    stream = land(spark, tmp_path, [*shuffled(rows, 3, rng), last[:1], last[1:]], "run_id string, s long, seq long, stage string").withColumn("ts", F.timestamp_seconds("s"))
    run_once(E.stalled_runs(stream, 60, "100 seconds"), "stall_loop", str(tmp_path / "cp"), "append").awaitTermination()
    got = [r for r in seen(spark, "stall_loop") if r[0] != "other"]
    assert got == sorted(want) and {r[3] for r in got} == {"stalled", "resumed", "ended"}
