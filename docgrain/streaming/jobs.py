"""Jobs, limits and caches: batch forms, which also run on streams, and the streams themselves."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

#: States of an ingestion job with their progress; READY and FAILED are final.
PROGRESS = {"QUEUED": 0, "PARSING": 15, "CHUNKING": 40, "EMBEDDING": 65, "INDEXING": 85, "READY": 100, "FAILED": 0}


def latest_state(log: DataFrame) -> DataFrame:
    """job_id, state, ts, n_events: the newest entry of each job in a log (job_id, state, ts, seq)."""
    return log.groupBy("job_id").agg(F.max_by("state", F.struct("ts", "seq")).alias("state"), F.max("ts").alias("ts"), F.count("*").alias("n_events"))


def rate_windows(calls: DataFrame, width: str = "60 seconds", limit: int = 60) -> DataFrame:
    """start, n, within: calls in fixed windows and whether they keep the limit; calls has ts (timestamp)."""
    return calls.groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n", (F.col("n") <= limit).alias("within"))


def failure_streaks(calls: DataFrame, key: str, order: list[str], least: int = 5) -> DataFrame:
    """key, first (number of the first call), length of runs of failed calls that are long enough to open a circuit."""
    w = Window.partitionBy(key).orderBy(*order)
    df = calls.withColumn("n", F.row_number().over(w))
    df = df.withColumn("grp", F.col("n") - F.row_number().over(Window.partitionBy(key, "failed").orderBy(*order)))
    return df.filter("failed").groupBy(key, "grp").agg(F.min("n").alias("first"), F.count("*").alias("length")).filter(F.col("length") >= least).drop("grp")


STAGES = ("route", "retrieve", "rerank", "generate", "verify")


def stage_events(log: DataFrame) -> DataFrame:
    """run_id, n_stages, last_stage, ended, in_order of an event log (run_id, seq, event, stage): a run ends with `final` or `error`,
    after which nothing counts; whether its stages came in the order of STAGES."""
    end = F.min(F.when(F.col("event").isin("final", "error"), F.col("seq")))
    ends = log.groupBy("run_id").agg(end.alias("end"))
    seen = log.join(ends, "run_id").filter((F.col("event") == "stage") & (F.col("end").isNull() | (F.col("seq") < F.col("end"))))
    place = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    before = F.max(place).over(Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    per = seen.withColumn("late", F.coalesce(place < before, F.lit(False))).groupBy("run_id").agg(F.count("*").alias("n_stages"), F.max_by("stage", "seq").alias("last_stage"), F.max("late").alias("late"))
    rows = ends.join(per, "run_id", "left")
    return rows.select("run_id", F.coalesce("n_stages", F.lit(0)).alias("n_stages"), "last_stage", F.col("end").isNotNull().alias("ended"), (~F.coalesce("late", F.lit(False))).alias("in_order"))


def stream_rates(events: DataFrame, late: str = "10 minutes", width: str = "60 seconds", limit: int = 60) -> DataFrame:
    """rate_windows() of a stream, with a watermark."""
    return rate_windows(events.withWatermark("ts", late), width, limit)


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """All data that is there now into a memory table."""
    return df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_stream(spark: SparkSession, landing: str, schema: str, target: str, checkpoint: str, each: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Files that land in a folder, turned by `each` and appended to `target`, batch by batch.

    A batch is written to a folder of its own number, so that a batch that is run again after a failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(landing)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cached_answers(requests: DataFrame, ttl_seconds: int = 86_400) -> DataFrame:
    """key, ts, hit of a stream of requests (key string, ts timestamp): whether an answer of the last ttl_seconds is there.

    A miss stores an answer; it expires by time whether or not it is asked for again.
    """

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stored = state.get[0] if state.exists else None
        if state.hasTimedOut:
            state.remove()
            return
        out = []
        for ts in sorted(t for batch in rows for t in batch["ts"]):
            hit = stored is not None and ts.timestamp() - stored < ttl_seconds
            stored = stored if hit else ts.timestamp()
            out.append((key[0], ts, hit))
        state.update((stored,))
        state.setTimeoutTimestamp(max(int((stored + ttl_seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "ts", "hit"])

    watched = requests.withWatermark("ts", "1 hour")
    return watched.groupBy("key").applyInPandasWithState(step, "key string, ts timestamp, hit boolean", "stored double", "append", GroupStateTimeout.EventTimeTimeout)
