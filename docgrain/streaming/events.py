"""Job and stage events: a sink that keeps the latest state of every job, and runs that stall."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .stateful import InOrder, _run

ENDS = ("final", "error")


def _versions(spark: SparkSession, target: str) -> list[int]:
    """The complete versions of the kept states."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/version=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])


def states(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """job_id, state, ts, seq, n_events of every job in the newest complete version (before a number, if given)."""
    own = [v for v in _versions(spark, target) if before is None or v < before]
    return spark.read.parquet(f"{target}/version={own[-1]}") if own else None


def merge(batch: DataFrame, number: int, target: str) -> None:
    """Merges a batch of events (job_id, state, ts, seq) into the states: version `number` from the newest one before it. A batch
    that is run again makes its version again from the same one, so nothing counts twice; older versions go, but for that one."""
    spark = batch.sparkSession
    new = batch.select("job_id", "state", "ts", "seq", F.lit(1).cast("long").alias("n_events"))
    old = states(spark, target, number)
    every = new if old is None else new.unionByName(old)
    latest = F.max_by(F.struct("state", "ts", "seq"), F.struct("ts", "seq")).alias("last")
    merged = every.groupBy("job_id").agg(latest, F.sum("n_events").alias("n_events")).select("job_id", "last.*", "n_events")
    merged.write.mode("overwrite").parquet(f"{target}/version={number}")
    for version in [v for v in _versions(spark, target) if v < number][:-1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/version={version}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def keep_states(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """All events of a stream that are there now, merged batch by batch into the states below target."""
    return events.writeStream.foreachBatch(lambda b, n: merge(b, n, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress:
    """A run's last stage, and when it counts as stalled (0: it doesn't, as it has ended or said so already)."""

    def __init__(self, patience: int, stage: str | None = None, until: int = 0, ended: bool = False):
        self.patience, self.stage, self.until, self.ended = patience, stage, until, ended

    def wait(self, now: int) -> list[tuple]:
        if self.until and now >= self.until:
            at, self.until = self.until, 0
            return [(at, self.stage, "stalled")]
        return []

    def event(self, now: int, stage: str) -> list[tuple]:
        """Nothing counts after the end; a stage after a stall resumes the run."""
        if self.ended:
            return []
        out = self.wait(now)
        resumed = self.stage is not None and not self.until
        self.stage, self.ended = stage, stage in ENDS
        self.until = 0 if self.ended else now + self.patience
        return out + ([(now, stage, "resumed")] if resumed else []) + ([(now, stage, "ended")] if self.ended else [])


class _Stalls(InOrder):
    columns = ("ts", "stage", "outcome")

    def __init__(self, patience: int):
        self.patience = patience

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("progress", StructType([StructField("stage", StringType()), StructField("until", LongType()), StructField("ended", LongType())]))

    def _read(self) -> Progress:
        stage, until, ended = self.state.get() if self.state.exists() else (None, 0, 0)
        return Progress(self.patience, stage, until, bool(ended))

    def play(self, rows: list[tuple[int, int, str]], now: int) -> list[tuple]:
        own = self._read()
        out = [x for ts, _, stage in rows for x in own.event(ts, stage)] + own.wait(now)
        self.state.update((own.stage, own.until, int(own.ended)))
        return out

    def deadline(self) -> int | None:
        return self._read().until or None


def stalled_runs(events: DataFrame, patience_seconds: int = 60, delay: str = "1 hour") -> DataFrame:
    """key (the run), ts, stage, outcome of a stream of stage events (run_id, stage, ts timestamp, seq): stalled, patience_seconds
    after a stage, by a timer if nothing comes; resumed, if a stage comes after that; ended, with `final` or `error`."""
    return _run(events.select("run_id", "ts", "seq", F.col("stage").alias("what")), "run_id", _Stalls(patience_seconds * 1_000_000), ("long", "string", "string"), delay)
