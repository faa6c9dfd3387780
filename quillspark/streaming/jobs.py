"""The life of index jobs over a stream: a state machine with timers.

A job is pending, running, success or error, as its last event says. One that is open (pending or running)
and silent for longer than ``limit`` has timed out: at its next event, or, when none comes, by a timer in
event time once the watermark is past. An event after that opens it again. Each change leaves a row with a
``version`` that counts a job's changes, and ``change``, by which the number of open jobs rises or falls;
the last version is the job's state, and the sum of all changes is the gauge of active jobs.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OPEN = ("pending", "running")
STATE = "status string, started long, last long, last_event long, timeouts long, version long"
CHANGED = "job_id long, status string, started long, finished long, timeouts long, version long, change int"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Lifecycle(StatefulProcessor):
    limit = 0  # microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.job = handle, handle.getValueState("job", STATE)

    def _row(self, key, status, started, last, timeouts, version, change) -> Row:
        finished = None if status in OPEN else last + self.limit if status == "timeout" else last
        return Row(job_id=key[0], status=status, started=started, finished=finished, timeouts=timeouts, version=version, change=change)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        status, started, last, number, timeouts, version = self.job.get() or (None, None, None, None, 0, 0)
        was_open, old = status in OPEN, last
        for micros, event, said in sorted(((r.micros, r.event_id, r.status) for r in rows), key=lambda e: e[:2]):
            if last is not None and (micros, event) < (last, number):
                started = min(started, micros)  # late: an event after it has spoken already
                continue
            if status in OPEN and micros - last > self.limit:
                timeouts += 1
            status, last, number = said, micros, event
            started = last if started is None else min(started, last)
        version += 1
        self.job.update((status, started, last, number, timeouts, version))
        if was_open:
            self.handle.deleteTimer(self._due(old))
        if status in OPEN:
            self.handle.registerTimer(self._due(last))
        yield self._row(key, status, started, last, timeouts, version, int(status in OPEN) - int(was_open))

    def _due(self, last: int) -> int:
        return -(-(last + self.limit) // 1000) + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, started, last, number, timeouts, version = self.job.get()
        if status in OPEN and self._due(last) <= expiredTimerInfo.getExpiryTimeInMs():
            self.job.update(("timeout", started, last, number, timeouts + 1, version + 1))
            yield self._row(key, "timeout", started, last, timeouts + 1, version + 1, -1)

    def close(self) -> None:
        pass


def lifecycle(events: DataFrame, limit_seconds: int, late: str = "1 hour") -> DataFrame:
    """CHANGED rows of a stream of events (job_id, event_id, ts, status); ts is a TIMESTAMP."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    p = Lifecycle()
    p.limit = limit_seconds * 1_000_000
    e = events.withWatermark("ts", late).select("job_id", "event_id", "status", F.unix_micros("ts").alias("micros"), "ts")
    return e.groupBy("job_id").transformWithState(p, CHANGED, "Append", "EventTime")


def run(changes: DataFrame, path: str, checkpoint: str):
    """A streaming query that writes changes to a folder for each batch, which a replay replaces."""
    sink = changes.writeStream.foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}"))
    return sink.option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def written(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{CHANGED}, epoch long").parquet(path)


def state(changes: DataFrame) -> DataFrame:
    """(job_id, status, started_at, finished_at, timeouts): the last version of each job."""
    last = changes.groupBy("job_id").agg(F.max(F.struct("version", "status", "started", "finished", "timeouts")).alias("s"))
    at = lambda c: F.timestamp_micros(F.col(c)).cast("timestamp_ntz")
    return last.select("job_id", "s.status", at("s.started").alias("started_at"), at("s.finished").alias("finished_at"), "s.timeouts")


def active(changes: DataFrame) -> DataFrame:
    """(active): how many jobs are open."""
    return changes.agg(F.coalesce(F.sum("change"), F.lit(0)).alias("active"))
