"""The life of jobs over a stream, against a plain walk over all events."""

import datetime

from pyspark.sql import Row
from pyspark.sql import functions as F

from quillspark import catalog
from quillspark.streaming import jobs

SF = "/root/testdata/sf0.001"
DAY = datetime.datetime(2024, 1, 1)
EVENT = "job_id long, event_id long, ts timestamp, status string"


def deliver(spark, folder, rows):
    made = [(j, e, DAY + datetime.timedelta(minutes=m), s) for j, e, m, s in rows]
    spark.createDataFrame(made, EVENT).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def take(spark, folder, limit=3600):
    stream = spark.readStream.schema(EVENT).parquet(f"{folder}/in")
    jobs.run(jobs.lifecycle(stream, limit, "1 minute"), f"{folder}/out", f"{folder}/c").awaitTermination()
    changes = jobs.written(spark, f"{folder}/out")
    minutes = lambda t: None if t is None else (t - DAY).total_seconds() / 60
    end = {r.job_id: (r.status, minutes(r.started_at), minutes(r.finished_at), r.timeouts) for r in jobs.state(changes).collect()}
    return end, jobs.active(changes).first().active


def test_a_silent_job_times_out(spark, tmp_path):
    """By its timer, when others' events move the time on; and it lives again if it speaks."""
    deliver(spark, tmp_path, [(1, 1, 0, "pending"), (2, 2, 0, "pending"), (2, 3, 5, "running"), (3, 4, 1, "running"), (3, 5, 9, "success")])
    assert take(spark, tmp_path) == ({1: ("pending", 0, None, 0), 2: ("running", 0, None, 0), 3: ("success", 1, 9, 0)}, 2)
    deliver(spark, tmp_path, [(2, 6, 50, "running"), (4, 7, 90, "pending")])
    assert take(spark, tmp_path) == ({1: ("timeout", 0, 60, 1), 2: ("running", 0, None, 0), 3: ("success", 1, 9, 0), 4: ("pending", 90, None, 0)}, 2)
    deliver(spark, tmp_path, [(1, 8, 100, "running"), (4, 9, 300, "error")])  # the second long after its hour
    assert take(spark, tmp_path) == ({1: ("timeout", 0, 160, 2), 2: ("timeout", 0, 110, 1), 3: ("success", 1, 9, 0), 4: ("error", 90, 300, 1)}, 0)


def test_events_that_come_late(spark, tmp_path):
    deliver(spark, tmp_path, [(1, 5, 30, "running"), (1, 6, 30, "success")])
    take(spark, tmp_path)
    deliver(spark, tmp_path, [(1, 4, 29.5, "pending"), (1, 7, 40, "running")])
    assert take(spark, tmp_path) == ({1: ("running", 29.5, None, 0)}, 1)


def test_all_events_by_user(spark):
    limit = catalog.SILENT
    of = {"signup": "pending", "click": "running", "view": "running", "purchase": "success", "error": "error"}
    by, end = {}, datetime.datetime.min
    for r in spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id").collect():
        by.setdefault(r.user_id, []).append((r.ts, of[r.event_type]))
        end = max(end, r.ts)
    want = {}
    for user, events in by.items():
        gaps = [(a, b[0]) for a, b in zip(events, events[1:])] + [(events[-1], end - datetime.timedelta(hours=1))]
        late = [s in jobs.OPEN and (t - at).total_seconds() > limit for (at, s), t in gaps]
        at, status = events[-1]
        finished = at + datetime.timedelta(seconds=limit) if late[-1] else None if status in jobs.OPEN else at
        want[user] = ("timeout" if late[-1] else status, events[0][0], finished, sum(late))
    got = {r.job_id: (r.status, r.started_at, r.finished_at, r.timeouts) for r in catalog.QUERIES["x8_lifecycle"](spark, SF).collect()}
    assert got == want
    assert sum(w[3] for w in want.values()) > 0 and {w[0] for w in want.values()} >= {"success", "running"}


def test_events_of_a_job_are_rows_not_frames():
    """every job of every batch made frames of its own, to sort its events and for its one row."""

    class Held:
        value, timers = None, []
        get = lambda self: self.value
        update = lambda self, value: setattr(self, "value", value)
        registerTimer = lambda self, at: self.timers.append(at)

    job = jobs.Lifecycle()
    job.limit, job.handle, job.job = 10_000, Held(), Held()
    rows = [Row(job_id=5, event_id=n, status=s, micros=m) for n, s, m in [(3, "running", 12_000), (1, "pending", 1_000), (2, "running", 1_000)]]
    assert list(job.handleInputRows((5,), iter(rows), None)) == [Row(job_id=5, status="running", started=1_000, finished=None, timeouts=1, version=1, change=1)]
    assert job.job.value == ("running", 1_000, 12_000, 3, 1, 1) and job.handle.timers == [23]
