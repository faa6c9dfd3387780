"""Structured Streaming forms: webhook dispatch, delta maintenance, quota, session memory, live counters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import gateway, maintenance

HOOK = "event_type string, branch string, project string, paths array<string>, ts timestamp"


def webhooks(hooks: DataFrame) -> DataFrame:
    """Adds the dispatch status to a stream of parsed webhooks."""
    return hooks.withColumn("status", gateway.dispatch(F.col("event_type"), F.col("branch"), F.col("project"), F.col("paths")))


def delta_writer(load: Callable[[], DataFrame], save: Callable[[DataFrame], None], key: str = "file_path", order: str = "ts"):
    """foreachBatch function: of each batch the latest event of a file replaces its rows."""

    def run(batch: DataFrame, _epoch: int) -> None:
        last = maintenance.latest(batch, [key], [F.desc(order)])
        current = load()
        gone = last.select(key)
        new = last.where("not removed").select(*current.columns)
        save(current.join(gone, key, "left_anti").unionByName(new))

    return run


class Quota(StatefulProcessor):
    """Sliding-window admission by key; state is at most ``limit`` times."""

    limit, seconds = 30, 60

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "t double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        kept = [r[0] for r in self.kept.get()]
        for f in rows:
            f = f.sort_values(["ts", "event_id"])
            out = []
            for t in f["ts"]:
                s = t.timestamp()
                kept = [x for x in kept if x >= s - self.seconds]
                out.append(len(kept) < self.limit)
                if out[-1]:
                    kept.append(s)
            yield pd.DataFrame({"user_id": [key[0]] * len(f), "event_id": f["event_id"].to_numpy(), "admitted": out})
        self.kept.put([(x,) for x in kept]) if kept else self.kept.clear()

    def close(self) -> None:
        pass


def quota_processor(limit: int, seconds: int) -> StatefulProcessor:
    p = Quota()
    p.limit, p.seconds = limit, seconds
    return p


def admitted(events: DataFrame, limit: int = 30, seconds: int = 60) -> DataFrame:
    """Needs the RocksDB state store provider."""
    return events.groupBy("user_id").transformWithStateInPandas(quota_processor(limit, seconds), "user_id long, event_id long, admitted boolean", "Append", "None")


class Memory(StatefulProcessor):
    """The last ``n`` turns of each session."""

    n = 8

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", "turn long, role string, content string")

    def handleInputRows(self, key, rows, timers):
        held = [tuple(r) for r in self.turns.get()]
        for f in rows:
            held += list(f.sort_values("turn")[["turn", "role", "text"]].itertuples(index=False, name=None))
        held = sorted(held)[-self.n :]
        self.turns.put([(int(t), r, c) for t, r, c in held])
        yield pd.DataFrame({"conv_id": [key[0]], "turns": [len(held)], "last_turn": [int(held[-1][0])]})

    def close(self) -> None:
        pass


def session_memory(turns: DataFrame, n: int = 8) -> DataFrame:
    p = Memory()
    p.n = n
    return turns.groupBy("conv_id").transformWithStateInPandas(p, "conv_id long, turns long, last_turn long", "Update", "None")


def live_counters(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by hour and type; ts must be a TIMESTAMP (cast TIMESTAMP_NTZ first)."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
