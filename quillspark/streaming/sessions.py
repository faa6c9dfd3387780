"""Session memory over a stream, with control rows and a start from the batch table.

Each session keeps its last ``n`` turns. A row with ``control`` = 'clear' forgets what came before it, within a
batch too: rows are taken in the order of ``turn``. The first run may start from the turns that a batch table
holds, so a session goes on where its history ended; what the state has seen by then does not come again, for
turns up to the last one seen (kept through a clear) are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .jobs import ROCKSDB

SAID = "conv_id long, turn long, role string, text string, control string"
HELD = "conv_id long, turns array<struct<turn:long,role:string,content:string>>, last_turn long"


class Sessions(StatefulProcessor):
    n = 8

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", "turn long, role string, content string")
        self.last = handle.getValueState("last", "turn long")

    def _take(self, rows: Iterator[pd.DataFrame]) -> tuple[list[tuple], int]:
        held = [(int(t), r, c) for t, r, c in self.turns.get()]
        last = self.last.get()[0] if self.last.exists() else -1
        said = pd.concat(list(rows)).sort_values("turn", kind="stable")
        for turn, role, text, control in said[["turn", "role", "text", "control"]].itertuples(index=False, name=None):
            if turn <= last:
                continue
            last = int(turn)
            held = [] if control == "clear" else [*held, (last, role, text)][-self.n :]
        if held:
            self.turns.put(held)
        else:
            self.turns.clear()
        self.last.update((last,))
        return held, last

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._take(iter([initialState]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, last = self._take(rows)
        yield pd.DataFrame({"conv_id": [key[0]], "turns": [[{"turn": t, "role": r, "content": c} for t, r, c in held]], "last_turn": [last]})

    def close(self) -> None:
        pass


def sessions(said: DataFrame, n: int = 8, history: DataFrame | None = None) -> DataFrame:
    """HELD rows of a stream of turns (SAID), one for each session and batch; ``history`` is a table of
    earlier turns (SAID) that the first run starts from."""
    said.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    p = Sessions()
    p.n = n
    start = None if history is None else history.groupBy("conv_id")
    return said.groupBy("conv_id").transformWithStateInPandas(p, HELD, "Update", "None", initialState=start)


def run(held: DataFrame, path: str, checkpoint: str):
    """A streaming query that writes what sessions hold to a folder for each batch, which a replay replaces."""
    sink = held.writeStream.foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}"))
    return sink.option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def state(spark, path: str) -> DataFrame:
    """(conv_id, turns, last_turn): what each session that has spoken holds now."""
    rows = spark.read.schema(f"{HELD}, epoch long").parquet(path)
    return rows.groupBy("conv_id").agg(F.max_by(F.struct("turns", "last_turn"), "epoch").alias("s")).select("conv_id", "s.turns", "s.last_turn")
