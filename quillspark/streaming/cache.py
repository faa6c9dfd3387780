"""The semantic cache as state with a time to live, over a stream of what is stored and what is asked.

A row of kind 'put' stores an entry for ``ttl`` seconds after its time; a row of kind 'ask' gets the most similar
entry of its access hash that is stored at its time or before and not expired by then, if it reaches the threshold;
ties go to the smaller result. Entries are state; when the watermark has passed their end, a timer removes them, so
the state holds what is alive and not what was ever stored. No request can miss an entry that is gone: rows
behind the watermark are dropped as late. A request sees what has arrived with it or earlier.

An access hash is dealt over ``salts`` keys: an entry lies at one of them, a request asks all, and each gives
its best at most, so a hot hash is that many tasks. ``answers`` takes the best of these.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.cache import nearest
from .jobs import ROCKSDB

SAID = "kind string, rbac_hash string, id string, ts timestamp, vector array<double>, result string"
HIT = "id string, sim double, result string"


class Cache(StatefulProcessor):
    ttl, threshold = 0, 0.95  # ttl in microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "until long, id string", "since long, vector array<double>, result string")
        self.due = handle.getValueState("due", "at long")

    def _wake(self, until: int) -> None:
        """A key has one timer, at the end of the entry that ends first."""
        at = -(-until // 1000)
        if self.due.exists():
            held = self.due.get()[0]
            if held <= at:
                return
            self.handle.deleteTimer(held)
        self.due.update((at,))
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        said = pd.concat(list(rows))
        puts, asks = said[said["kind"] == "put"], said[said["kind"] == "ask"]
        for id_, micros, vector, result in puts[["id", "micros", "vector", "result"]].itertuples(index=False, name=None):
            self.entries.updateValue((int(micros) + self.ttl, id_), (int(micros), [None if x is None else float(x) for x in vector], result))
        if len(puts):
            self._wake(int(puts["micros"].min()) + self.ttl)
        if len(asks):
            held = sorted(((v[2], v[0], k[0], v[1]) for k, v in self.entries.iterator()), key=lambda x: x[:3])
            result, since, until, vectors = zip(*held) if held else ((), (), (), ())
            sim, at = nearest(vectors, since, until, list(asks["vector"]), asks["micros"])
            hit = sim >= self.threshold
            if hit.any():
                yield pd.DataFrame({"id": asks["id"][hit], "sim": sim[hit], "result": [result[n] for n in at[hit]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ends = [k for k, _ in self.entries.iterator()]
        for k in ends:
            if k[0] <= passed:
                self.entries.removeKey(tuple(k))
        self.due.clear()
        left = [k[0] for k in ends if k[0] > passed]
        if left:
            self._wake(min(left))
        yield pd.DataFrame({"id": pd.Series(dtype=str), "sim": pd.Series(dtype=float), "result": pd.Series(dtype=str)})

    def close(self) -> None:
        pass


def hits(said: DataFrame, ttl_seconds: int = 3600, threshold: float = 0.95, late: str = "1 minute", salts: int = 8) -> DataFrame:
    """HIT rows of a stream of SAID rows: for each request and key its best entry, if there is one. Rows without
    an id, a time or a vector are left out."""
    said.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    p = Cache()
    p.ttl, p.threshold = ttl_seconds * 1_000_000, threshold
    s = said.withWatermark("ts", late).where("id is not null and ts is not null and vector is not null and (kind = 'ask' or result is not null)")
    own, all_ = F.array(F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")), F.sequence(F.lit(0), F.lit(salts - 1))
    s = s.select("kind", "rbac_hash", F.explode(F.when(F.col("kind") == "put", own).otherwise(all_)).alias("salt"), "id", F.unix_micros("ts").alias("micros"), "vector", "result", "ts")
    return s.groupBy("rbac_hash", "salt").transformWithStateInPandas(p, HIT, "Append", "EventTime")


def run(found: DataFrame, path: str, checkpoint: str):
    """A streaming query that writes hits to a folder for each batch, which a replay replaces."""
    sink = found.writeStream.foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}"))
    return sink.option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def answers(spark: SparkSession, path: str) -> DataFrame:
    """(id, result) of the requests that hit."""
    rows = spark.read.schema(f"{HIT}, epoch long").parquet(path)
    return rows.groupBy("id").agg(F.min(F.struct((-F.col("sim")).alias("s"), "result")).alias("b")).select("id", "b.result")
