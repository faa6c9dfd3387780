"""A stored table whose commits replace partitions and are seen whole or not at all.

Rows lie in PARTS partitions by a hash of their key columns. A commit writes the partitions that it touches
to a new folder and then a manifest that names the folder of every partition; readers follow the last
manifest, so a commit that fails on the way leaves folders that nothing names and no other trace. The
manifest also holds the last epoch of each stream: a batch that comes again is left out. Untouched partitions
keep their files.

One writer at a time: a manifest is created under the next number and never overwritten, so of two writers
that race the second fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

#: Partitions of a store; a file's rows are in one.
PARTS = 16


class Store:
    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = ("project_id", "file_path"), parts: int = PARTS):
        self.spark, self.path, self.keys, self.parts = spark, path.rstrip("/"), keys, parts

    def _fs(self):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), at, jvm.org.apache.hadoop.fs.Path

    def _numbers(self) -> list[int]:
        fs, at, _ = self._fs()
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(at)) if fs.exists(at) else []

    def manifest(self) -> dict:
        """The last manifest that was written whole; an empty one if there is none."""
        for n in reversed(self._numbers()):
            text = self.spark.read.text(f"{self.path}/manifests/{n}", wholetext=True).first()
            try:
                return json.loads(text[0] if text else "")
            except ValueError:
                continue  # its writer was lost
        return {"schema": None, "parts": {}, "epochs": {}, "count": self.parts}

    def part(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.manifest().get("count", self.parts))).cast("int")

    def read(self, only: list[int] | None = None) -> DataFrame | None:
        """The rows, or those of some partitions; None of a store without a commit."""
        m = self.manifest()
        if not m.get("schema"):
            return None
        schema = ST.StructType.fromJson(m["schema"])
        folders = [f"{self.path}/{m['parts'][p]}" for p in sorted(m["parts"], key=int) if only is None or int(p) in only]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def seen(self, stream: str, epoch: int) -> bool:
        return self.manifest().get("epochs", {}).get(stream, -1) >= epoch

    def commit(self, rows: DataFrame, touched: list[int], stream: str = "", epoch: int | None = None, dealt: bool = False) -> None:
        """Replaces the touched partitions by rows, which belong to these; rows that are ``dealt`` lie in
        few tasks for each partition already."""
        m, folder = self.manifest(), f"data/{uuid.uuid4().hex}"
        kind = rows.schema
        rows = rows.withColumn("__part", self.part())
        (rows if dealt else rows.repartition("__part")).write.partitionBy("__part").parquet(f"{self.path}/{folder}")
        fs, at, jpath = self._fs()
        written = {f.getPath().getName().split("=")[1] for f in fs.listStatus(jpath(f"{self.path}/{folder}")) if "=" in f.getPath().getName()}
        stray = written - {str(p) for p in touched}
        if stray:
            raise ValueError(f"rows of partitions that the commit does not touch: {sorted(stray)}")
        parts = {p: f for p, f in m["parts"].items() if int(p) not in touched} | {p: f"{folder}/__part={p}" for p in written}
        epochs = m["epochs"] | ({stream: epoch} if epoch is not None else {})
        self._swap({"schema": json.loads(kind.json()), "parts": parts, "epochs": epochs, "count": m.get("count", self.parts)})

    def _swap(self, manifest: dict) -> None:
        fs, at, jpath = self._fs()
        out = fs.create(jpath(f"{self.path}/manifests/{max(self._numbers(), default=0) + 1}"), False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()

    def clean(self) -> int:
        """Deletes the partitions' folders that the last manifest does not name, and older manifests; how
        many folders. For times without readers of older states."""
        fs, at, jpath = self._fs()
        used, gone, data = set(self.manifest()["parts"].values()), 0, jpath(f"{self.path}/data")
        for commit in fs.listStatus(data) if fs.exists(data) else []:
            name = commit.getPath().getName()
            held = [f.getPath() for f in fs.listStatus(commit.getPath()) if "=" in f.getPath().getName()]
            stale = [p for p in held if f"data/{name}/{p.getName()}" not in used]
            for p in stale:
                gone += bool(fs.delete(p, True))
            if len(stale) == len(held):
                fs.delete(commit.getPath(), True)
        for n in self._numbers()[:-1]:
            fs.delete(jpath(f"{self.path}/manifests/{n}"), False)
        return gone
