"""Media columns: payloads as members of archives, read back by a custom Spark data source.

Writing: every task packs its payloads as lossless 8-bit grayscale PNG members, 576 samples a row,
into one archive in the shared folder; a directory at the archive's end lists id, offset and length of
each member in order. An archive is written under a name of its attempt and renamed when complete, so
a lost executor leaves no half archive.

Reading: the source lists the archives, plans byte-range partitions over them and each partition
reads the directory entries whose members start in its range. Members stream in Arrow batches of
bounded bytes; each is checked and, on failure, read again by its offset alone, RETRIES times, before
an error row stands for it.

Null text is empty: 576 bytes of 255. Texts of any length make one member, which is read whole. Repeated
rows and rows with a null id are members each; members are told apart by their offset, so ties do not
arise. Empty tables give no members; a folder that is missing fails the read. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shared import lean, new_folder

UNIT, PAD = 576, 255
RANGE_BYTES, BATCH_BYTES, RETRIES = 32 << 20, 4 << 20, 3
#: id, 1 if the id is null, offset, length, unpadded bytes, crc32 of the member.
ENTRY, TAIL = "<qqqqqq", "<qq8s"
ENTRY_BYTES, TAIL_BYTES = struct.calcsize(ENTRY), struct.calcsize(TAIL)
MAGIC = b"QSMEDIA1"


def padded(data: bytes) -> bytes:
    return data + bytes([PAD]) * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def to_png(payload: bytes) -> bytes:
    """An 8-bit grayscale PNG, one row for each 576 samples, filter type 0."""
    rows = np.zeros((len(payload) // UNIT, UNIT + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 2)) + chunk(b"IEND", b"")


def from_png(png: bytes) -> bytes:
    if png[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, width, body = 8, 0, []
    while at < len(png):
        n, kind = struct.unpack(">I4s", png[at : at + 8])
        data = png[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("checksum")
        if kind == b"IHDR":
            width = struct.unpack(">I", data[:4])[0]
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(-1, width + 1)
    return rows[:, 1:].tobytes()


def opened(path: str):
    """(filesystem, path in it) of a folder; local, HDFS and object stores alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_archives(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> str:
    """Writes the texts' payloads; returns the archive folder in the shared folder."""
    folder = new_folder(docs.sparkSession, "media")
    where, root = opened(folder)
    where.create_dir(root, recursive=True)

    def run(batches):
        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        ctx = TaskContext.get()
        name = f"{root}/part-{ctx.partitionId():06d}"
        temp = f"{name}.{ctx.attemptNumber()}-{uuid.uuid4().hex}.tmp"
        entries, at = [], 0
        with store.open_output_stream(temp) as out:
            for b in batches:
                for key, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    data = (value or "").encode()
                    png = to_png(padded(data))
                    out.write(png)
                    entries.append(struct.pack(ENTRY, key or 0, key is None, at, len(png), len(data), zlib.crc32(png)))
                    at += len(png)
            out.write(b"".join(entries))
            out.write(struct.pack(TAIL, at, len(entries), MAGIC))
        store.move(temp, f"{name}.arc")
        yield pa.RecordBatch.from_arrays([pa.array([len(entries)], pa.int64())], ["members"])

    docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(lean(run), "members long").agg(F.sum("members")).collect()
    return folder


@dataclass
class Range(InputPartition):
    path: str
    lo: int
    hi: int


SCHEMA = "doc_id long, archive string, offset long, n_bytes long, media binary, error string"


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self):
        from pyarrow import fs

        store, root = opened(self.folder)
        out = []
        for f in store.get_file_info(fs.FileSelector(root)):
            if f.path.endswith(".arc"):
                out += [Range(f.path, lo, lo + RANGE_BYTES) for lo in range(0, max(1, f.size), RANGE_BYTES)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range):
        if not partition.path:
            return
        store, _ = opened(self.folder)
        with store.open_input_file(partition.path) as f:
            size = f.size()
            directory, n, magic = struct.unpack(TAIL, f.read_at(TAIL_BYTES, size - TAIL_BYTES))
            if magic != MAGIC:
                raise OSError(f"not an archive: {partition.path}")
            entry = lambda i: struct.unpack(ENTRY, f.read_at(ENTRY_BYTES, directory + i * ENTRY_BYTES))

            def first(byte: int) -> int:  # of the members that start at this byte or later
                a, z = 0, n
                while a < z:
                    m = (a + z) // 2
                    a, z = (m + 1, z) if entry(m)[2] < byte else (a, m)
                return a

            lo, hi = first(partition.lo), first(partition.hi)
            raw = f.read_at((hi - lo) * ENTRY_BYTES, directory + lo * ENTRY_BYTES)
            rows, held = [], 0
            for key, null, offset, length, plain, crc in struct.iter_unpack(ENTRY, raw):
                png, error = self.member(store, partition.path, f, offset, length, crc)
                rows.append((None if null else key, partition.path, offset, plain, png, error))
                held += length
                if held >= BATCH_BYTES:
                    yield self.batch(rows)
                    rows, held = [], 0
            if rows:
                yield self.batch(rows)

    @staticmethod
    def member(store, path, f, offset, length, crc):
        """One member, read again by its offset until its checksum holds."""
        error = None
        for attempt in range(RETRIES):
            try:
                if attempt:
                    with store.open_input_file(path) as again:
                        png = again.read_at(length, offset)
                else:
                    png = f.read_at(length, offset)
                if zlib.crc32(png) == crc:
                    return png, None
                error = "checksum"
            except OSError as e:
                error = str(e)
        return None, error

    @staticmethod
    def batch(rows):
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "archive", "offset", "n_bytes", "media", "error"])


class MediaArchives(DataSource):
    @classmethod
    def name(cls):
        return "media_archives"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ArchiveReader(self.options["path"])


def read_archives(spark, folder: str) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").load(folder)


FEATURES = "doc_id long, n_bytes long, payload binary, media_bytes long, media_sha256 string, feature string"


def features(members: DataFrame) -> DataFrame:
    """Decodes the stored members: payload and a feature (mean, deviation, entropy, edges) of its samples.
    A member that could not be read fails the query rather than be left out."""

    def run(batches):
        import hashlib

        for b in batches:
            rows = []
            for key, plain, png, error in zip(*(b.column(k).to_pylist() for k in range(4))):
                if error:
                    raise OSError(f"member of {key}: {error}")
                payload = from_png(png)
                x = np.frombuffer(payload, np.uint8)
                p = np.bincount(x, minlength=256) / len(x)
                p = p[p > 0]
                edges = np.abs(np.diff(x.astype(np.int16))).mean()
                feature = f"{x.mean():.4f},{x.std():.4f},{-(p * np.log2(p)).sum():.4f},{edges:.4f}"
                rows.append((key, plain, payload, len(png), hashlib.sha256(png).hexdigest(), feature))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string())
            cols = zip(*rows) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "n_bytes", "payload", "media_bytes", "media_sha256", "feature"])

    return members.select("doc_id", "n_bytes", "media", "error").mapInArrow(lean(run), FEATURES)
