"""Media columns against payloads made here, with archives over one range and reads that fail."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import media, queries


def payload(text):
    data = (text or "").encode()
    return data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))


def feature(p):
    x = np.frombuffer(p, np.uint8).astype(float)
    share = np.array([c / len(p) for c in Counter(p).values()])
    return f"{x.mean():.4f},{x.std():.4f},{-(share * np.log2(share)).sum():.4f},{np.abs(x[1:] - x[:-1]).mean():.4f}"


TEXTS = ["", None, "a", "x" * 576, "x" * 577, "été 日本 😀" * 100, "same", "same", "long " * 400_000]


def test_query_columns(spark, tmp_path):
    rows = [(i if i != 2 else None, t, "m", i) for i, t in enumerate(TEXTS)] + [(6, "same", "m", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, media string, offset long").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op4_media_columns(spark, str(tmp_path)).collect()
    want = Counter()
    for i, t, *_ in rows:
        p = payload(t)
        png = media.to_png(p)
        want[i, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(png), hashlib.sha256(png).hexdigest(), feature(p)] += 1
    cells = [(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) for r in got]
    assert Counter(c[:7] for c in cells) == Counter(c[:7] for c in want.elements())
    by = {c[3]: c[7] for c in want}
    for c in cells:
        assert np.allclose([float(x) for x in c[7].split(",")], [float(x) for x in by[c[3]].split(",")], atol=2e-4)


def test_archives_over_one_range(spark, monkeypatch):
    """Members are read once each, in whichever range they start."""
    monkeypatch.setattr(media, "RANGE_BYTES", 700)
    rows = [(i, f"text {i} " * (i % 40)) for i in range(300)]
    folder = media.write_archives(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    reader = media.ArchiveReader(folder)
    parts = reader.partitions()
    assert len(parts) > 10
    seen = Counter()
    for p in parts:
        for b in reader.read(p):
            for i, png in zip(b.column(0).to_pylist(), b.column(4).to_pylist()):
                seen[i, media.from_png(png)] += 1
    assert seen == Counter((i, payload(t)) for i, t in rows)


def test_a_member_is_read_again_by_its_offset(spark):
    png = media.to_png(payload("kept"))

    class Bad:
        def read_at(self, n, at):
            return b"?" * n

    class Good:
        def __enter__(self):
            return self

        def __exit__(self, *_):
            return False

        def read_at(self, n, at):
            return png[at : at + n]

    class Store:
        opened = 0

        def open_input_file(self, path):
            self.opened += 1
            return Good()

    store = Store()
    assert media.ArchiveReader.member(store, "p", Bad(), 0, len(png), zlib.crc32(png)) == (png, None) and store.opened == 1
    Good.read_at = lambda self, n, at: b"?" * n
    assert media.ArchiveReader.member(store, "p", Bad(), 0, len(png), zlib.crc32(png)) == (None, "checksum")


def test_broken_members_and_missing_folders_fail(spark):
    png = media.to_png(b"\xff" * 576)
    with pytest.raises(ValueError):
        media.from_png(png[:50] + b"?" + png[51:])
    rows = spark.createDataFrame([(1, 3, None, "checksum")], "doc_id long, n_bytes long, media binary, error string")
    with pytest.raises(Exception, match="checksum"):
        media.features(rows).collect()
    with pytest.raises(Exception, match="missing-folder"):
        media.read_archives(spark, "/tmp/missing-folder-of-archives").collect()
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert media.features(media.read_archives(spark, media.write_archives(empty))).count() == 0
