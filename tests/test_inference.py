"""Model inference: batches, retries, error rows and stamps."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.functions import inference


def batches(n, size=50):
    for at in range(0, n, size):
        k = list(range(at, min(n, at + size)))
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array([None if i % 7 == 6 else f"t{i}" for i in k])], ["id", "__text"])


def run(load, n, key=None, **more):
    opts = {"batch": 32, "attempts": 3, "wait": 0.0} | more
    rows = [r for b in inference.inferred(load, (key or "m", repr(load)), **opts)(batches(n)) for r in b.to_pylist()]
    assert [r["id"] for r in rows] == list(range(n))
    return rows


def length_model(seen):
    def model(texts):
        seen.append(len(texts))
        return [[float(t[1:])] for t in texts]

    return model


def test_batches_and_one_load():
    seen, loads = [], []

    def load():
        loads.append(1)
        return length_model(seen)

    for _ in range(2):
        rows = run(load, 170)
        assert all(r["embedding"] == (None if r["id"] % 7 == 6 else [float(r["id"])]) and r["embedding_error"] is None for r in rows)
    assert len(loads) == 1 and max(seen) <= 32 and sum(seen) == 2 * sum(1 for i in range(170) if i % 7 != 6)


def test_retries_with_backoff(monkeypatch):
    calls, waits = [], []
    monkeypatch.setattr(inference.time, "sleep", waits.append)

    def load():
        def model(texts):
            calls.append(1)
            if len(calls) % 3:
                raise TimeoutError("slow")
            return [[1.0]] * len(texts)

        return model

    rows = run(load, 40, wait=0.5)
    assert all(r["embedding_error"] is None for r in rows) and waits == [0.5, 1.0, 0.5, 1.0]


def test_failed_batches_are_error_rows():
    def load():
        def model(texts):
            if "t40" in texts:
                raise ConnectionError("no answer")
            return [[0.5]] * (len(texts) - ("t100" in texts))

        return model

    rows = {r["id"]: r for r in run(load, 120)}
    assert rows[40]["embedding"] is None and rows[40]["embedding_error"] == "ConnectionError: no answer"
    assert rows[100]["embedding_error"].startswith("ValueError") and rows[0]["embedding"] == [0.5] and rows[0]["embedding_error"] is None
    assert all((r["embedding"] is None) == (r["embedding_error"] is not None) for i, r in rows.items() if i % 7 != 6)
    with pytest.raises(ValueError):
        inference.answered(lambda t: t, ["a"], 0, 0.0)


def test_over_a_table(spark):
    def load():
        return lambda texts: [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(1, "ab", [1]), (2, None, None)], "id long, t string, extra array<int>")
    got = {r.id: r for r in inference.embedded(df, F.col("t"), load, "m", "3").collect()}
    assert got[1].embedding == [2.0] and got[2].embedding is None and got[1].extra == [1]
    assert {(r.embedding_model, r.embedding_model_version, r.embedding_error) for r in got.values()} == {("m", "3", None)} and got[2].indexed_at is not None


def test_rows_are_held_in_parts():
    """the texts and vectors of a whole Arrow batch were Python objects at once."""
    texts = [None if n % 7 == 0 else f"w{n}" for n in range(3000)]
    asked = []
    model = lambda some: asked.append(len(some)) or [[float(len(t))] for t in some]
    whole = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(texts, pa.string())], ["id", "__text"])
    got = list(inference.inferred(lambda: model, ("parts", "1"), 32, 1, 0)(iter([whole])))
    assert max(b.num_rows for b in got) <= inference.ROWS and max(asked) <= 32
    rows = [r for b in got for r in b.to_pylist()]
    assert [r["id"] for r in rows] == list(range(3000)) and [r["embedding"] for r in rows] == [None if t is None else [float(len(t))] for t in texts]
