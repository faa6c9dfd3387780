"""The stored collection: bounds of its codes, pruning, and the same answers as a search over all vectors."""

import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import collection, maintenance, retrieval


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x = collection.unit([*(rng.normal(size=48) * rng.choice([1e-9, 1, 1e9]) for _ in range(400)), np.eye(48)[3], np.zeros(48)])
    q = collection.unit(list(rng.normal(size=(50, 48))))
    codes, scale, error = collection.coded(x)
    near = (q @ codes.astype(float).T) * scale
    assert (np.abs(q @ x.T - near) <= error + 1e-12).all()
    assert error.max() < 0.03 and error[-1] == 0


@pytest.fixture(scope="module")
def held(spark, tmp_path_factory):
    rng = np.random.default_rng(2)
    rows = [(i, f"p{i % 3}", str(1 + i % 2), [float(c) for c in rng.normal(size=24)]) for i in range(3000)]
    rows += [(3000, "p0", "1", None), (3001, "p0", "1", [0.0] * 24), (3002, "p0", "1", [1.0]), (3003, "p0", "1", rows[0][3]), (3004, "p0", "1", [2 * c for c in rows[0][3]])]
    v = spark.createDataFrame(rows, "vec_id long, project_id string, model_version string, embedding array<double>")
    where = str(tmp_path_factory.mktemp("c") / "vectors")
    collection.write_collection(v, where)
    queries = v.where("vec_id % 300 = 0 and vec_id <= 3000").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return v, where, queries


def found(df):
    return sorted((r.query_id, r.rank, r.id, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("threshold", [0.2, -2.0])
def test_equals_a_search_over_all_vectors(spark, held, threshold):
    v, where, queries = held
    of = collection.open_collection(spark, where, ["p0", "p2"], "1")
    want = retrieval.dense(v.where("project_id <> 'p1' and model_version = '1'"), queries, 15, threshold)
    assert found(collection.search(of, queries, 15, threshold)) == found(want)


def test_groups_of_queries(spark, held, monkeypatch):
    v, where, queries = held
    monkeypatch.setattr(collection, "QUERY_BYTES", 600)
    monkeypatch.setattr(collection, "STEP", 100)
    of = collection.open_collection(spark, where, ["p0"], "1")
    assert found(collection.search(of, queries, 5, 0.1, own=True)) == found(retrieval.dense(v.where("project_id = 'p0' and model_version = '1'"), queries, 5, 0.1, own=True))


def test_few_pairs_are_scored_exactly(spark, held):
    _, where, queries = held
    of = collection.open_collection(spark, where, ["p0", "p1", "p2"], "1")
    asked = queries.where("vector is not null")
    assert asked.count() * 10 <= collection.candidates(of, asked, 10, -1.0).count() <= 0.02 * asked.count() * of.count()
    nothing = queries.where("vector is null")  # all rows score 0
    assert nothing.count() == 1 and collection.candidates(of, nothing, 10, -1.0).count() < of.count() / 2


def test_other_partitions_and_the_vectors_are_not_read(spark, held, tmp_path):
    _, where, queries = held
    copy = str(tmp_path / "copy")
    shutil.copytree(where, copy)
    want = found(collection.search(collection.open_collection(spark, copy, ["p1"], "2"), queries, 5, 0.0))
    of = collection.open_collection(spark, copy, ["p1"], "2")
    for folder, _, files in os.walk(copy):
        if "=" in folder and not folder.endswith("project_id=p1/model_version=2"):
            for f in files:
                os.truncate(f"{folder}/{f}", 0)
    assert want and found(collection.search(of, queries, 5, 0.0)) == want
    plan = collection.candidates(of, queries, 5, 0.0)._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan") :]
    assert "PartitionFilters: [" in scan and "vector#" not in scan[: scan.index("Batched")]


def test_one_version_is_dropped(spark, held, tmp_path):
    v, where, _ = held
    copy = str(tmp_path / "copy")
    shutil.copytree(where, copy)
    files = {f"{d}/{f}" for d, _, names in os.walk(copy) for f in names}
    assert collection.drop_version(spark, copy, "p1", "2") and not collection.drop_version(spark, copy, "p1", "2")
    left = {f"{d}/{f}" for d, _, names in os.walk(copy) for f in names}
    assert left == {f for f in files if "project_id=p1/model_version=2" not in f}
    want = maintenance.purge(v, "p1", "2").groupBy("project_id", "model_version").count()
    got = spark.read.parquet(copy).select("project_id", F.col("model_version").cast("string")).groupBy("project_id", "model_version").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_pairs_at_once_do_not_grow_with_queries(spark, tmp_path, monkeypatch):
    """2048 rows were scored at once against however many queries there were."""
    assert all(collection.step(n) * n <= collection.PAIRS for n in (1, 200, 12_000, 130_000))
    monkeypatch.setattr(collection, "PAIRS", 40)
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").withColumns({"project_id": F.lit("p"), "model_version": F.lit("1")})
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    collection.write_collection(e, str(tmp_path / "c"))
    held = collection.open_collection(spark, str(tmp_path / "c"), ["p"], "1")
    rows = lambda df: sorted((r.query_id, r.rank, r.id, round(r.score, 6)) for r in df.collect())
    assert rows(collection.search(held, queries, 5, 0.2)) == rows(retrieval.dense(e, queries, 5, 0.2))
