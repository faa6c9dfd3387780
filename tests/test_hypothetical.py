"""Hypothetical snippets: what is embedded for a query, and that the other lists still ask for the query."""

import duckdb
from pyspark.sql import functions as F

from quillspark import catalog
from quillspark.functions import inference
from quillspark.functions.embed import hashing_embedding
from quillspark.plans import pipelines

SF = "/root/testdata/sf0.001"


def writer():
    def write(prompt):
        if "broken" in prompt:
            raise ConnectionError("no answer")
        return {"blank": " \n\t", "none": None}.get(prompt, f"  said {prompt} \n")

    return write


def test_failures_and_blanks_are_null(spark):
    said = spark.createDataFrame([("a",), ("broken",), ("blank",), ("none",), (None,), ("",)], "p string")
    got = [tuple(r) for r in said.select("p", inference.generated(F.col("p"), writer).alias("s")).collect()]
    assert got == [("a", "said a"), ("broken", None), ("blank", None), ("none", None), (None, None), ("", "said")]
    assert said.limit(0).select(inference.generated(F.col("p"), writer)).count() == 0


def test_the_snippet_moves_the_dense_list_only(spark):
    texts = ["open socket listen accept", "parse config file reader", "merge sorted arrays quickly", "unrelated gardening notes"]
    rows = [(n, t, "p", ["developer"], f"f{n}.py", 1, 9, "c", "r", "x", "python") for n, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "chunk_id long, content string, project_id string, allowed_roles array<string>, file_path string, start_line int, end_line int, commit_hash string, repository_name string, node_name string, language string")
    chunks = chunks.withColumn("embedding", hashing_embedding(F.col("content")))
    ask = spark.createDataFrame([(1, "gardening", ["p"], ["developer"])], "query_id long, query string, projects array<string>, roles array<string>")

    def files(queries):
        r = pipelines.retrieve(queries, chunks).first()
        return [] if r is None else sorted(s["file_path"] for s in r.sources)

    assert files(ask.withColumn("query", F.lit("zzz"))) == []
    written = ask.withColumn("hypothetical", F.lit("parse config file reader"))
    assert files(written) == ["f1.py", "f3.py"]  # the snippet's chunk by its vector, the query's by its words
    for nothing in (F.lit(None).cast("string"), F.lit("")):
        assert files(ask.withColumn("hypothetical", nothing)) == files(ask)


def test_equals_sql(spark):
    duck = duckdb.connect()
    for t in ("benchmark", "documents"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = duck.execute(catalog.SQL["p5_hypothetical"])
    cols = [c[0] for c in rel.description]
    got = [tuple(r) for r in catalog.QUERIES["p5_hypothetical"](spark, SF).select(*cols).collect()]
    assert sorted(rel.fetchall()) == sorted(got)
    assert 0 < sum(r[1] for r in got) < len(got)
