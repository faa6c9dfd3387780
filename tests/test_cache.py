"""The semantic cache: lookup in groups against a plain walk, and as state with a time to live."""

import datetime
import math
import random

import duckdb
import pytest

from quillspark import catalog
from quillspark.operators import cache, graph
from quillspark.streaming import cache as state

SF = "/root/testdata/sf0.001"
DAY = datetime.datetime(2024, 1, 1)
ENTRY = "rbac_hash string, query_embedding array<double>, result long, expires_at timestamp"
ASKED = "query_id long, user_id string, projects array<string>, vector array<double>, now timestamp"


def cos(a, b):
    if a is None or b is None or len(a) != len(b) or any(x is None or not math.isfinite(x) for x in [*a, *b]):
        return None
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return round(sum(x * y for x, y in zip(a, b)) / n, 9) if n else None


def vectors(rng, n):
    odd = [None, [], [0.0, 0.0, 0.0], [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0], [1.0, 2.0]]
    return [rng.choice(odd) if rng.random() < 0.1 else [float(rng.randrange(-3, 4)) for _ in range(3)] for _ in range(n)]


@pytest.mark.parametrize("block", [7, 4096])
def test_lookup_equals_a_walk(spark, block):
    """One hash holds most rows; equal entries, ties, odd vectors and ends at the very time of a request."""
    rng = random.Random(block)
    at = lambda: DAY + datetime.timedelta(minutes=rng.randrange(5))
    user = lambda: "hot" if rng.random() < 0.8 else f"u{rng.randrange(3)}"
    entries = [(user(), v, rng.randrange(60), at()) for v in vectors(rng, 200)]
    asked = [(i, user(), ["p"], v, at()) for i, v in enumerate(vectors(rng, 80))]
    hashes = {r[0]: r[1] for r in spark.createDataFrame([(u,) for u in ("hot", "u0", "u1", "u2")], "u string").selectExpr("u", "substr(sha2(concat(u, ':', 'p'), 256), 1, 16)").collect()}
    rows = spark.createDataFrame([(hashes[u], v, r, e) for u, v, r, e in entries + entries[:20]], ENTRY)
    want = {}
    for i, u, _, v, now in asked:
        near = [(-s, r) for eu, ev, r, e in entries if eu == u and e > now and (s := cos(v, ev)) is not None and s >= 0.9]
        if near:
            want[i] = min(near)[1]
    requests = spark.createDataFrame(asked + asked[:5], ASKED)
    assert {r.query_id: r.result for r in cache.cache_lookup(rows, requests, 0.9, block).collect()} == want and want
    assert cache.cache_lookup(rows.limit(0), requests).count() == 0 and cache.cache_lookup(rows, requests.limit(0)).count() == 0


def test_frequent_names_are_dealt(spark):
    edges = spark.createDataFrame([("p", f"s{n}", "a.get") for n in range(50)] * 2 + [("q", "s1", "get"), ("q", "s1", "x.put"), ("p", None, "get")], "project_id string, src string, dst string")
    nodes = spark.createDataFrame([("p", "get", "1"), ("p", "get", "2"), ("p", "get", "2"), ("q", "get", "3"), ("p", "put", "4")], "project_id string, node_name string, fqn string")
    got = sorted(tuple(r) for r in graph.resolve(edges, nodes, 7).collect())
    assert got == sorted([("p", f"s{n}", f) for n in range(50) for f in "12"] + [("q", "s1", "3")])


def put(id_, minute, vector, who="h"):
    return ("put", who, id_, DAY + datetime.timedelta(minutes=minute), vector, f"answer {id_}")


def ask(id_, minute, vector, who="h"):
    return ("ask", who, id_, DAY + datetime.timedelta(minutes=minute), vector, None)


def take(spark, folder, rows, salts=2):
    spark.createDataFrame(rows, state.SAID).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(state.SAID).parquet(f"{folder}/in")
    q = state.run(state.hits(stream, 3600, salts=salts), f"{folder}/out", f"{folder}/c")
    q.awaitTermination()
    return {r.id: r.result for r in state.answers(spark, f"{folder}/out").collect()}, q.recentProgress[-1].stateOperators[0].numRowsTotal


def test_entries_expire_and_leave_the_state(spark, tmp_path):
    a, b, c = [1.0, 0.0], [0.0, 1.0], [1.0, 0.01]
    rows = [put(f"e{n}", 0, a) for n in range(40)] + [put("z", 5, b), ask("q1", 0, a), ask("q2", 1, c), ask("q3", 1, [-1.0, 0.0]), ask("q4", 1, a, "other"), ask("q5", 4, b)]
    hits, held = take(spark, tmp_path, rows)
    assert hits == {"q1": "answer e0", "q2": "answer e0"}
    assert held >= 41
    hits, _ = take(spark, tmp_path, [ask("q6", 59.9, a), ask("q7", 60, a), ask("q8", 64.9, b), ask("q9", 65, b), put("y", 62, c)])
    assert {k: v for k, v in hits.items() if k > "q5"} == {"q6": "answer e0", "q8": "answer z"}
    hits, left = take(spark, tmp_path, [ask("q10", 100, a), ask("late", 2, a)])
    assert hits["q10"] == "answer y" and "late" not in hits
    assert left < held - 35  # what ended has gone
    hits, left = take(spark, tmp_path, [ask("q11", 500, a)])
    assert "q11" not in hits and left <= 2


def test_the_stream_equals_the_batch(spark):
    duck = duckdb.connect()
    duck.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    want = sorted(duck.execute(catalog.SQL["x4_cache_stream"]).fetchall())
    assert sorted(map(tuple, catalog.QUERIES["x4_cache_stream"](spark, SF).collect())) == want and len(want) > 5


@pytest.mark.parametrize("name", ["j6_cache_lookup", "g7_resolved_calls", "k6_cache_write"])
def test_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("embeddings", "lineitem", "part"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = duck.execute(catalog.SQL[name])
    cols = [c[0] for c in rel.description]
    assert sorted(map(str, rel.fetchall())) == sorted(str(tuple(r)) for r in catalog.QUERIES[name](spark, SF).select(*cols).collect())
