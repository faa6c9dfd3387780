import hashlib
import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark import catalog
from quillspark.functions import ids, text
from quillspark.operators import chunking, context, gateway, graph, maintenance, retrieval
from quillspark.plans import pipelines
from quillspark.sources import readers
from quillspark.streaming import events

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(names, data, order):
    at = [names.index(n) for n in order]
    return sorted(tuple(str(r[i]) for i in at) for r in data)


SOME = ["p1_normalise", "p3_identifiers", "p6_tokens", "p8_injection", "p19_mask", "p20_redact", "p21_route", "f1_indexable", "f2_language", "o2_bm25_topk", "o1_dense_topk", "o3_rrf", "a10_summary", "w6_demand", "g1_last_wins", "g2_callers", "x1_dispatch", "k1_upsert", "s5_snapshot_diff"]


@pytest.mark.parametrize("name", SOME)
def test_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rel = duck.execute(catalog.SQL[name])
    names = [x[0] for x in rel.description]
    cols = sorted(df.columns)
    assert sorted(names) == cols
    assert rows(df.columns, df.collect(), cols) == rows(names, rel.fetchall(), cols)


@pytest.mark.parametrize("name", ["a15_findings", "flagship_retrieve", "p25_diff", "t7_push_jobs", "j10_changed_files", "f4_bm25_access", "f5_bm25_then_access", "f4_dense_access", "a14_job_counters", "j6_cache_lookup", "p35_log_record", "a7_a9_per_case", "w4_greedy_callers", "w5_quota"])
def test_more_equal_sql(spark, duck, name):
    test_equals_sql(spark, duck, name)


def test_findings_cover_every_row(spark):
    total = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert sum(r.n for r in catalog.QUERIES["a15_findings"](spark, SF).collect()) == total


def test_findings_are_counted_before_collecting(spark):
    df = spark.range(5000).selectExpr("'f' file", "if(id = 0, null, concat('r', id % 3)) rule_id")
    r = gateway.findings_by_file(df).first()
    assert r.n == 5000 and [tuple(x) for x in r.rules] == [("r0", 1666), ("r1", 1667), ("r2", 1666)]


@pytest.mark.parametrize("name", ["j3_symbols", "f13_jobs"])
def test_whole_tables_equal_sql(spark, duck, name):
    test_equals_sql(spark, duck, name)


def test_symbols_and_jobs_cover_their_tables(spark):
    words = {r.p_name.split(" ")[0].lower() for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    found = {r.keyword for r in catalog.QUERIES["j3_symbols"](spark, SF).collect()}
    assert found == words
    assert catalog.QUERIES["f13_jobs"](spark, SF).count() == spark.read.parquet(f"{SF}/orders.parquet").count()


def test_chunk_ids_are_uuid5(spark):
    df = spark.createDataFrame([("p", "h"), ("q", "h")], "a string, b string").select(ids.chunk_id(F.col("a"), F.col("b")).alias("i"))
    assert [r.i for r in df.collect()] == [str(uuid.uuid5(uuid.NAMESPACE_OID, f"{p}::h")) for p in "pq"]


def test_whitespace_does_not_change_the_hash(spark):
    df = spark.createDataFrame([("a  b\n c ",), ("a b c",)], "t string").select(ids.normalised_hash(F.col("t")).alias("h"))
    assert {r.h for r in df.collect()} == {hashlib.sha256(b"a b c").hexdigest()}


def test_redaction_leaves_plain_code(spark):
    df = spark.createDataFrame([("password: str",), ("password = salt + password",), ('API_KEY = "sk-' + "x" * 40 + '"',)], "t string")
    got = [r.r for r in df.select(text.redact(F.col("t")).alias("r")).collect()]
    assert got[:2] == ["password: str", "password = salt + password"] and "x" * 40 not in got[2]


def test_every_file_has_a_chunk():
    assert chunking.python_chunks("") is None and chunking.python_chunks("def (:") is None
    kinds = [(r[1], r[2], r[5]) for r in chunking.python_chunks(catalog.MODULE)]
    assert kinds == [("function", "area", None), ("class", "Shape", None), ("method", "scale", "Shape"), ("method", "inner", "Shape")]


def test_braces_make_chunks():
    got = [(r[1], r[2], r[3], r[4], r[5]) for r in chunking.brace_chunks(catalog.SCRIPT, "javascript")]
    assert got == [("function", "load", 3, 5, None), ("function", "save", 7, 9, None), ("class", "Store", 11, 17, None), ("method", "constructor", 12, 12, "Store"), ("method", "find", 13, 16, "Store")]
    java = 'import a.b.C;\nclass Box {\n  int size() { return "}".length(); }\n  // void no() {}\n  static <T> T of(T t) throws E {\n    return t;\n  }\n}\n'
    assert [(r[1], r[2], r[5]) for r in chunking.brace_chunks(java, "java")] == [("class", "Box", None), ("method", "size", "Box"), ("method", "of", "Box")]
    go = 'package m\nimport "fmt"\nfunc (b *Box) Size() int {\n\treturn 1\n}\nfunc main() { fmt.Println("{") }\n'
    assert [(r[1], r[2], r[3], r[4]) for r in chunking.brace_chunks(go, "go")] == [("function", "Size", 3, 5), ("function", "main", 6, 6)]
    rust = "use std::io;\nstruct P { x: i32 }\nimpl P {\n  fn x(&self) -> i32 { self.x }\n}\nfn main() {}\n"
    assert [(r[1], r[2], r[5]) for r in chunking.brace_chunks(rust, "rust")] == [("function", "P", None), ("class", "P", None), ("method", "x", "P"), ("function", "main", None)]
    assert chunking.brace_chunks("const x = 1", "typescript") is None and chunking.brace_chunks("SELECT 1", "sql") is None


def test_transcript_without_history(spark):
    df = spark.createDataFrame([(1, []), (2, [("user", "a"), ("assistant", "b")])], "id int, h array<struct<role:string,content:string>>")
    got = {r.id: r.t for r in df.select("id", context.transcript(F.col("h"), F.lit("next")).alias("t")).collect()}
    assert got == {1: "next", 2: context.HISTORY_NOTE + "\n\nUser: a\nAssistant: b\nUser: next\nAssistant:"}


def test_signatures(spark):
    assert [r.valid for r in catalog.QUERIES["p17_signature"](spark, SF).orderBy("id").collect()] == [True, False, True, False]


def test_dense_in_blocks_of_queries(spark, monkeypatch):
    """More queries than are broadcast at once give the same lists; odd vectors score 0."""
    whole = sorted(map(tuple, catalog.QUERIES["o1_dense_topk"](spark, SF).collect()))
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 3)
    assert sorted(map(tuple, catalog.QUERIES["o1_dense_topk"](spark, SF).collect())) == whole
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [3.0, 4.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(9, [2.0, 0.0]), (1, [1.0, 0.0])], "query_id long, vector array<double>")
    got = {(r.query_id, r.id): round(r.score, 6) for r in retrieval.dense(v, q, 20, None).collect()}
    assert got == {(9, 1): 1.0, (9, 2): 0.0, (9, 3): 0.0, (9, 4): 0.0, (9, 5): 0.6, (1, 2): 0.0, (1, 3): 0.0, (1, 4): 0.0, (1, 5): 0.6}


def test_wrong_project_or_role_sees_nothing(spark):
    docs = catalog.chunks(spark, SF)
    q = spark.createDataFrame([(1, docs.first().text[:200], ["nowhere"], ["developer"]), (2, docs.first().text[:200], ["src0"], ["nobody"])], "query_id long, query string, projects array<string>, roles array<string>")
    assert retrieval.bm25(docs, q, access=True).count() == retrieval.bm25_then_access(docs, q).count() == 0


def test_index_build_and_sources(spark, tmp_path):
    """A tree with a file that is not UTF-8 is read, chunked and embedded; edges and logs round-trip."""
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / "geo.py").write_text(catalog.MODULE)
    (tmp_path / "tree" / "app.js").write_text(catalog.SCRIPT)
    (tmp_path / "tree" / "bad.py").write_bytes(b"x = '\xff\xfe'\n")
    (tmp_path / "tree" / "skip.lock").write_text("no")
    tree = readers.file_tree(spark, str(tmp_path / "tree"))
    assert tree.count() == 4 and any("\ufffd" in r.content for r in tree.collect())
    chunks, edges = pipelines.build_index(spark, tree, "p", "r")
    names = {r.node_name for r in chunks.collect()}
    assert {"area", "Shape", "scale", "load", "save", "Store", "find"} <= names
    assert chunks.where("size(embedding) = 0").count() == 0 and edges.count() > 0
    readers.write_edges(edges.withColumn("project_id", F.lit("p")), str(tmp_path / "edges"))
    readers.write_edges(edges.limit(1).withColumn("project_id", F.lit("q")), str(tmp_path / "edges"))
    assert readers.edges(spark, str(tmp_path / "edges"), "p").count() == edges.count()
    log = spark.createDataFrame([("t", "chat", "s", "p", 3, "m", "FAST", 0.5)], readers.AUDIT)
    for _ in range(2):
        readers.append_audit(log, str(tmp_path / "audit"))
    assert readers.audit_log(spark, str(tmp_path / "audit")).count() == 2
    cases = spark.createDataFrame([("q", ["a"], None, "c", "p", None)], readers.CASE)
    readers.write_cases(cases, str(tmp_path / "cases"))
    assert readers.cases(spark, str(tmp_path / "cases")).first().expected_chunk_ids == ["a"]


def greedy(notes, budget):
    left, taken = budget, []
    for o, n in sorted(notes):
        if n <= left:
            left, taken = left - n, [*taken, o]
    return taken, left


def test_greedy_callers_over_all_events(spark):
    by = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").collect():
        by.setdefault(r.user_id, []).append((r.event_id, r.event_id * 37 % 300 + 1))
    got = {r.query_id: (r.taken, r.left) for r in catalog.QUERIES["w4_greedy_callers"](spark, SF).collect()}
    assert got == {q: greedy(notes, 400) for q, notes in by.items()} and max(map(len, by.values())) > 4


def test_greedy_callers_of_a_hot_query(spark):
    rows = [(1, i, 1 + i * 7919 % 90) for i in range(5000)] + [(2, i, 1) for i in range(600)] + [(3, 0, 999), (4, 1, 0), (4, 0, 400), (5, 0, 300), (5, 1, 200), (5, 2, 100)]
    df = spark.createDataFrame(rows, "query_id long, ord int, tokens int")
    got = {r.query_id: (r.taken, r.left) for r in context.greedy_callers(df, 400).collect()}
    assert got == {q: greedy([x[1:] for x in rows if x[0] == q], 400) for q in range(1, 6)}


def test_unknown_node_has_no_callers(spark):
    e = spark.createDataFrame([("a", "b")], "src string, dst string")
    assert graph.callers(e, spark.createDataFrame([("q",)], "node string")).count() == 0


@pytest.mark.parametrize("depth, reached", [(8, 8), (99, 104)])
def test_closure_of_a_long_chain(spark, depth, reached):
    rows = [(f"n{i + 1}", f"n{i}") for i in range(104)] + [("n0", "n104")]
    got = graph.callers(spark.createDataFrame(rows, "src string, dst string"), spark.createDataFrame([("n0",)], "node string"), depth).collect()
    assert sorted((r.node, r.depth) for r in got) == sorted((f"n{i}", i) for i in range(1, reached + 1))


def test_ancestors_query_has_no_depth_limit(spark, monkeypatch):
    chain = [(f"k{i:02}", f"k{i - 1:02}" if i else "c") for i in range(12)]
    monkeypatch.setattr(catalog, "RING", chain)
    assert sorted(r.depth for r in catalog.QUERIES["a17_ancestors"](spark, SF).collect()) == list(range(1, 13))


def test_ancestors_equal_sql(spark, duck):
    test_equals_sql(spark, duck, "a17_ancestors")


def test_dedup_keeps_the_first(spark):
    df = spark.createDataFrame([("h", 2), ("h", 1), ("g", 3)], "hash string, ord int")
    assert sorted(r.ord for r in maintenance.dedup_first(df, "hash", "ord").collect()) == [1, 3]


def test_quota_against_a_deque(spark):
    got = {r.event_id: r.admitted for r in catalog.QUERIES["w5_quota"](spark, SF).collect()}
    kept, want = {}, {}
    for r in spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id").collect():
        k = [t for t in kept.get(r.user_id, []) if (r.ts - t).total_seconds() <= 86400]
        want[r.event_id] = len(k) < 3
        kept[r.user_id] = [*k, r.ts] if want[r.event_id] else k
    assert got == want and not all(want.values())


def test_quota_of_one_hot_user(spark):
    """A user with a million requests, silent now and then: its stretches are folded in several tasks."""
    micros = F.expr("timestamp_micros(id * 1000000 + (id div 10000) * 61000001)")
    df = spark.range(1_000_000).select(F.lit(7).alias("user_id"), F.col("id").alias("event_id"), micros.alias("ts"))
    got = gateway.admitted(df, 30, 60)
    per = got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.count_if("admitted").alias("ok")).collect()
    assert len(per) > 1 and sum(r.n for r in per) == 1_000_000 and max(r.n for r in per) < 700_000
    one = sum(1 for k in range(10000) if k % 61 < 30)  # of each stretch: 30, then none until the first is 60 s old
    assert sum(r.ok for r in per) == 100 * one


def test_quota_segments(spark):
    rows = [(1, 0), (1, 60), (1, 120), (1, 181), (1, 182), (2, 5), (None, 1), (None, 100), (1, -200)]
    df = spark.createDataFrame([(k, t * 1_000_000) for k, t in rows], "user_id long, micros long")
    got = sorted(((r.user_id, r.micros // 1_000_000, r.segment) for r in gateway.segments(df, 60, "user_id").collect()), key=str)
    assert got == sorted([(1, -200, 0), (1, 0, 1), (1, 60, 1), (1, 120, 1), (1, 181, 2), (1, 182, 2), (2, 5, 0), (None, 1, 0), (None, 100, 1)], key=str)


def test_live_counters(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{SF}/events.parquet").write.mode("overwrite").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    q = events.live_counters(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) s from live").first().s == 1000


def test_streamed_quota_equals_the_batch(spark, tmp_path):
    source = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in")).select("user_id", "event_id", "ts")
    q = events.admitted(stream, 3, 86400).writeStream.format("memory").queryName("quota").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    want = {(r.event_id, r.admitted) for r in catalog.QUERIES["w5_quota"](spark, SF).collect()}
    assert {(r.event_id, r.admitted) for r in spark.sql("select event_id, admitted from quota").collect()} == want


def test_streamed_memory_keeps_the_last_turns(spark, tmp_path):
    source = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    source.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = events.session_memory(spark.readStream.schema(source.schema).parquet(str(tmp_path / "in")), 2).writeStream.format("memory").queryName("memory").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    want = {(r.conv_id, min(2, r.n), r.last) for r in source.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("turn").alias("last")).collect()}
    assert {(r.conv_id, r.turns, r.last_turn) for r in spark.sql("select * from memory").collect()} == want


def test_delta_writer_replaces_files(spark):
    held = [spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "file_path string, n int")]
    run = events.delta_writer(lambda: held[-1], lambda df: held.append(spark.createDataFrame(df.collect(), df.schema)))
    run(spark.createDataFrame([("a", 7, 1, False), ("a", 8, 2, False), ("b", 0, 1, True), ("d", 9, 1, False)], "file_path string, n int, ts int, removed boolean"), 0)
    assert sorted(map(tuple, held[-1].collect())) == [("a", 8), ("c", 3), ("d", 9)]
