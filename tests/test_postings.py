"""The stored index against plain BM25."""

import random
import shutil
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark import catalog
from quillspark.functions import text, tokens
from quillspark.operators import postings, retrieval

SF = "/root/testdata/sf0.001"


def found(df):
    return sorted((r.query_id, r.rank, r.id, round(r.score, 6)) for r in df.collect())


def words(rng, n):
    return " ".join(rng.choices([f"word{i}" for i in range(300)], [1 / (i + 1) for i in range(300)], k=n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(f"d{i}", words(rng, rng.randint(1, 80))) for i in range(900)] + [("empty", ""), ("null", None)], "doc_id string, text string")
    queries = spark.createDataFrame([(i, words(rng, rng.randint(1, 12))) for i in range(30)] + [(98, "nowhere"), (99, None)], "query_id long, query string")
    return docs, queries


def test_equals_plain_bm25(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    queries = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    postings.write_index(docs, str(tmp_path / "i"))
    assert found(postings.search(spark, str(tmp_path / "i"), queries, 7)) == found(retrieval.bm25(docs, queries, k=7))


def test_many_ranges_and_groups_of_queries(spark, tmp_path, corpus, monkeypatch):
    docs, queries = corpus
    monkeypatch.setattr(postings, "RANGE", 16)
    monkeypatch.setattr(postings, "ASKS", 40)
    postings.write_index(docs, str(tmp_path / "i"))
    assert found(postings.search(spark, str(tmp_path / "i"), queries, 4)) == found(retrieval.bm25(docs, queries, k=4))


def test_only_buckets_of_asked_terms_are_read(spark, tmp_path, corpus):
    docs, _ = corpus
    where = tmp_path / "i"
    postings.write_index(docs, str(where))
    query = spark.createDataFrame([(1, "word7 word200")], "query_id long, query string")
    want = found(postings.search(spark, str(where), query))
    asked = {r[0] for r in spark.createDataFrame([("word7",), ("word200",)], "t string").select(postings.bucket_of(F.col("t"))).collect()}
    for folder in (where / "blocks").glob("bucket=*"):
        if int(folder.name.split("=")[1]) not in asked:
            shutil.rmtree(folder)
    assert want and found(postings.search(spark, str(where), query)) == want


def test_blocks_under_the_kth_score_stay_closed(spark, tmp_path, corpus, monkeypatch):
    docs, _ = corpus
    monkeypatch.setattr(postings, "RANGE", 32)
    rare = spark.createDataFrame([(f"r{i}", "zebra quokka " * 3 + "word1") for i in range(4)], "doc_id string, text string")
    docs = docs.union(rare)
    postings.write_index(docs, str(tmp_path / "i"))
    query = spark.createDataFrame([(1, "zebra quokka word1 word2 word3")], "query_id long, query string")
    idf = {r.term: r.idf for r in spark.read.parquet(str(tmp_path / "i" / "terms")).collect()}
    asks = {t: ([0], idf[t]) for t in ("zebra", "quokka", "word1", "word2", "word3")}
    rows = spark.read.parquet(str(tmp_path / "i" / "blocks")).where(F.col("term").isin(list(asks))).select("range", "term", "top", "id", "part")
    whole = spark.read.parquet(str(tmp_path / "i" / "ranges")).select("range", F.lit("").alias("term"), F.lit(0.0).alias("top"), "id", F.lit(None).cast("array<double>").alias("part"))
    # ranges that hold the rare terms first
    first = [r[0] for r in rows.where("term = 'zebra'").select("range").distinct().collect()]
    table = rows.union(whole).orderBy((~F.col("range").isin(first)).cast("int"), "range", "term").toArrow()
    lazy, eager = postings.Scorer(asks, 1, 4), postings.Scorer(asks, 1, 4)
    for ids, blocks in postings.ranges_of(table.combine_chunks().to_batches()):
        lazy.take(ids, blocks)
        eager.floor[:] = -float("inf")
        eager.take(ids, blocks)
    assert lazy.best == eager.best and eager.closed == 0
    # nothing is opened but the ranges that hold the rare terms
    assert lazy.opened == rows.where(F.col("range").isin(first)).count() and lazy.opened + lazy.closed == eager.opened
    assert lazy.opened < 0.25 * eager.opened
    assert found(postings.search(spark, str(tmp_path / "i"), query, 4)) == found(retrieval.bm25(docs, query, k=4))


def test_negative_weights(spark, tmp_path):
    """Terms that all documents hold weigh less than nothing; nothing is skipped wrongly."""
    docs = spark.createDataFrame([(i, "same words " + ("same " * (i % 4)) + ("odd" if i < 3 else "")) for i in range(20)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "same odd"), (2, "words")], "query_id long, query string")
    postings.write_index(docs, str(tmp_path / "i"))
    assert found(postings.search(spark, str(tmp_path / "i"), queries, 3)) == found(retrieval.bm25(docs, queries, k=3))


def test_empty_corpus(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    postings.write_index(docs, str(tmp_path / "i"))
    assert postings.search(spark, str(tmp_path / "i"), spark.createDataFrame([(1, "a word")], "query_id long, query string")).count() == 0


def test_many_queries_are_scored_together(spark, tmp_path, corpus, monkeypatch):
    """every 200,000 asked terms were a shuffle of all blocks; now queries go out in larger groups and are scored together."""
    docs, queries = corpus
    monkeypatch.setattr(postings, "FEW", 2)
    monkeypatch.setattr(postings, "TOGETHER", 7)
    monkeypatch.setattr(postings, "RANGE", 64)
    assert postings.ASKS >= 1_000_000
    postings.write_index(docs, str(tmp_path / "i"))
    assert found(postings.search(spark, str(tmp_path / "i"), queries, 5)) == found(retrieval.bm25(docs, queries, k=5))


def test_rows_that_repeat_an_id_are_one_document(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox"), (1, "red hen hen"), (None, "red owl"), (2, ""), (3, None), (4, "blue")], "doc_id long, text string")
    postings.write_index(docs, str(tmp_path / "i"))
    ids = [i for r in spark.read.parquet(str(tmp_path / "i" / "ranges")).collect() for i in r["id"]]
    assert sorted(ids, key=str) == [1, 2, 4, None]
    assert {r.term: r.df for r in spark.read.parquet(str(tmp_path / "i" / "terms")).collect()} == {"red": 2, "fox": 1, "hen": 1, "owl": 1, "blue": 1}


def test_access_after_ranking_asks_the_index(spark, monkeypatch):
    """F8: every call counted the terms of all documents anew."""
    want = found(retrieval.bm25_then_access(catalog.chunks(spark, SF), catalog.requests(spark, SF)))
    monkeypatch.setattr(retrieval, "bm25", None)
    assert found(catalog.QUERIES["f5_bm25_then_access"](spark, SF)) == want


def test_tokens_by_bytes_are_those_of_the_expression(spark):
    """the index ran the token expression twice over every text; it cuts bytes now."""
    rng = random.Random(5)
    texts = ["".join(rng.choices("aBc1_ é9Z.中\n0x", k=rng.randint(0, 40))) for _ in range(400)] + ["", "9", "9a", "a", "ab", "HTTPServer get_X2 3d4"]
    want = [r.t for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, s string").orderBy("i").select(text.tokens(F.col("s")).alias("t")).collect()]
    for start in (0, 7):
        names, codes, count = tokens.coded_tokens(pa.array(texts)[start:])
        flat = iter(names.take(pa.array(codes)).to_pylist())
        assert [[next(flat) for _ in range(n)] for n in count.tolist()] == want[start:]
        assert tokens.token_counts(pa.array(texts)[start:]).tolist() == count.tolist()


def test_index_is_written_in_one_pass_without_the_expression(spark, tmp_path, corpus, monkeypatch):
    """postings were written, read and written again, by array expressions."""
    docs, queries = corpus
    monkeypatch.setattr(postings, "RANGE", 16)
    with monkeypatch.context() as m:
        m.setattr(text, "tokens", None)
        postings.write_index(docs, str(tmp_path / "i"))
    rows = spark.read.parquet(str(tmp_path / "i" / "blocks"))
    assert rows.where("df <> size(id) or df <> size(part) or top <> array_max(part)").count() == 0
    assert found(postings.search(spark, str(tmp_path / "i"), queries, 4)) == found(retrieval.bm25(docs, queries, k=4))


def test_of_rows_that_repeat_an_id_the_longest_counts(spark, tmp_path):
    for n, texts in enumerate((["red fox", "red hen hen"], ["red hen hen", "red fox"])):
        postings.write_index(spark.createDataFrame([(1, t) for t in texts] + [(2, "blue red")], "doc_id long, text string").coalesce(1), str(tmp_path / str(n)))
    parts = [sorted((r.term, *r.part) for r in spark.read.parquet(str(tmp_path / n / "blocks")).where("id[0] = 1").collect()) for n in "01"]
    assert parts[0] == parts[1]


def test_reranking_joins_texts_with_few_candidates(spark):
    """e2_rerank shuffled all texts to join them with the 20 best of each query."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.QUERIES["e2_rerank"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("few", [2, 16])
def test_access_holds_before_ranking_in_the_index(spark, tmp_path, corpus, monkeypatch, few):
    """F16: BM25 under access rules counted the terms of all documents anew, and joined all postings with all queries."""
    docs, queries = corpus
    monkeypatch.setattr(postings, "FEW", few)
    monkeypatch.setattr(postings, "RANGE", 64)
    n = F.pmod(F.hash("doc_id"), F.lit(20))
    docs = docs.withColumns({"project_id": F.when(n != 7, F.concat(F.lit("p"), (n % 3).cast("string"))), "allowed_roles": F.when(n > 2, F.array(F.concat(F.lit("r"), n.cast("string")), F.lit("all")))})
    asks = queries.withColumns({"projects": F.when(F.col("query_id") != 4, F.array(F.lit("p0"), F.concat(F.lit("p"), (F.col("query_id") % 3).cast("string")))), "roles": F.when(F.col("query_id") % 2 == 0, F.array(F.lit("all"))).otherwise(F.array(F.lit("r9"), F.lit("r11")))})
    postings.write_index(docs, str(tmp_path / "i"))
    want = found(retrieval.bm25(docs, asks, k=4, access=True))
    assert want and found(postings.search(spark, str(tmp_path / "i"), asks, 4, access=True)) == want


def test_ranking_under_access_asks_the_index(spark, monkeypatch):
    """F16 and F10: both queries tokenised all documents by expressions."""
    rows = lambda name: sorted(catalog.QUERIES[name](spark, SF).collect(), key=str)
    want = found(retrieval.bm25(catalog.chunks(spark, SF), catalog.requests(spark, SF), access=True))
    monkeypatch.setattr(retrieval, "bm25", None)
    assert found(catalog.QUERIES["f4_bm25_access"](spark, SF)) == want
    assert rows("flagship_retrieve")


def test_index_is_dealt_by_bytes_and_cores(spark, tmp_path, corpus, monkeypatch):
    """the index had as many tasks as other shuffles have partitions, each with a file for every bucket and its own row of a term."""
    docs, queries = corpus
    monkeypatch.setattr(postings, "RANGE", 40)
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "90")
    try:
        postings.write_index(docs, str(tmp_path / "i"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    cores = spark.sparkContext.defaultParallelism
    assert spark.read.parquet(str(tmp_path / "i" / "ranges")).count() <= -(-docs.count() // 40) + cores
    assert len(list((tmp_path / "i" / "blocks").glob("bucket=*/*.parquet"))) <= cores * postings.BUCKETS
    assert found(postings.search(spark, str(tmp_path / "i"), queries, 4)) == found(retrieval.bm25(docs, queries, k=4))
    monkeypatch.undo()
    # of 6 GB and more no task has more than its bytes, and all have as many ranges
    parts, ranges = postings.dealt_to(3_000_000, 11 << 30, 12)
    assert parts % 12 == 0 and ranges % parts == 0 and (11 << 30) / parts <= postings.TEXTS and 3_000_000 / ranges <= postings.RANGE


def test_documents_of_a_range_are_looked_up_once(monkeypatch):
    """each block of a range made a table of all documents of the range."""
    calls, looked = [], postings.pc.index_in
    monkeypatch.setattr(postings.pc, "index_in", lambda *a, **k: calls.append(1) or looked(*a, **k))
    rng = random.Random(9)
    ids = pa.array([f"d{i:03}" for i in range(200)])
    blocks = []
    for t in range(40):
        at = sorted(rng.sample(range(200), rng.choice([1, 3, 90])))
        part = [rng.random() for _ in at]
        blocks.append((f"t{t}", max(part), ids.take(pa.array(at)), pa.array(part)))
    asks = {f"t{t}": (sorted(rng.sample(range(30), 12)), 1.0 + t) for t in range(40)}
    together, apart = postings.Scorer(asks, 30, 5), postings.Scorer(asks, 30, 5)
    together.take(ids, blocks)
    assert len(calls) == 1
    monkeypatch.setattr(postings, "FEW", 30)
    apart.take(ids, blocks)
    assert [[r[:2] for r in q] for q in together.best] == [[r[:2] for r in q] for q in apart.best]


@pytest.mark.parametrize("low", [0.5, -1.0])
def test_few_documents_are_scored_exactly(monkeypatch, low):
    """F1: questions were multiplied with all frequent terms in doubles, 512 at once; now rows are added in single precision, and only
    what can be among the k best is scored exactly, so that scores which single precision cannot tell apart stay in order."""
    rng = random.Random(11)
    ids = pa.array([f"d{i:04}" for i in range(3001)])
    blocks, asks = [], {}
    for t in range(300):
        at = sorted(rng.sample(range(3001), rng.choice([1, 20, 150, 400, 2400])))
        part = [1 + 1e-8 * rng.randrange(20) if t % 2 else rng.random() for _ in at]
        blocks.append((f"t{t:03}", max(part), ids.take(pa.array(at)), pa.array(part)))
        asks[f"t{t:03}"] = (sorted(rng.sample(range(600), 40)), rng.uniform(low, 3.0) if t % 3 else 1.0)
    together, apart = postings.Scorer(asks, 600, 4), postings.Scorer(asks, 600, 4)
    tracemalloc.start()
    together.take(ids, blocks)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    monkeypatch.setattr(postings, "FEW", 600)
    apart.take(ids, blocks)
    assert [[r[:2] for r in q] for q in together.best] == [[r[:2] for r in q] for q in apart.best]
    assert apart.looked == 0 and 600 * 4 <= together.looked < 0.01 * 600 * 3001
    assert most < 14 << 20  # with 512 questions at once in doubles 12 MB for their sums alone


def test_many_queries_with_negative_weights(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "FEW", 1)
    docs = spark.createDataFrame([(i, "same words " + ("same " * (i % 4)) + ("odd" if i < 3 else "")) for i in range(20)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "same odd"), (2, "words"), (3, "odd"), (4, "same words")], "query_id long, query string")
    postings.write_index(docs, str(tmp_path / "i"))
    assert found(postings.search(spark, str(tmp_path / "i"), queries, 3)) == found(retrieval.bm25(docs, queries, k=3))
