"""The queries of the llm operators, with their production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, embedding_dedup, hard_negatives, lexical, licenses, media, near_dedup, packing, secrets, sharding, token_counts, toxicity, vector_search
from .shared import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), lexicon)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), F.col("score_hits").alias("n_terms"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=16)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.length_histogram(token_counts.count_tokens(table(spark, sf_dir, "documents"), RANKS)))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = media.write_archives(table(spark, sf_dir, "documents"))
    got = media.features(media.read_archives(spark, folder))
    size = F.octet_length("payload")
    return got.select("doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"), "media_bytes", "media_sha256", "feature")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = byte_bpe.encode_docs(table(spark, sf_dir, "documents"), RANKS)
    return byte_bpe.decode_docs(ids, RANKS).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.spans(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    base = F.filter("secrets", lambda x: x["kind"] < len(secrets.KINDS))
    counts = [F.size(F.filter("secrets", secrets.of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(secrets.KINDS)]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("secrets")).alias("spans"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), VOCABULARY)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.find(table(spark, sf_dir, "documents"), words=2, percent=80)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    names = F.array_join(F.array_sort(F.array_distinct("matches.license")), ",")
    spans = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string"))), ",")
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), names.alias("licenses"), spans.alias("spans"), F.array_max("matches.containment").alias("best_containment"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vector_search.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.find(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, moved)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_sharding, op3_token_counts, op4_media_columns, op5_byte_bpe, op6_secret_scan, op7_best_fit_packing, op8_license_scan, op9_near_dedup, op10_exact_topk, op11_embedding_dedup, op12_hard_negatives, op13_lexical_search)}
SQL: dict[str, str] = {"op2_sharding": sharding.SQL, "op9_near_dedup": near_dedup.SQL, "op10_exact_topk": vector_search.SQL, "op11_embedding_dedup": embedding_dedup.SQL, "op12_hard_negatives": hard_negatives.SQL, "op13_lexical_search": lexical.SQL}
