"""The corpus pipeline: toxicity, near duplicates, secrets, packing, each stage written and reread.

Stages take and return whole tables of documents; only the last returns packed pieces. Null texts
pass the first three stages and pack as one end id each; rows with a null id pass all stages, rows that
repeat an id stay or go together in the second, of groups that tie the smallest id stays, and other columns are kept, whatever their names, until
the last. Texts of any length go through whole. An empty table passes through all stages. Lexicon and
labels come from the whole documents table of sf_dir, whatever a stage was given.

SQL cannot express the learned lexicon, tests of randomness or the tokenizer, so ORACLE_SQL is None;
tests/llm/test_pipeline.py holds the result against plain versions of all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import near_dedup, packing, secrets, toxicity
from quillspark.llm.queries import VOCABULARY
from quillspark.llm.shared import new_folder, table, unused


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity reaches the threshold; the lexicon comes from the labels."""
    lexicon = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score = unused(docs, "toxicity")
    return toxicity.score(docs, lexicon, out=score).where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return near_dedup.keep_one(docs, words=5, percent=80)


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with its secrets masked and n_chars counted again."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, VOCABULARY)


STAGES = [("toxicity", toxic_out), ("near_dedup", near_duplicates_out), ("secret_scans", secrets_masked), ("best_fit_packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = new_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
    return docs
