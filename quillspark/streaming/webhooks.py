"""The webhook source: signed bodies in, jobs and a quarantine out.

A receiver appends what it gets as JSON lines (REQUEST) to an inbox folder; the body is the raw bytes in
base64, as the signature is over these. ``listen`` reads the folder as a stream, so its checkpoint holds the
offsets. A body is parsed only after its signature holds. What is unsigned, forged or no JSON object goes to
the quarantine with its raw body, all else is dispatched. Each batch writes folders of its own number and
replaces them when it comes again, so a restart neither loses nor repeats a request.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import gateway

REQUEST = "request_id string, event_type string, signature string, body string"
JOBS = "request_id string, event_type string, status string, job struct<project_id:string,branch:string,repository_url:string,changed_files:array<string>,commit_hash:string>"
QUARANTINE = "request_id string, event_type string, reason string, body string"


def inbox(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", files_per_batch).json(folder)


def checked(requests: DataFrame, secret: str) -> DataFrame:
    """Adds ``reason`` why a request is refused (unsigned, forged or broken; null if it is not) and, for the
    others, the job and the dispatch status."""
    raw = F.coalesce(F.try_to_binary("body", F.lit("base64")), F.lit(b""))
    seen = requests.withColumn("valid", ids.signature_valid(raw, F.coalesce("signature", F.lit("")), F.lit(secret)))
    text = F.when(F.col("valid"), F.try_validate_utf8(raw.cast("string")))  # null unless signed
    seen = seen.withColumn("text", F.when(F.try_parse_json(text).isNotNull() & F.startswith(F.ltrim(text), F.lit("{")), text))
    reason = F.when(F.coalesce(F.trim("signature"), F.lit("")) == "", "unsigned").when(~F.col("valid"), "forged").when(F.col("text").isNull(), "broken")
    jobs = gateway.push_jobs(seen.select("request_id", "event_type", reason.alias("reason"), F.col("body").alias("raw"), F.col("text").alias("body")))
    status = F.when(F.col("reason").isNull(), gateway.dispatch(F.col("event_type"), F.col("job.branch"), F.col("job.project_id"), F.col("job.changed_files")))
    return jobs.withColumn("status", status)


def write_batch(batch: DataFrame, epoch: int, path: str, secret: str) -> None:
    rows = checked(batch, secret).persist()
    good, bad = rows.where("reason is null"), rows.where("reason is not null")
    good.select("request_id", "event_type", "status", "job").write.mode("overwrite").parquet(f"{path}/jobs/epoch={epoch}")
    bad.select("request_id", "event_type", "reason", F.col("raw").alias("body")).write.mode("overwrite").parquet(f"{path}/quarantine/epoch={epoch}")
    rows.unpersist()


def listen(requests: DataFrame, path: str, checkpoint: str, secret: str, write=write_batch):
    """A streaming query that takes what the inbox holds, from where its checkpoint ends."""
    sink = requests.writeStream.foreachBatch(lambda batch, epoch: write(batch, epoch, path, secret))
    return sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def jobs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{JOBS}, epoch long").parquet(f"{path}/jobs")


def quarantine(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{QUARANTINE}, epoch long").parquet(f"{path}/quarantine")
