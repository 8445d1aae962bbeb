"""Running analytics over a growing response log: Structured Streaming over the JSON-lines folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanforge.functions import text as T
from spanforge.sources.readers import OBSERVATION


def observations(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    rows = spark.readStream.schema(OBSERVATION + ", ts timestamp").option("maxFilesPerTrigger", max_files).json(path)
    return rows.withColumn("error", F.col("raw_response.error"))


def token_counts(stream: DataFrame) -> DataFrame:
    """Counts of tokens so far; state grows with the vocabulary."""
    return stream.where("error is null").groupBy("model_name", T.vocab_token(F.col("output_text")).alias("token")).agg(F.count("*").alias("n"))


def first_results(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One result per model and probe; state older than the delay is dropped."""
    return stream.where("error is null").withWatermark("ts", delay).dropDuplicatesWithinWatermark(["model_name", "probe_id"])


def type_rates(stream: DataFrame, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Token types per time window; rows later than the delay are left out."""
    typed = stream.where("error is null").withWatermark("ts", delay).withColumn("token_type", T.classify(F.col("output_text")))
    return typed.groupBy(F.window("ts", window), "model_name", "token_type").agg(F.count("*").alias("n"))


def to_table(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Run until the input is used up; the checkpoint folder makes a rerun go on where this one ended."""
    writer = df.writeStream.outputMode(mode).format("memory").queryName(name) if mode == "complete" else df.writeStream.outputMode(mode).format("parquet").option("path", name)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
