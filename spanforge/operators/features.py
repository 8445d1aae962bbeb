"""Fingerprint features of a model: length histograms, rates, token types, transitions, collection metadata.
Each is one hash aggregation; histograms stay long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.operators.observations import classified, valid


def _shares(counts: DataFrame, within: list[str]) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy(*within))
    return counts.withColumn("share", F.col("n") / total)


def length_histogram(obs: DataFrame, unit: str = "char") -> DataFrame:
    """(model_name, bucket, n, share); unit: char or byte."""
    length = T.char_length(F.col("output_text")) if unit == "char" else T.byte_length(F.col("output_text"))
    return _shares(valid(obs).groupBy("model_name", length.alias("bucket")).agg(F.count("*").alias("n")), ["model_name"])


def surface(obs: DataFrame) -> DataFrame:
    t = F.col("output_text")
    rate = lambda c: F.count_if(c) / F.count("*")
    ratio = F.when(T.char_length(t) > 0, T.byte_length(t) / T.char_length(t))
    return valid(obs).groupBy("model_name").agg(
        F.round(F.coalesce(F.avg(ratio), F.lit(0.0)), 9).alias("bytes_per_char"), rate(F.startswith(t, F.lit(" "))).alias("leading_space_rate"),
        rate(F.startswith(t, F.lit("\n"))).alias("leading_newline_rate"), rate(t == "").alias("empty_rate"),
    )


def type_distribution(obs: DataFrame) -> DataFrame:
    return _shares(classified(valid(obs)).groupBy("model_name", "token_type").agg(F.count("*").alias("n")), ["model_name"])


def transitions(obs: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """P(token type given the probe's category). Unknown probes count as category "unknown"."""
    rows = classified(valid(obs))
    if probes is not None:
        rows = rows.drop("category").join(probes.select("probe_id", "category"), "probe_id", "left")
    rows = rows.withColumn("category", F.coalesce("category", F.lit("unknown")))
    return _shares(rows.groupBy("model_name", "category", "token_type").agg(F.count("*").alias("n")), ["model_name", "category"])


def metadata(obs: DataFrame) -> DataFrame:
    """Per model: rows, failures and distinct valid probes; where the log has a `raw_response`, also the
    sums of its normalization and retry records."""
    out = [F.count("*").alias("total"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_distinct(F.when(F.col("error").isNull(), F.col("probe_id"))).alias("n_probes")]
    if "raw_response" in obs.columns:
        ok, retry, norm = F.col("error").isNull(), "raw_response._empty_output_retry", "raw_response._output_normalization"
        add = lambda c: F.coalesce(F.sum(F.when(ok, F.col(f"{retry}.{c}"))), F.lit(0))
        out += [
            F.count_if(ok & F.col(f"{norm}.changed")).alias("normalized_outputs"),
            F.coalesce(F.max(F.when(ok, F.col(f"{retry}.configured_retries"))), F.lit(0)).alias("configured_retries"),
            *(add(c).alias(c) for c in ("attempt_count", "empty_retries_used", "empty_response_count")),
            F.count_if(ok & F.col(f"{retry}.recovered_after_empty")).alias("recovered_after_empty"),
            F.count_if(ok & F.col(f"{retry}.final_is_empty")).alias("final_is_empty"),
        ]
    return obs.groupBy("model_name").agg(*out)


def normalization_counts(obs: DataFrame) -> DataFrame:
    """(model_name, operation, n) over the recorded normalizations of valid rows."""
    applied = valid(obs).select("model_name", F.explode("raw_response._output_normalization.applied").alias("operation"))
    return applied.groupBy("model_name", "operation").agg(F.count("*").alias("n"))
