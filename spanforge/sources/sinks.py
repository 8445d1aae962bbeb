"""Writers: probes, response logs, banks, comparison and vocabulary exports, reports."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from spanforge.functions import text as T

KEPT = ("error", "_raw_output_text", "_output_normalization", "_empty_output_retry")


def probes(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def compact(df: DataFrame) -> DataFrame:
    """Results with, of the raw response, only what is read again."""
    if "raw_response" not in df.columns:
        return df
    have = [f.name for f in df.schema["raw_response"].dataType if f.name in KEPT]
    return df.withColumn("raw_response", F.struct(*(F.col(f"raw_response.{c}") for c in have)))


def append_observations(df: DataFrame, path: str) -> None:
    """Append results as JSON lines. A null error is left out, since an error is the presence of its key."""
    compact(df).write.mode("append").option("ignoreNullFields", True).json(path)


def _json(spark, path: str, value) -> None:
    """A small object as JSON text under path, through Spark, so that any store will do. readers take the folder."""
    spark.createDataFrame([(json.dumps(value, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def fingerprints(tables: dict[str, DataFrame], obs: DataFrame, path: str, raw: bool = True) -> None:
    """Features of every model, a JSON object a line, and with raw the results themselves as a side table of JSON lines.
    tables: as of api.fingerprint()."""
    entry = lambda df, key: df.groupBy("model_name").agg(F.map_from_entries(F.collect_list(F.struct(key, "share"))).alias("m"))
    out = tables["surface"].join(tables["metadata"], "model_name", "outer")
    for name, key in (("char_lengths", F.col("bucket").cast("string")), ("byte_lengths", F.col("bucket").cast("string")), ("types", F.col("token_type")), ("transitions", F.concat_ws("|", "category", "token_type"))):
        out = out.join(entry(tables[name], key).withColumnRenamed("m", name), "model_name", "left")
    out.write.mode("overwrite").json(f"{path}/fingerprints")
    if raw:
        compact(obs).write.mode("overwrite").json(f"{path}/raw_results")


def bank(obs: DataFrame, path: str) -> None:
    """One folder per family and model, so that a reader of one model lists one folder, and index.json in the bank's order."""
    named = obs.withColumn("model", T.sanitize_model_name(F.col("model_name")))
    named.write.mode("overwrite").partitionBy("family", "model").parquet(f"{path}/rows")
    models = named.groupBy("ord", "model_name", "family", "model").agg(F.count_distinct("probe_id").alias("n_probes")).orderBy("ord").collect()  # a row per model
    _json(obs.sparkSession, f"{path}/index.json", [{"model_name": r.model_name, "family": r.family, "path": f"rows/family={r.family}/model={r.model}", "n_probes": r.n_probes} for r in models])


def comparison(pairs: DataFrame, path: str, parts: dict[str, DataFrame] | None = None) -> None:
    """Pairs by score as one CSV file, and as the `pairs` of a JSON object with other small tables; they are as many as models squared."""
    by_score = pairs.orderBy(F.desc("score"), "ord_a", "ord_b")
    by_score.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    _json(pairs.sparkSession, f"{path.rstrip('/')}.json", {k: [r.asDict(True) for r in df.collect()] for k, df in ({"pairs": by_score} | (parts or {})).items()})


def vocabulary(ranked: DataFrame, path: str, layout: str = "bank", form: str = "csv") -> None:
    """A ranked vocabulary, sorted within files by model and rank. layout "run": seven columns, "bank": nine; form csv or json."""
    token, display = F.col("token"), F.when(F.col("token") == T.EMPTY_TOKEN, F.lit("")).otherwise(F.col("token"))
    length = [T.char_length(display).alias("char_length"), T.byte_length(display).alias("byte_length")]
    json_, share = T.json_string(display), T.share_text(F.col("share")).alias("share")
    if layout == "run":
        out = ranked.select("model_name", json_.alias("next_token"), F.col("n").alias("frequency"), share, "rank", *length)
    else:
        out = ranked.select("model_name", "rank", json_.alias("next_token_json"), token.alias("next_token_display"), F.col("n").alias("frequency"), share, *length, (token == T.EMPTY_TOKEN).alias("is_empty_token"))
    writer = out.repartitionByRange("model_name", "rank").sortWithinPartitions("model_name", "rank").write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else writer.json(path)


def evaluation(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def markdown(df: DataFrame, limit: int = 200) -> str:
    """A small result as a Markdown table."""
    rows = [tuple(r) for r in df.limit(limit).collect()]
    line = lambda xs: "| " + " | ".join(str(x).replace("|", "\\|") for x in xs) + " |"
    return "\n".join([line(df.columns), line(["-"] * len(df.columns)), *map(line, rows)])


def report(tables: dict[str, DataFrame], path: str, title: str, facts: dict | None = None) -> None:
    """Small tables - of a vocabulary bank, a registry of baselines - as one JSON object, a CSV folder each, and one Markdown text."""
    spark = next(iter(tables.values())).sparkSession
    _json(spark, f"{path}/report.json", (facts or {}) | {k: [r.asDict(True) for r in df.collect()] for k, df in tables.items()})
    text = "\n".join([f"# {title}", "", *(f"- {k}: {v}" for k, v in (facts or {}).items()), *(f"\n## {k}\n\n{markdown(df)}" for k, df in tables.items())])
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report.md")
    for k, df in tables.items():
        plain = df.select(*(F.to_json(c).alias(c) if not isinstance(df.schema[c].dataType, AtomicType) else F.col(c) for c in df.columns))
        plain.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/{k}.csv")


SECRET = re.compile(r"(?i)key|token|secret|password|authorization")


def masked(config, name: str = ""):
    """A configuration whose secrets can be shown: of a value under a secret's name only that there is one."""
    if isinstance(config, dict):
        return {k: masked(v, k) for k, v in config.items()}
    if isinstance(config, list):
        return [masked(v, name) for v in config]
    return "***" if config and isinstance(config, str) and SECRET.search(name) else config


def summary(spark, path: str, *, mode: str, status: str, seconds: float, stages: dict[str, float], config: dict | None = None, counts: dict | None = None, error: str | None = None) -> dict:
    """summary.json and timing.json of a run that ended, or failed."""
    timing = {"mode": mode, "status": status, "elapsed_seconds": seconds, "stage_elapsed_seconds": stages} | ({"error": error} if error else {})
    whole = timing | {"config": masked(config or {}), "counts": counts or {}}
    _json(spark, f"{path}/timing.json", timing)
    _json(spark, f"{path}/summary.json", whole)
    return whole
