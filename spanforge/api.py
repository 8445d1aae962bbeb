"""The engine's surface: what a command line or a notebook calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.operators import features, lineage, observations, similarity, vocabulary


def fingerprint(obs: DataFrame, probes: DataFrame | None = None) -> dict[str, DataFrame]:
    """Feature tables of every model in a log. Categories are the log's own, or those of the probes."""
    if probes is None and "category" not in obs.columns:
        obs = obs.withColumn("category", F.lit("unknown"))
    return {
        "char_lengths": features.length_histogram(obs), "byte_lengths": features.length_histogram(obs, "byte"), "surface": features.surface(obs),
        "types": features.type_distribution(obs), "transitions": features.transitions(obs, probes), "metadata": features.metadata(obs),
    }


def build_bank(obs: DataFrame, models: DataFrame) -> DataFrame:
    """A log with the models' families and order; a model that failed throughout is an error."""
    out = obs.drop("family", "ord").join(models.select("model_name", "family", "ord"), "model_name")
    dead = out.groupBy("model_name").agg(F.count_if(F.col("error").isNull()).alias("ok")).where("ok = 0").collect()
    if dead:
        raise ValueError("no valid result of " + ", ".join(r.model_name for r in dead))
    return out


def compare(bank: DataFrame, model_a: str, model_b: str, method: str = "strict") -> DataFrame:
    return similarity.compare(bank, model_a, model_b, method)


def compare_bank(bank: DataFrame, exclude: DataFrame | None = None, method: str = "strict", top_k: int = 5, weights: dict[str, float] | None = None) -> dict[str, DataFrame]:
    """Pairs, neighbours, per-model summary and baseline of a bank."""
    obs = observations.exclude(bank, exclude) if exclude is not None else bank
    pairs = similarity.pair_scores(obs) if method == "strict" else similarity.soft_pair_scores(obs, weights)
    return {"pairs": pairs, "neighbours": similarity.neighbours(pairs, top_k), "summary": similarity.bank_summary(pairs), "statistics": similarity.bank_statistics(pairs)}


def detect(bank: DataFrame, target: str, exclude: DataFrame | None = None, method: str = "strict", weights: dict[str, float] | None = None) -> DataFrame:
    """The verdict on one model of a bank."""
    obs = observations.exclude(bank, exclude) if exclude is not None else bank
    pairs = similarity.pair_scores(obs) if method == "strict" else similarity.soft_pair_scores(obs, weights)
    row = similarity.stability(obs.where(F.col("model_name") == target)).first()
    boot = similarity.bootstrap_exact(obs, target=target)
    return similarity.decide(pairs, target, row.stability_variance if row else 0.0, boot=boot)


def compare_vocabularies(bank: DataFrame, truth: DataFrame | None = None, weights: dict[str, float] | None = None) -> dict[str, DataFrame]:
    pairs = vocabulary.pairs(bank, weights)
    out = {"models": vocabulary.model_summary(bank), "pairs": pairs, "containment": vocabulary.containment(pairs), "report": vocabulary.family_report(pairs)}
    if truth is not None:
        out["sweep"] = vocabulary.threshold_sweep(vocabulary.top_rows(out["containment"], "source_model", "candidate_model", "shell_confidence"), truth)
    return out


def tokenizer_baselines(vocab: DataFrame, encodings: DataFrame, meta: DataFrame) -> dict[str, DataFrame]:
    pairs = lineage.pairs(vocab, encodings, meta).persist()  # models squared; all that follows reads it
    groups = lineage.components(pairs, meta)
    return {"pairs": pairs, "lineages": groups, "metrics": lineage.metrics(pairs, groups), "registry": lineage.registry(pairs, groups, meta)}
