"""Pairwise boundary consistency of models, strict and soft, with uncertainty, baselines, neighbours and a verdict.

Pairs come from one grouping by probe: the models' first results on a probe are collected (one entry per
model, so the group is bounded by the number of models) and paired by ordinal within the row. There is no
self-join, and pair counts are pre-aggregated before the only wide shuffle of the plan's tail.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.operators import ranking
from spanforge.operators.observations import valid

# Soft weights, bank rule, decision cut-offs.
SOFT_WEIGHTS = {"exact": 0.60, "char": 0.07, "byte": 0.07, "type": 0.16, "prefix": 0.07, "empty": 0.03}
MIN_SCORE, MIN_MARGIN = 0.50, 0.08
MAX_INSTABILITY = 0.15


def soft_weights(given: dict[str, float] | None = None) -> dict[str, float]:
    """Given weights over the defaults, normalized over all keys; the defaults if the total isn't positive."""
    merged = SOFT_WEIGHTS | (given or {})
    total = sum(merged.values())
    return {k: v / total for k, v in merged.items()} if total > 0 else dict(SOFT_WEIGHTS)


def _matches(obs: DataFrame) -> DataFrame:
    """One row per probe and pair of models, with what agrees."""
    sig = T.signature(F.col("output_text"), T.classify(F.col("output_text")))
    rows = valid(obs).withColumn("sig", sig)
    first = rows.groupBy("probe_id", "model_name").agg(F.min_by(F.struct("ord", "family", "sig"), "seq").alias("r"))
    per_probe = first.groupBy("probe_id").agg(F.collect_list(F.struct("r.ord", "model_name", "r.family", "r.sig")).alias("all"))
    one = per_probe.select("probe_id", "all", F.explode("all").alias("a"))
    two = one.select("probe_id", "a", F.explode("all").alias("b")).where("a.ord < b.ord")
    eq = lambda f: (F.col(f"a.sig.{f}") == F.col(f"b.sig.{f}")).cast("int")
    return two.select(
        "probe_id", F.col("a.model_name").alias("model_a"), F.col("a.family").alias("family_a"), F.col("a.ord").alias("ord_a"),
        F.col("b.model_name").alias("model_b"), F.col("b.family").alias("family_b"), F.col("b.ord").alias("ord_b"),
        eq("chars").alias("char"), eq("bytes").alias("byte"), eq("type").alias("type"), (eq("space") * eq("newline")).alias("prefix"),
        eq("empty").alias("empty"), (F.col("a.sig") == F.col("b.sig")).cast("int").alias("exact"),
    )


PAIR = ["model_a", "family_a", "ord_a", "model_b", "family_b", "ord_b"]


def pair_scores(obs: DataFrame) -> DataFrame:
    """Strict breakdown of every pair of models with a common probe."""
    n = F.count("*")
    rate = lambda c: (F.sum(c) / n).alias({"char": "char_length_match_rate", "byte": "byte_length_match_rate", "exact": "bcs"}.get(c, f"{'token_type' if c == 'type' else c}_match_rate"))
    out = _matches(obs).groupBy(*PAIR).agg(n.alias("common_probe_count"), *(rate(c) for c in ("exact", "char", "byte", "type", "prefix", "empty")))
    return out.withColumn("score", F.col("bcs"))


def soft_pair_scores(obs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    w = soft_weights(weights)
    cols = {"exact": "bcs", "char": "char_length_match_rate", "byte": "byte_length_match_rate", "type": "token_type_match_rate", "prefix": "prefix_match_rate", "empty": "empty_match_rate"}
    soft = reduce(lambda a, b: a + b, (F.col(cols[k]) * F.lit(w[k]) for k in SOFT_WEIGHTS))
    return pair_scores(obs).withColumn("score", F.round(soft, 9))


def bootstrap_closed(pairs: DataFrame, ratio: float = 0.8) -> DataFrame:
    """Mean and standard deviation that resampling n = int(ratio N) probes with replacement tends to."""
    n = F.greatest(F.lit(1), F.floor(F.col("common_probe_count") * ratio))
    return pairs.select("model_a", "model_b", F.col("bcs").alias("bootstrap_mean"), F.round(F.sqrt(F.col("bcs") * (1 - F.col("bcs")) / n), 9).alias("bootstrap_std"))


def bootstrap_exact(obs: DataFrame, iterations: int = 100, ratio: float = 0.8, seed: int = 42, target: str | None = None) -> DataFrame:
    """The same by actual resampling of the probes in id order with the legacy generator, for all pairs or a target's. The
    generator is one sequence of draws over a pair's probes, so a pair is one task: a boolean a probe goes there."""
    import numpy as np
    import pandas as pd

    def run(part: pd.DataFrame) -> pd.DataFrame:
        hit = part.sort_values("probe_id")["exact"].to_numpy()
        rng, n = np.random.RandomState(seed), max(1, int(len(hit) * ratio))
        means = [hit[rng.choice(len(hit), n, replace=True)].mean() for _ in range(iterations)]
        return pd.DataFrame({"model_a": part["model_a"].iloc[:1], "model_b": part["model_b"].iloc[:1], "bootstrap_mean": [float(np.mean(means))], "bootstrap_std": [float(np.std(means))]})

    rows = _matches(obs).select("model_a", "model_b", "probe_id", "exact")
    if target is not None:
        rows = rows.where((F.col("model_a") == target) | (F.col("model_b") == target))
    return rows.groupBy("model_a", "model_b").applyInPandas(run, "model_a string, model_b string, bootstrap_mean double, bootstrap_std double")


def stability(obs: DataFrame) -> DataFrame:
    """Share of repeated probes with more than one distinct output."""
    per = valid(obs).groupBy("model_name", "probe_id").agg(F.count("*").alias("n"), F.min("output_text").alias("lo"), F.max("output_text").alias("hi"))
    per = per.where("n > 1")
    return per.groupBy("model_name").agg((F.count_if(F.col("lo") != F.col("hi")) / F.count("*")).alias("stability_variance"), F.count("*").alias("repeated_probes"))


def stability_modal(obs: DataFrame) -> DataFrame:
    """Mean over repeated probes of one minus the share of the commonest output."""
    per = valid(obs).groupBy("model_name", "probe_id", "output_text").agg(F.count("*").alias("n"))
    per = per.groupBy("model_name", "probe_id").agg((1 - F.max("n") / F.sum("n")).alias("miss"), F.sum("n").alias("n")).where("n > 1")
    return per.groupBy("model_name").agg(F.round(F.avg("miss"), 9).alias("stability_modal"))


def index_percentile(values: Column, p: int) -> Column:
    """values: sorted array. The element at int(n p / 100), clamped."""
    return F.element_at(values, F.least(F.size(values), F.floor(F.size(values) * p / 100).cast("int") + 1))


def bank_statistics(pairs: DataFrame) -> DataFrame:
    """Baseline over pairs of different families. The pairs are as many as models squared, not as probes."""
    cross = pairs.where("family_a <> family_b")
    models = pairs.select(F.explode(F.array("model_a", "model_b")).alias("m")).agg(F.count_distinct("m").alias("n_models"))
    s = F.array_sort(F.collect_list("score"))
    stats = cross.agg(
        F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 9).alias("mean"), F.round(F.coalesce(F.stddev_samp("score"), F.lit(0.0)), 9).alias("std"), s.alias("s"), F.count("*").alias("n_cross_pairs")
    )
    zero = lambda c: F.when(F.size("s") > 0, c).otherwise(0.0)
    stats = stats.select("mean", "std", zero(index_percentile(F.col("s"), 95)).alias("p95"), zero(index_percentile(F.col("s"), 99)).alias("p99"), zero(F.get("s", F.size("s") - 1)).alias("max"), "n_cross_pairs")
    return stats.crossJoin(models)


def neighbours(pairs: DataFrame, k: int | None = 5) -> DataFrame:
    """(model, family, rank, neighbour, neighbour_family, score): ties by the neighbour's bank order."""
    a = pairs.select(F.col("model_a").alias("model"), F.col("family_a").alias("family"), F.col("model_b").alias("neighbour"), F.col("family_b").alias("neighbour_family"), "score", F.col("ord_b").alias("o"))
    b = pairs.select(F.col("model_b").alias("model"), F.col("family_b").alias("family"), F.col("model_a").alias("neighbour"), F.col("family_a").alias("neighbour_family"), "score", F.col("ord_a").alias("o"))
    rank = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("score"), "o")).cast("bigint")
    out = a.union(b).withColumn("rank", rank).drop("o")
    return out.where(F.col("rank") <= k) if k else out


def bank_summary(pairs: DataFrame, min_score: float = MIN_SCORE, min_margin: float = MIN_MARGIN) -> DataFrame:
    """Per model: nearest neighbour, margin to the second, and whether both pass the bank rule."""
    near = neighbours(pairs, 2).groupBy("model").agg(
        F.max(F.when(F.col("rank") == 1, F.col("neighbour"))).alias("top1"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top1_score"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("top2_score"),
    )
    margin = F.col("top1_score") - F.col("top2_score")
    same = F.coalesce((F.col("top1_score") >= min_score) & (margin >= min_margin), F.lit(False))
    return near.select("model", "top1", "top1_score", F.round(margin, 9).alias("margin"), same.alias("same_source"))


def decide(pairs: DataFrame, target: str, stability_variance: float | None = 0.0, ratio: float = 0.8, boot: DataFrame | None = None) -> DataFrame:
    """One row: the verdict on a target against all other models of the bank, by weighing evidence. boot: bootstrap_exact() of
    the target's pairs; without it, what resampling tends to."""
    both = pairs.where((F.col("model_a") == target) | (F.col("model_b") == target))
    stats = bank_statistics(pairs.where((F.col("model_a") != target) & (F.col("model_b") != target)))
    std = bootstrap_closed(both, ratio) if boot is None else boot
    top = neighbours(both, 5).where(F.col("model") == target)
    other = F.when(F.col("model_a") == target, F.col("model_b")).otherwise(F.col("model_a"))
    nearest = std.withColumn("other", other).join(top.where("rank = 1"), F.col("other") == F.col("neighbour")).groupBy().agg(F.max("bootstrap_std").alias("bs_std"))
    ranked = F.array_sort(F.collect_list(F.struct("rank", "neighbour", "neighbour_family", "score"))).alias("top")
    row = top.agg(ranked).crossJoin(stats).crossJoin(nearest)
    at = lambda i, f: F.get("top", F.lit(i))[f]
    score = F.coalesce(at(0, "score"), F.lit(0.0))
    margin = score - F.coalesce(at(1, "score"), F.lit(0.0))
    z = F.when(F.col("std") > 0, (score - F.col("mean")) / F.col("std")).otherwise(0.0)
    sigma = margin / (F.coalesce("bs_std", F.lit(0.0)) + 1e-10)
    family = at(0, "neighbour_family")
    kin = sum((F.coalesce(at(i, "neighbour_family") == family, F.lit(False)).cast("int") for i in range(1, 3)), F.lit(1))
    row = row.select(
        F.lit(target).alias("target"), "top", score.alias("top1_score"), margin.alias("margin"), z.alias("z"), sigma.alias("margin_sigma"), kin.alias("kin"), "n_cross_pairs", at(0, "neighbour").alias("nearest")
    )
    wobbly = F.lit(float(stability_variance or 0.0) > MAX_INSTABILITY)
    pro = F.when(F.col("z") >= 2, 2).when(F.col("z") >= 1.5, 1).otherwise(0) + F.when(F.col("margin_sigma") >= 3, 2).when(F.col("margin_sigma") >= 2, 1).otherwise(0) + F.when(F.col("kin") >= 2, 1).otherwise(0)
    con = F.when((F.col("z") < 0.5) & (F.col("n_cross_pairs") > 0), 2).otherwise(0) + F.when(F.col("margin_sigma") < 2, 1).otherwise(0) + F.when(F.col("kin") < 2, 1).otherwise(0) + wobbly.cast("int")
    row = row.withColumns({"evidence_for": pro, "evidence_against": con})
    f, a = F.col("evidence_for"), F.col("evidence_against")
    same = (f >= 3) | ((f >= 2) & (a <= 1))
    sure = F.when(f >= 4, F.least(F.lit(0.95), 0.65 + 0.05 * f)).when(f >= 3, F.least(F.lit(0.85), 0.55 + 0.05 * f)).when(same, 0.50 + 0.05 * f).otherwise(F.least(F.lit(0.95), 0.55 + 0.10 * a))
    why = F.concat_ws(
        "; ",
        F.format_string("z=%.2f", "z"), F.format_string("margin=%.1f sigma", F.least("margin_sigma", F.lit(1e6))),
        F.concat(F.lit("top family "), F.col("kin").cast("string"), F.lit("/3")), F.when(wobbly, "unstable outputs"),
    )
    return row.select(
        "target", F.when(same, "same_source").otherwise("not_same_source").alias("label"), F.round(sure, 9).alias("confidence"), F.when(same, F.col("nearest")).alias("same_source_of"),
        F.round("z", 6).alias("z"), F.round("margin", 9).alias("margin"), "evidence_for", "evidence_against", why.alias("diagnosis"),
    )


def compare(obs: DataFrame, model_a: str, model_b: str, method: str = "strict") -> DataFrame:
    rows = obs.where(F.col("model_name").isin(model_a, model_b))
    return pair_scores(rows) if method == "strict" else soft_pair_scores(rows)


def stability_sample(obs: DataFrame, ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """Probes to repeat: max(1, int(n ratio)) of each model's, in the order of a digest."""
    ids = obs.select("model_name", "probe_id").distinct()
    size = ids.groupBy("model_name").agg(F.greatest(F.lit(1), F.floor(F.count("*") * ratio)).alias("quota"))
    ranked = ranking.by_digest(ids, ["model_name"], ranking.digest("probe_id", seed), [F.col("probe_id")], "k")
    return ranked.join(size, "model_name").where("k <= quota").select("model_name", "probe_id")
