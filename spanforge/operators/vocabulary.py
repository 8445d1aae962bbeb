"""Observed vocabularies: token frequencies, pairwise set and bag similarity, containment, evaluation against truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.operators import ranking
from spanforge.operators.observations import valid

# Weights of the vocabulary score and the count up to which a token is rare.
WEIGHTS = {"weighted_jaccard": 0.60, "jaccard": 0.25, "rare_token_jaccard": 0.15}
RARE = 3


def token_counts(obs: DataFrame, include_errors: bool = False) -> DataFrame:
    """(model_name, family, ord, token, n, first_seq)."""
    rows = obs if include_errors else valid(obs)
    return rows.groupBy("model_name", "family", "ord", T.vocab_token(F.col("output_text")).alias("token")).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def ranked(obs: DataFrame, include_errors: bool = False, k: int | None = None, ties: str = "token") -> DataFrame:
    """Frequency ranking per model; ties by token text, or by first appearance. A model's tokens are numbered in blocks of
    equal frequency and, with ties by text, equal beginnings."""
    counts = token_counts(obs, include_errors)
    total = counts.groupBy("model_name").agg(F.sum("n").alias("total"))
    blocks = [-F.col("n")] + ([F.substring("token", 1, 2)] if ties == "token" else [])
    out = ranking.numbered(counts, ["model_name"], blocks, [F.col(ties)], "rank").join(total, "model_name")
    out = out.select("model_name", "token", "n", (F.col("n") / F.col("total")).alias("share"), "rank")
    return out.where(F.col("rank") <= k) if k else out


def model_summary(obs: DataFrame, expected: DataFrame | None = None, include_errors: bool = True) -> DataFrame:
    """Per model: tokens, distinct tokens, empties, probes, and whether the probes are as many as expected (model_name, n_expected)."""
    rows = obs if include_errors else valid(obs)
    per = token_counts(rows, True).groupBy("model_name").agg(
        F.sum("n").alias("total_token_count"), F.count("*").alias("unique_token_count"), F.sum(F.when(F.col("token") == T.EMPTY_TOKEN, F.col("n")).otherwise(0)).alias("empty_token_count")
    )
    probes = rows.groupBy("model_name").agg(F.count_distinct("probe_id").alias("n_probes"))
    out = per.join(probes, "model_name").withColumn("empty_token_rate", F.col("empty_token_count") / F.col("total_token_count"))
    if expected is not None:
        out = out.join(expected, "model_name", "left").withColumn("probe_count_matches_index", F.col("n_probes") == F.col("n_expected"))
    return out


def pairs(obs: DataFrame, weights: dict[str, float] | None = None, rare: int = RARE, include_errors: bool = True) -> DataFrame:
    """Set, bag and rare-token similarity of every pair of models.

    Tokens are grouped once (one entry per model in a group) and paired within the row; what concerns one
    model alone (sizes, totals, rare tokens) is aggregated apart and joined to the pairs, which are few.
    """
    w = weights or WEIGHTS
    if sum(w.values()) <= 0:
        raise ValueError("the weights' total must be positive")
    counts = token_counts(obs, include_errors)
    own = counts.groupBy("model_name", "family", "ord").agg(F.count("*").alias("size"), F.sum("n").alias("total"), F.count_if(F.col("n") <= rare).alias("rare"))
    shared = counts.groupBy("token").agg(F.collect_list(F.struct("ord", "n")).alias("all"))
    shared = shared.select("all", F.explode("all").alias("a")).select("a", F.explode("all").alias("b")).where("a.ord < b.ord")
    shared = shared.groupBy(F.col("a.ord").alias("ord_a"), F.col("b.ord").alias("ord_b")).agg(
        F.count("*").alias("inter"), F.sum(F.least("a.n", "b.n")).alias("low"), F.count_if((F.col("a.n") <= rare) & (F.col("b.n") <= rare)).alias("both_rare")
    )
    side = lambda s: own.select(*(F.col(c).alias(f"{c}_{s}") for c in own.columns))
    out = side("a").join(side("b"), F.col("ord_a") < F.col("ord_b")).join(shared, ["ord_a", "ord_b"], "left").fillna(0, ["inter", "low", "both_rare"])
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    c = F.col
    out = out.select(
        c("model_name_a").alias("model_a"), "family_a", "ord_a", c("model_name_b").alias("model_b"), "family_b", "ord_b", (c("family_a") == c("family_b")).alias("same_family"),
        c("size_a").alias("unique_token_count_a"), c("size_b").alias("unique_token_count_b"), c("inter").alias("intersection_token_count"),
        ratio(c("inter"), c("size_a") + c("size_b") - c("inter")).alias("jaccard"), ratio(c("inter"), c("size_a")).alias("coverage_a_to_b"), ratio(c("inter"), c("size_b")).alias("coverage_b_to_a"),
        ratio(c("low"), c("total_a") + c("total_b") - c("low")).alias("weighted_jaccard"), ratio(c("both_rare"), c("rare_a") + c("rare_b") - c("both_rare")).alias("rare_token_jaccard"),
    )
    total = sum(w.values())
    return out.withColumn("vocab_score", F.round(sum((c(k) * F.lit(v / total) for k, v in w.items()), F.lit(0.0)), 9))


def containment(pair_rows: DataFrame) -> DataFrame:
    """Both directions of every pair, ranked per source model by how much of its vocabulary the candidate holds."""
    c = F.col

    def one(s, t, cover, back):
        return pair_rows.select(
            c(f"model_{s}").alias("source_model"), c(f"family_{s}").alias("source_family"), c(f"model_{t}").alias("candidate_model"), c(f"family_{t}").alias("candidate_family"), "same_family",
            c(cover).alias("shell_confidence"), c(f"unique_token_count_{s}").alias("source_vocab_size"), c(f"unique_token_count_{t}").alias("candidate_vocab_size"),
            "intersection_token_count", "jaccard", "weighted_jaccard", "rare_token_jaccard", c(back).alias("reverse_shell_confidence"), F.round(c(cover) - c(back), 9).alias("containment_gap"), c(f"ord_{t}").alias("o"),
        )

    both = one("a", "b", "coverage_a_to_b", "coverage_b_to_a").union(one("b", "a", "coverage_b_to_a", "coverage_a_to_b"))
    rank = F.row_number().over(Window.partitionBy("source_model").orderBy(F.desc("shell_confidence"), "o")).cast("bigint")
    return both.withColumn("rank", rank).drop("o")


def top_rows(scored: DataFrame, model: str, other: str, score: str) -> DataFrame:
    """(model, top1_model, score, margin) from ranked rows."""
    best = scored.where("rank <= 2").groupBy(F.col(model).alias("model")).agg(
        F.max(F.when(F.col("rank") == 1, F.col(other))).alias("top1_model"), F.max(F.when(F.col("rank") == 1, F.col(score))).alias("score"), F.max(F.when(F.col("rank") == 2, F.col(score))).alias("second")
    )
    return best.select("model", "top1_model", "score", F.round(F.col("score") - F.coalesce("second", F.lit(0.0)), 9).alias("margin"))


def threshold_sweep(tops: DataFrame, truth: DataFrame) -> DataFrame:
    """Confusion counts and ratios of every (score, margin) threshold that the models' own values give. truth:
    (model_name, target_model), no rows for a negative. Rows are models, so the grid is small."""
    rows = tops.join(truth.groupBy(F.col("model_name").alias("model")).agg(F.collect_set("target_model").alias("targets")), "model", "left")
    positive = F.col("targets").isNotNull()
    rows = rows.withColumns({"positive": positive, "hit": F.coalesce(F.array_contains("targets", F.col("top1_model")), F.lit(False))})
    s = tops.select(F.round("score", 4).alias("score_threshold")).distinct()
    m = tops.select(F.round("margin", 4).alias("margin_threshold")).union(tops.sparkSession.range(1).select(F.lit(0.0))).distinct()
    grid = s.crossJoin(m).crossJoin(rows.select("score", "margin", "positive", "hit"))
    said = (F.col("score") >= F.col("score_threshold")) & (F.col("margin") >= F.col("margin_threshold"))
    out = grid.groupBy("score_threshold", "margin_threshold").agg(
        F.count_if(said & F.col("hit")).alias("tp"), F.count_if(said & ~F.col("hit")).alias("fp"), F.count_if(~said & F.col("positive")).alias("fn"), F.count_if(~said & ~F.col("positive")).alias("tn")
    )
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    c = F.col
    out = out.withColumns({"precision": ratio(c("tp"), c("tp") + c("fp")), "recall": ratio(c("tp"), c("tp") + c("fn")), "accuracy": ratio(c("tp") + c("tn"), c("tp") + c("fp") + c("fn") + c("tn"))})
    return out.withColumn("f1", F.round(ratio(2 * c("precision") * c("recall"), c("precision") + c("recall")), 9))


def best_thresholds(sweep: DataFrame) -> DataFrame:
    """The best row by accuracy, by F1, and by recall among those of high precision; the first of equals in grid order wins."""
    def pick(name, rows, *order):
        return rows.orderBy(*(F.desc(o) for o in order), "score_threshold", "margin_threshold").limit(1).withColumn("criterion", F.lit(name))

    high = sweep.where("precision >= 0.95 and tp > 0")
    return pick("accuracy", sweep, "accuracy", "f1", "precision").union(pick("f1", sweep, "f1", "accuracy", "precision")).union(pick("high_precision", high, "recall", "accuracy", "f1"))


def topk_hits(near: DataFrame, truth: DataFrame, ks=(1, 3, 5)) -> DataFrame:
    """(k, n, hits, hit_rate) over models with a target; near: (model, neighbour, rank)."""
    hit = near.join(truth, (near["model"] == truth["model_name"]) & (near["neighbour"] == truth["target_model"]), "left_semi").groupBy("model").agg(F.min("rank").alias("best"))
    models = truth.select(F.col("model_name").alias("model")).distinct().join(hit, "model", "left")
    out = models.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).groupBy("k").agg(F.count("*").alias("n"), F.count_if(F.col("best") <= F.col("k")).alias("hits"))
    return out.withColumn("hit_rate", F.col("hits") / F.col("n"))


def family_report(pair_rows: DataFrame) -> DataFrame:
    return pair_rows.groupBy("same_family").agg(
        F.count("*").alias("n"), F.min("vocab_score").alias("min_score"), F.max("vocab_score").alias("max_score"), F.round(F.avg("vocab_score"), 9).alias("mean_score")
    )
