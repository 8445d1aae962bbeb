"""Tokenizer lineage: vocabulary and encoding comparison, equivalence, components, representatives, registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions import text as T

# Similarity weights, thresholds of near equivalence, priority of roles.
W_JACCARD, W_IDS, W_ENCODINGS, W_SPECIAL = 0.45, 0.35, 0.15, 0.05
NEAR_JACCARD, NEAR_IDS, NEAR_ENCODINGS = 0.995, 0.995, 0.99
ROLE_PRIORITY = {"base": 0, "pretrain": 0, "instruct": 1, "chat": 2}


def role_priority(role):
    out = F.lit(3)
    for k, v in ROLE_PRIORITY.items():
        out = F.when(role == k, v).otherwise(out)
    return out


def duplicates(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def invalid_entries(manifest: DataFrame) -> DataFrame:
    """(name, problem) of entries that lack what their source needs or have an unknown source or role."""
    missing = lambda c: F.col(c).isNull() | (F.col(c) == "")
    problem = (
        F.when(missing("name"), "no name").when(missing("family"), "no family").when(missing("model_id"), "no model_id")
        .when(~F.col("source").isin("hf", "tiktoken") | missing("source"), "unknown source")
        .when((F.col("source") == "hf") & missing("local_dir"), "no local_dir").when((F.col("source") == "tiktoken") & missing("encoding"), "no encoding")
        .when(~F.coalesce(F.col("role"), F.lit("other")).isin(*ROLE_PRIORITY, "other"), "unknown role")
    )
    return manifest.select("name", problem.alias("problem")).where("problem is not null")


def pairs(vocab: DataFrame, encodings: DataFrame, meta: DataFrame) -> DataFrame:
    """Comparison of every pair of tokenizers.

    vocab (model, token, id), encodings (model, sample, ids), meta (name, family, ord, ..., special_tokens).
    As everywhere, tokens are grouped once with one entry per model and paired in the row.
    """
    ords = meta.select(F.col("name").alias("model"), "ord")
    sizes = vocab.groupBy("model").agg(F.count("*").alias("size"))

    def paired(rows: DataFrame, key: str, value: str) -> DataFrame:
        g = rows.join(ords, "model").groupBy(key).agg(F.collect_list(F.struct("ord", F.col(value).alias("v"))).alias("all"))
        return g.select("all", F.explode("all").alias("a")).select("a", F.explode("all").alias("b")).where("a.ord < b.ord").select(F.col("a.ord").alias("oa"), F.col("b.ord").alias("ob"), (F.col("a.v") == F.col("b.v")).alias("same"))

    tokens = paired(vocab, "token", "id").groupBy("oa", "ob").agg(F.count("*").alias("shared"), F.count_if("same").alias("id_match_count"))
    samples = paired(encodings, "sample", "ids").groupBy("oa", "ob").agg(F.count("*").alias("encoding_sample_count"), F.count_if("same").alias("encoding_same_count"))
    m = meta.join(sizes, meta["name"] == sizes["model"], "left").select("name", "family", "ord", "special_tokens", F.coalesce("size", F.lit(0)).alias("size"))
    side = lambda s: m.select(*(F.col(c).alias(f"{c}_{s}") for c in m.columns))
    out = side("a").join(side("b"), F.col("ord_a") < F.col("ord_b"))
    out = out.join(tokens, (F.col("ord_a") == tokens["oa"]) & (F.col("ord_b") == tokens["ob"]), "left").drop("oa", "ob")
    out = out.join(samples, (F.col("ord_a") == samples["oa"]) & (F.col("ord_b") == samples["ob"]), "left").drop("oa", "ob")
    out = out.fillna(0, ["shared", "id_match_count", "encoding_same_count", "encoding_sample_count"])
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    c = F.col
    union = c("size_a") + c("size_b") - c("shared")
    out = out.withColumns({
        "token_jaccard": ratio(c("shared"), union), "id_consistency": ratio(c("id_match_count"), c("shared")), "encoding_same_rate": ratio(c("encoding_same_count"), c("encoding_sample_count")),
        "exact_token_to_id_same": (c("size_a") == c("size_b")) & (c("shared") == c("size_a")) & (c("id_match_count") == c("shared")), "same_special_tokens": c("special_tokens_a").eqNullSafe(c("special_tokens_b")),
    })
    score = W_JACCARD * c("token_jaccard") + W_IDS * c("id_consistency") + W_ENCODINGS * c("encoding_same_rate") + F.when(c("same_special_tokens"), W_SPECIAL).otherwise(0.0)
    label = (
        F.when(c("exact_token_to_id_same") & (c("encoding_same_rate") == 1.0), "hard_equivalent")
        .when((c("token_jaccard") >= NEAR_JACCARD) & (c("id_consistency") >= NEAR_IDS) & (c("encoding_same_rate") >= NEAR_ENCODINGS), "near_equivalent")
        .otherwise("distinct")
    )
    return out.select(
        c("name_a").alias("model_a"), "family_a", c("name_b").alias("model_b"), "family_b", (c("family_a") == c("family_b")).alias("same_family"), "exact_token_to_id_same", "same_special_tokens",
        c("size_a").alias("vocab_size_a"), c("size_b").alias("vocab_size_b"), c("shared").alias("shared_token_count"), union.alias("union_token_count"), "token_jaccard", "id_match_count",
        (c("shared") - c("id_match_count")).alias("id_mismatch_count"), "id_consistency", (c("size_a") - c("shared")).alias("only_a_count"), (c("size_b") - c("shared")).alias("only_b_count"),
        "encoding_same_count", "encoding_sample_count", "encoding_same_rate", F.round(score, 9).alias("tokenizer_similarity_score"), label.alias("equivalence_label"),
    )


def components(pair_rows: DataFrame, meta: DataFrame) -> DataFrame:
    """(name, family, lineage): lineage is the least name reachable over pairs of a family that aren't distinct. The pairs are
    computed once; their nodes are models, tens of them, and are joined on the driver."""
    joined = pair_rows.where("same_family and equivalence_label <> 'distinct'").select("model_a", "model_b").collect()  # at most models squared
    rows = meta.select("name", "family").collect()
    least = {r["name"]: r["name"] for r in rows}

    def root(x: str) -> str:
        while least[x] != x:
            x = least[x]
        return x

    for a, b in joined:
        x, y = sorted((root(a), root(b)))
        least[y] = x
    return meta.sparkSession.createDataFrame([(r["name"], r["family"], root(r["name"])) for r in rows], "name string, family string, lineage string")


def _inside(pair_rows: DataFrame, lineages: DataFrame) -> DataFrame:
    a, b = (lineages.select(F.col("name").alias(f"model_{s}"), F.col("lineage").alias(f"l{s}")) for s in "ab")
    return pair_rows.join(a, "model_a").join(b, "model_b").where("la = lb").withColumnRenamed("la", "lineage").drop("lb")


def metrics(pair_rows: DataFrame, lineages: DataFrame) -> DataFrame:
    """Per lineage: members, pairs, similarity and kinds of equivalence; a singleton has similarity 1."""
    s = "tokenizer_similarity_score"
    of = lambda k: F.count_if(F.col("equivalence_label") == k).alias(k)
    inside = _inside(pair_rows, lineages).groupBy("lineage").agg(
        F.count("*").alias("pairs"), F.round(F.avg(s), 9).alias("mean"), F.min(s).alias("min"), F.max(s).alias("max"), of("hard_equivalent"), of("near_equivalent"), of("distinct")
    )
    out = lineages.groupBy("family", "lineage").agg(F.count("*").alias("members")).join(inside, "lineage", "left")
    return out.fillna(0, ["pairs", "hard_equivalent", "near_equivalent", "distinct"]).fillna(1.0, ["mean", "min", "max"])


def representatives(pair_rows: DataFrame, lineages: DataFrame, meta: DataFrame) -> DataFrame:
    """(family, lineage, representative): the member most similar to the others; ties by role, rank and name."""
    inside = _inside(pair_rows, lineages)
    both = inside.select("model_a", "tokenizer_similarity_score").union(inside.select("model_b", "tokenizer_similarity_score")).toDF("name", "s")
    mean = both.groupBy("name").agg(F.round(F.avg("s"), 9).alias("mean"))  # so that the order of a sum breaks no tie
    rows = lineages.join(mean, "name", "left").fillna(1.0, ["mean"]).join(meta.select("name", "role", "preferred_rank"), "name")
    order = Window.partitionBy("family", "lineage").orderBy(F.desc("mean"), role_priority(F.col("role")), "preferred_rank", "name")
    return rows.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("family", "lineage", F.col("name").alias("representative"), "role", "preferred_rank")


def registry(pair_rows: DataFrame, lineages: DataFrame, meta: DataFrame) -> DataFrame:
    """One row per lineage: a family's primary baseline and its numbered variants."""
    rows = representatives(pair_rows, lineages, meta).join(lineages.groupBy("lineage").agg(F.count("*").alias("members"), F.array_sort(F.collect_list("name")).alias("names")), "lineage")
    order = Window.partitionBy("family").orderBy(F.desc("members"), role_priority(F.col("role")), "preferred_rank", "representative")
    rn = F.row_number().over(order)
    slug = T.slugify(F.col("family"))
    rows = rows.withColumn("rn", rn)
    kind = F.when(F.col("rn") == 1, "primary").otherwise("variant")
    name = F.when(F.col("rn") == 1, F.concat(slug, F.lit("__primary"))).otherwise(F.concat(slug, F.lit("__variant_"), F.lpad((F.col("rn") - 1).cast("string"), 2, "0")))
    return rows.select(name.alias("baseline_id"), "family", kind.alias("kind"), "representative", F.col("members").cast("bigint").alias("members"), F.array_join("names", ",").alias("member_models"))


def tiktoken_tokens(ranks: DataFrame, specials: DataFrame | None = None) -> DataFrame:
    """(token, id): byte tokens as b64: and their base64, special ones as special: and their text."""
    out = ranks.select(F.concat(F.lit("b64:"), F.base64("bytes")).alias("token"), "id")
    return out if specials is None else out.union(specials.select(F.concat(F.lit("special:"), F.col("text")), "id"))
