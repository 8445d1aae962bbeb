"""Response logs: validity, first result per probe, exclusion, resumption, merging and quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions import text as T


def valid(obs: DataFrame) -> DataFrame:
    return obs.where("error is null")


def classified(obs: DataFrame) -> DataFrame:
    return obs.withColumn("token_type", T.classify(F.col("output_text")))


def first_results(obs: DataFrame, *columns: str) -> DataFrame:
    """The first valid result of each model and probe, by seq. One partial aggregation, no sort."""
    keep = [c for c in (columns or obs.columns) if c not in ("model_name", "probe_id", "seq")]
    first = F.min_by(F.struct(*keep), "seq")
    return valid(obs).groupBy("model_name", "probe_id").agg(first.alias("r"), F.min("seq").alias("seq")).select("model_name", "probe_id", "seq", "r.*")


def exclude(obs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of probes that aren't in ids (probe_id)."""
    return obs.join(ids.select("probe_id").distinct(), "probe_id", "left_anti")


def restrict(obs: DataFrame, ids: DataFrame) -> DataFrame:
    return obs.join(ids.select("probe_id").distinct(), "probe_id", "left_semi")


def keep_required(obs: DataFrame, required: DataFrame) -> DataFrame:
    """Resumption: of each model and probe, the first rows by seq up to the required number (probe_id, required)."""
    rank = F.row_number().over(Window.partitionBy("model_name", "probe_id").orderBy("seq"))
    return valid(obs).join(required, "probe_id").withColumn("rank", rank).where("rank <= required").drop("rank", "required")


def pending(required: DataFrame, obs: DataFrame, model: str) -> DataFrame:
    """(probe_id, attempt): what is still to be asked of a model, once for each missing result."""
    done = valid(obs).where(F.col("model_name") == model).groupBy("probe_id").agg(F.count("*").alias("done"))
    left = required.join(done, "probe_id", "left").withColumn("done", F.coalesce("done", F.lit(0))).where("required > done")
    return left.select("probe_id", F.explode(F.sequence(F.lit(1), (F.col("required") - F.col("done")).cast("int"))).alias("attempt"))


def merge(*parts: DataFrame) -> DataFrame:
    """Union of datasets with probe_id and seq; of equal probe_ids the first part's first row wins."""
    whole = None
    for i, p in enumerate(parts):
        p = p.withColumn("part", F.lit(i))
        whole = p if whole is None else whole.unionByName(p)
    rest = [c for c in parts[0].columns if c != "probe_id"]
    first = F.min_by(F.struct("part", *rest), F.struct("part", "seq"))
    return whole.groupBy("probe_id").agg(first.alias("r")).select("probe_id", "r.*")


def raw_summary(obs: DataFrame) -> DataFrame:
    """Counts per model: rows, usable, failed and empty rows; distinct probes usable; failed and never usable."""
    per = obs.groupBy("model_name", "probe_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("error").isNotNull()).alias("bad"), F.count_if(F.col("error").isNull() & (F.col("output_text") == "")).alias("void")
    )
    return per.groupBy("model_name").agg(
        F.sum("n").alias("total_rows"), F.sum(F.col("n") - F.col("bad")).alias("usable_rows"), F.sum("bad").alias("failed_rows"), F.sum("void").alias("empty_rows"),
        F.count_if(F.col("n") > F.col("bad")).alias("usable_probes"), F.count_if(F.col("n") == F.col("bad")).alias("failed_only_probes"),
    )


def language_quality(obs: DataFrame) -> DataFrame:
    lang = T.language_of(F.col("probe_id"))
    return obs.groupBy("model_name", lang.alias("lang")).agg(
        F.count("*").alias("n"), F.count_if(F.col("error").isNull() & (F.col("output_text") == "")).alias("empties"), F.count_if(F.col("error").isNotNull()).alias("errors")
    )


def language_top_outputs(obs: DataFrame, k: int = 10) -> DataFrame:
    counts = valid(obs).groupBy(T.language_of(F.col("probe_id")).alias("lang"), "output_text").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "output_text"))
    return counts.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k)


def smoke_gate(obs: DataFrame, max_empty_rate: float = 0.30) -> DataFrame:
    """Whether a model's trial run may go on."""
    n, errors = F.count("*"), F.count_if(F.col("error").isNotNull())
    empty = F.count_if(F.col("output_text") == "")
    rate = empty / n
    ok = (n > 0) & (errors == 0) & (rate <= max_empty_rate)
    return obs.groupBy("model_name").agg(n.alias("n"), errors.alias("errors"), rate.alias("empty_rate"), ok.alias("passed"))


def completeness_gate(obs: DataFrame, expected: DataFrame) -> DataFrame:
    """expected: (model_name, n_expected). Both the rows and the distinct probes must be as many."""
    got = obs.groupBy("model_name").agg(F.count("*").alias("rows"), F.count_distinct("probe_id").alias("probes"))
    out = expected.join(got, "model_name", "left").fillna(0, ["rows", "probes"])
    return out.withColumn("complete", (F.col("rows") == F.col("n_expected")) & (F.col("probes") == F.col("n_expected")))


def evaluation_rows(obs: DataFrame, probes: DataFrame) -> DataFrame:
    """Every row with its probe's text, and "pass" or "fail"."""
    code = F.when(F.col("error").isNotNull() | (F.col("output_text") == ""), "fail").otherwise("pass")
    return obs.join(probes.select("probe_id", F.col("text").alias("probe_text")), "probe_id", "left").withColumn("code", code)


def audit_leading_newlines(obs: DataFrame) -> DataFrame:
    """Outputs without leading newlines, with what was done."""
    new: Column = T.without_leading_newlines(F.col("output_text"))
    return obs.withColumn("normalized_text", new).withColumn("changed", F.col("normalized_text") != F.col("output_text"))


def with_probe(obs: DataFrame, probes: DataFrame, *columns: str) -> DataFrame:
    """Results of known probes, with columns of the probe; results of others are dropped."""
    return obs.drop(*columns).join(probes.select("probe_id", *columns), "probe_id")


def first_probes(probes: DataFrame, n: int | None) -> DataFrame:
    """The first n probes by seq, or all."""
    return probes.orderBy("seq").limit(n) if n else probes


def error_predicates(obs: DataFrame, fatal: tuple[str, ...], thinking: tuple[str, ...]) -> DataFrame:
    """Whether a row's error tells that going on is pointless, and whether its output is a thinking model's marker."""
    low = F.lower("error")
    hit = F.coalesce(F.exists(F.array(*(F.lit(m.lower()) for m in fatal)), lambda m: F.contains(low, m)), F.lit(False))
    return obs.withColumns({"fatal": hit, "thinking": F.col("error").isNull() & F.col("output_text").isin(*thinking)})
