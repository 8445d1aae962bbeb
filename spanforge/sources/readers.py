"""Readers: probes, response logs, banks, pair tables, manifests, truth tables, exclusion lists, configurations."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.operators import lineage
from spanforge.operators import probes as probes_

PROBES = "id string, text string, category string, truncation_ratio double, source_lang string, metadata map<string,string>"
RAW = (
    "raw_response struct<error: string, _raw_output_text: string, _output_normalization: struct<config: map<string,string>, applied: array<string>, changed: boolean>, "
    "_empty_output_retry: struct<configured_retries: int, attempt_count: int, empty_retries_used: int, empty_response_count: int, recovered_after_empty: boolean, final_is_empty: boolean>>"
)
OBSERVATION = "probe_id string, model_name string, output_text string, char_length int, byte_length int, has_leading_space boolean, has_leading_newline boolean, token_type string, is_empty boolean, latency_ms double, " + RAW


def probes(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A JSON array of probes, or a folder of JSON lines; missing optional fields take their defaults."""
    df = spark.read.schema(PROBES).option("multiLine", not lines).json(path)
    return df.select(F.col("id").alias("probe_id"), "text", "category", F.coalesce("truncation_ratio", F.lit(0.0)).alias("truncation_ratio"), F.coalesce("source_lang", F.lit("mixed")).alias("source_lang"), "metadata")


def observations(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """JSON lines of results, with seq in order of file and line. strict: a bad line fails the read; otherwise
    lines that aren't objects are skipped. An error is the presence of its key, even with a null value."""
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", "_metadata.file_path", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    parsed = lines.withColumns({"v": F.try_parse_json("value"), "r": F.from_json("value", OBSERVATION)})
    ok = F.col("v").isNotNull() & (F.schema_of_variant("v").startswith("OBJECT"))
    if strict:
        parsed = parsed.withColumn("r", F.when(ok, F.col("r")).otherwise(F.raise_error(F.concat(F.lit("bad line: "), F.substring("value", 1, 200)))))
    else:
        parsed = parsed.where(ok)
    error = F.when(F.expr("variant_get(v, '$.raw_response.error') is not null"), F.coalesce("r.raw_response.error", F.lit("")))
    # line numbers grow with files' splits, which Spark reads in order of path and block
    return parsed.select("r.*", error.alias("error"), F.col("line").alias("seq"))


def bank_index(spark: SparkSession, path: str) -> DataFrame:
    """The bank's models in order: model_name, family, path, n_probes, bank_ord."""
    schema = "models array<struct<model_name: string, family: string, path: string, n_probes: bigint>>"
    rows = spark.read.text(path, wholetext=True)
    both = F.coalesce(F.from_json("value", schema)["models"], F.from_json("value", schema.removeprefix("models ")))
    return rows.select(F.posexplode(both).alias("bank_ord", "m")).select("m.*", "bank_ord")


def pair_table(spark: SparkSession, path: str) -> DataFrame:
    """Scored pairs from a comparison's CSV, or from the `pairs` array of its JSON."""
    if path.endswith(".csv"):
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    df = spark.read.option("multiLine", True).json(path)
    return df.select(F.explode("pairs").alias("p")).select("p.*")


def bank(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a saved bank with family and ord, in the order of its index."""
    index = bank_index(spark, f"{path}/index.json").select("model_name", F.col("bank_ord").alias("ord"))
    rows = spark.read.parquet(f"{path}/rows").drop("model", "ord")
    return rows.join(index, "model_name")


def fingerprints(spark: SparkSession, path: str, sidecar: str | None = None) -> DataFrame:
    """Rows of saved fingerprints; models without embedded rows take those of the sidecar logs. Neither gives no rows."""
    df = spark.read.option("multiLine", True).json(path)
    kind = dict(df.dtypes).get("raw_results", "")
    own = df.select("model_name", F.explode("raw_results").alias("r")).select("model_name", "r.probe_id", "r.output_text") if "struct" in kind else None
    if own is None:
        own = spark.createDataFrame([], "model_name string, probe_id string, output_text string")
    if sidecar is None:
        return own
    rest = observations(spark, sidecar).select("model_name", "probe_id", "output_text")
    return own.union(rest.join(own.select("model_name").distinct(), "model_name", "left_anti"))


def features(spark: SparkSession, path: str) -> DataFrame:
    """The features that sinks.fingerprints() saved, a row per model."""
    return spark.read.json(f"{path}/fingerprints")


def exclude_list(spark: SparkSession, path: str) -> DataFrame:
    """Probe ids from a list of ids, a list of objects with an id, or {"blacklist": such a list}. Empty is an error."""
    v = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    items = v.select(F.explode(F.expr("coalesce(try_variant_get(v, '$.blacklist', 'array<variant>'), try_variant_get(v, '$', 'array<variant>'))")).alias("x"))
    one = F.expr("coalesce(try_variant_get(x, '$.probe_id', 'string'), try_variant_get(x, '$.id', 'string'), case when schema_of_variant(x) = 'STRING' then try_variant_get(x, '$', 'string') end)")
    out = items.select(one.alias("probe_id")).where("probe_id is not null").distinct()
    if out.isEmpty():
        raise ValueError(f"no probe ids in {path}")
    return out


def truth_table(spark: SparkSession, path: str) -> DataFrame:
    """(model_name, target_model) from an indented list: `model:` lines followed by `- target` lines; none is ignored."""
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    return truth_lines(lines)


def truth_lines(lines: DataFrame) -> DataFrame:
    """The same from rows (n, value)."""
    head = F.nullif(F.regexp_extract("value", r"^\s*([^\s#:\-][^:]*):\s*$", 1), F.lit(""))
    item = F.nullif(F.regexp_extract("value", r"^\s*-\s*(\S.*?)\s*$", 1), F.lit(""))
    rows = lines.select("n", head.alias("head"), F.regexp_replace(item, "^[\"']|[\"']$", "").alias("target_model"))
    current = F.last("head", ignorenulls=True).over(Window.orderBy("n"))  # a file written by hand
    return rows.withColumn("model_name", current).where("target_model is not null and lower(target_model) <> 'none' and model_name is not null").select("model_name", "target_model")


def articles(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """(id, title, url, text, row_index) of a JSON or Parquet table of articles."""
    df = spark.read.parquet(path) if path.rstrip("/").endswith("parquet") else spark.read.json(path)
    df = df.withColumn("row_index", F.monotonically_increasing_id())
    return df.orderBy("row_index").limit(max_rows) if max_rows else df


def hf_vocab(spark: SparkSession, path: str, model: str) -> DataFrame:
    """(model, token, id) of a tokenizer.json."""
    v = spark.read.text(path, wholetext=True).select(F.from_json("value", "model struct<vocab: map<string,int>>")["model"]["vocab"].alias("m"))
    return v.select(F.lit(model).alias("model"), F.explode("m").alias("token", "id"))


MANIFEST = "name string, family string, model_id string, source string, local_dir string, encoding string, role string, preferred_rank int"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a tokenizer manifest (a JSON array, or an object with `tokenizers`), with ord and defaults; entries that
    lack what their source needs, and repeated names, are an error."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.posexplode(F.coalesce(F.from_json("value", f"tokenizers array<struct<{_struct(MANIFEST)}>>")["tokenizers"], F.from_json("value", f"array<struct<{_struct(MANIFEST)}>>"))).alias("ord", "e")).select("ord", "e.*")
    rows = rows.withColumns({"role": F.coalesce("role", F.lit("other")), "source": F.coalesce("source", F.lit("hf")), "preferred_rank": F.coalesce("preferred_rank", F.lit(1000))})
    bad = [f"{r.name}: {r.problem}" for r in lineage.invalid_entries(rows).collect()] + [f"{r['name']}: {r['n']} entries" for r in lineage.duplicates(rows, "name").collect()]
    if bad:
        raise ValueError("manifest: " + "; ".join(bad))
    return rows


def _struct(ddl: str) -> str:
    return ", ".join(f"{a}: {b}" for a, b in (x.strip().split(" ", 1) for x in ddl.split(",")))


# Texts whose encodings are compared where none are given.
SAMPLES = (
    "Hello world", "The tokenizer reveals ", "A leading-space boundary", "你好，世界", "中文 English mixed 123", "def foo(x): return x + 1", '{"model": "qwen", "temperature":', "https://example.com/path?a=1",
)


def encoding_samples(spark: SparkSession, path: str | None = None, most: int = 128) -> DataFrame:
    """(text, seq): the first distinct texts of a JSON list of strings or objects with a text; without a file the defaults."""
    if path is None:
        rows = spark.createDataFrame(list(enumerate(SAMPLES)), "seq int, text string")
    else:
        v = spark.read.text(path, wholetext=True).select(F.posexplode(F.expr("try_variant_get(parse_json(value), '$', 'array<variant>')")).alias("seq", "x"))
        text = F.expr("coalesce(try_variant_get(x, '$.text', 'string'), case when schema_of_variant(x) = 'STRING' then try_variant_get(x, '$', 'string') end)")
        rows = v.select("seq", text.alias("text")).where("text is not null and text <> ''")
    return probes_.distinct_first_n(rows, most)


def hf_encodings(spark: SparkSession, path: str, model: str, samples: DataFrame) -> DataFrame:
    """(model, sample, ids) of the samples under a tokenizer.json, by the library, without special tokens. The file's text goes
    along with the plan, so executors need not see it."""
    spec = spark.read.text(path, wholetext=True).first()[0]

    def run(batches):
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(spec)
        for b in batches:
            yield b.assign(model=model, sample=b["text"], ids=[library.encode(t, add_special_tokens=False).ids for t in b["text"]])[["model", "sample", "ids"]]

    return samples.select("text").mapInPandas(run, "model string, sample string, ids array<int>")


def tiktoken_vocab(spark: SparkSession, path: str, model: str, specials: dict[str, int] | None = None) -> DataFrame:
    """(model, token, id) of a file of ranks: a base64 token and its rank a line."""
    line = F.split("value", " ")
    ranks = spark.read.text(path).where(F.trim("value") != "").select(F.unbase64(line[0]).alias("bytes"), line[1].cast("int").alias("id"))
    special = spark.createDataFrame(list((specials or {}).items()), "text string, id int")
    return lineage.tiktoken_tokens(ranks, special).select(F.lit(model).alias("model"), "token", "id")


# Files of a tokenizer, and those of which one must be there.
TOKENIZER_FILES = ("tokenizer.json", "tokenizer.model", "tokenizer_config.json", "special_tokens_map.json", "added_tokens.json", "vocab.json", "merges.txt", "config.json", "generation_config.json")
CORE_FILES = ("tokenizer.json", "tokenizer.model", "vocab.json")


def download_tokenizer(model_id: str, folder: str, fetch, revision: str = "main", base: str = "https://huggingface.co") -> list[str]:
    """Save a model's tokenizer files below folder/model__id. fetch(url) gives the bytes, or None where there is no such
    file. Without a core file that is an error."""
    at = os.path.join(folder, model_id.replace("/", "__"))
    os.makedirs(at, exist_ok=True)
    have = []
    for name in TOKENIZER_FILES:
        body = fetch(f"{base}/{model_id}/resolve/{revision}/{name}")
        if body is not None:
            with open(os.path.join(at, name), "wb") as f:
                f.write(body)
            have.append(name)
    if not set(have) & set(CORE_FILES):
        raise ValueError(f"{model_id} has none of {', '.join(CORE_FILES)}")
    return have


def resolve_env(value: str) -> str:
    """${NAME} from the environment."""
    return re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m[1], ""), value)


def config(path: str) -> dict:
    """A YAML configuration with ${NAME} resolved."""
    import yaml

    def walk(x):
        return {k: walk(v) for k, v in x.items()} if isinstance(x, dict) else [walk(v) for v in x] if isinstance(x, list) else resolve_env(x) if isinstance(x, str) else x

    with open(path, encoding="utf-8") as f:
        return walk(yaml.safe_load(f)) or {}
