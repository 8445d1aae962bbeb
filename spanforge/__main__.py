"""Command line: python -m spanforge COMMAND --help."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge import api
from spanforge.operators import generator, observations, probes, similarity, vocabulary
from spanforge.sources import connector, readers, sinks, status


def _bank(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    models = readers.bank_index(spark, a.index).withColumnRenamed("bank_ord", "ord")
    return api.build_bank(readers.observations(spark, a.logs, strict=not a.lenient), models)


def _exclude(spark: SparkSession, a: argparse.Namespace) -> DataFrame | None:
    return readers.exclude_list(spark, a.exclude_probes) if a.exclude_probes else None


def _weights(a: argparse.Namespace) -> dict | None:
    return readers.config(a.config).get("scoring", {}).get("soft_bcs", {}).get("weights") if a.config else None


def compare_bank(spark, a):
    out = api.compare_bank(_bank(spark, a), _exclude(spark, a), a.method, a.top_k, _weights(a))
    if a.output:
        sinks.comparison(out["pairs"], a.output)
    for name in ("statistics", "summary"):
        print(f"\n## {name}\n\n{sinks.markdown(out[name])}")


def compare(spark, a):
    print(sinks.markdown(api.compare(_bank(spark, a), a.model_a, a.model_b, a.method)))


def detect(spark, a):
    row = api.detect(_bank(spark, a), a.target, _exclude(spark, a), a.method, _weights(a)).first()
    print(json.dumps(row.asDict(), ensure_ascii=False, indent=2))


def vocab(spark, a):
    bank = _bank(spark, a)
    if a.output:
        sinks.vocabulary(vocabulary.ranked(bank), a.output)
    truth = readers.truth_table(spark, a.truth) if a.truth else None
    out = api.compare_vocabularies(bank, truth)
    for name in ("models", "report") + (("sweep",) if truth is not None else ()):
        print(f"\n## {name}\n\n{sinks.markdown(out[name])}")


def generate_probes(spark, a):
    spec = probes.LANGUAGES[a.lang]
    docs = readers.articles(spark, a.documents, a.max_rows)
    docs = docs.withColumn("text", probes.normalize(F.col("text"), a.legacy_controls))
    chosen = probes.sample(probes.candidates(docs, spec), a.count, a.seed)
    sinks.probes(chosen.select(F.col("probe_id").alias("id"), F.col("probe_text").alias("text"), "category", F.col("ratio").alias("truncation_ratio"), F.lit(spec.lang).alias("source_lang")), a.output)


def template_probes(spark, a):
    rows = generator.generate(spark, a.count, seed=a.seed)
    sinks.probes(rows.select(F.col("probe_id").alias("id"), "text", "category", "truncation_ratio", "source_lang"), a.output)


def _probes(spark, a) -> DataFrame:
    rows = readers.probes(spark, a.probes, lines=not a.probes.endswith(".json")).select("probe_id", "text")
    rows = rows.withColumn("seq", F.monotonically_increasing_id())  # the file's order
    rows = observations.exclude(rows, readers.exclude_list(spark, a.exclude_probes)) if a.exclude_probes else rows
    return observations.first_probes(rows, a.first)


def _collect(spark, a, options: connector.Options, log: status.RunLog) -> None:
    """Ask an endpoint what its log lacks, the stability sample several times."""
    prompts = _probes(spark, a)
    sample = similarity.stability_sample(prompts.withColumn("model_name", F.lit(options.model)), a.stability_ratio) if a.repeats > 1 else prompts.limit(0)
    prompts = connector.with_repeats(prompts, sample, a.repeats)
    with log.stage(f"collect {options.model}"):
        connector.collect_to(a.logs, prompts, options, partitions=a.partitions, progress=log.progress)


def _run(spark, a, mode: str, work) -> None:
    """A run over the configured endpoints: logged, with a summary whether it ends well or not."""
    config = readers.config(a.config)
    endpoints, skipped = connector.targets(config.get("targets", []), a.only)
    for name in skipped:
        print(f"{name}: no key, left out", file=sys.stderr)
    if not endpoints:
        raise SystemExit("no endpoint to ask")
    log, error = status.RunLog(a.status, mode), None
    try:
        with log.running(len(endpoints)):
            work(endpoints, log)
    except BaseException as e:
        error = f"{type(e).__name__}: {e}"
        raise
    finally:
        if a.output:
            sinks.summary(spark, a.output, mode=mode, status="failed" if error else "completed", seconds=round(time.monotonic() - log.began, 3), stages=log.stages, config=config, counts={"endpoints": len(endpoints), "skipped": skipped}, error=error)


def collect(spark, a):
    _run(spark, a, "collect", lambda endpoints, log: [_collect(spark, a, o, log) for o in endpoints])


def build_reference(spark, a):
    """Ask all endpoints and save their bank and fingerprints."""
    families = {c.get("name") or c.get("model"): c.get("family", "") for c in readers.config(a.config).get("targets", [])}

    def work(endpoints, log):
        for o in endpoints:
            _collect(spark, a, o, log)
        with log.stage("bank"):
            models = spark.createDataFrame([(o.model, families.get(o.model, ""), i) for i, o in enumerate(endpoints)], "model_name string, family string, ord int")
            bank = api.build_bank(readers.observations(spark, a.logs, strict=False), models)
            sinks.bank(observations.first_results(bank), f"{a.bank}/bank")
            sinks.fingerprints(api.fingerprint(bank, readers.probes(spark, a.probes, lines=not a.probes.endswith(".json"))), bank, a.bank)

    _run(spark, a, "build-reference", work)


def detect_online(spark, a):
    """Ask one endpoint and compare its answers with a saved bank."""

    def work(endpoints, log):
        for o in endpoints:
            _collect(spark, a, o, log)
            with log.stage(f"detect {o.model}"):
                known = readers.bank(spark, f"{a.bank}/bank")
                own = readers.observations(spark, a.logs, strict=False).where(F.col("model_name") == o.model)
                own = own.withColumns({"family": F.lit("?"), "ord": F.lit(1 << 20)})
                columns = ["model_name", "family", "ord", "probe_id", "seq", "output_text", "error"]
                known = known.where(F.col("model_name") != o.model).withColumn("error", F.lit(None).cast("string"))
                both = known.select(*(F.col(c).cast("bigint") if c in ("seq", "ord") else F.col(c) for c in columns)).union(own.select(*(F.col(c).cast("bigint") if c in ("seq", "ord") else F.col(c) for c in columns)))
                print(json.dumps(api.detect(both, o.model, method=a.method).first().asDict(), ensure_ascii=False, indent=2))

    _run(spark, a, "detect-online", work)


def tokenizer_baselines(spark, a):
    """Compare the tokenizers of a manifest and report their lineages."""
    meta = readers.manifest(spark, a.manifest)
    samples = readers.encoding_samples(spark, a.samples, a.most_samples).persist()
    entries = meta.orderBy("ord").collect()  # a row per tokenizer
    vocab = enc = None
    for r in entries:
        if r.source == "hf":
            path = f"{r.local_dir}/tokenizer.json"
            v, e = readers.hf_vocab(spark, path, r.name), readers.hf_encodings(spark, path, r.name, samples)
        else:
            v, e = readers.tiktoken_vocab(spark, r.encoding, r.name), spark.createDataFrame([], "model string, sample string, ids array<int>")
        vocab, enc = (v, e) if vocab is None else (vocab.union(v), enc.union(e))
    meta = meta.withColumn("special_tokens", F.lit(None).cast("string"))
    out = api.tokenizer_baselines(vocab, enc, meta)
    facts = {"models": len(entries), "families": len({r.family for r in entries}), "baselines": out["registry"].count(), "encoding samples": samples.count()}
    sinks.report({"baselines": out["registry"], "lineages": out["metrics"], "pairs": out["pairs"]}, a.output, "Tokenizer baselines", facts)


def stability(spark, a):
    bank = _bank(spark, a)
    print(sinks.markdown(similarity.stability(bank).join(similarity.stability_modal(bank), "model_name", "left")))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="spanforge", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(f, bank=True):
        c = sub.add_parser(f.__name__.replace("_", "-"))
        c.set_defaults(run=f)
        c.add_argument("--config", help="YAML with scoring weights")
        c.add_argument("--output")
        if bank:
            c.add_argument("--logs", required=True, help="JSON lines of results")
            c.add_argument("--index", required=True, help="the bank's index.json")
            c.add_argument("--lenient", action="store_true", help="skip bad lines")
            c.add_argument("--method", choices=("strict", "soft"), default="strict")
            c.add_argument("--exclude-probes")
        return c

    command(compare_bank).add_argument("--top-k", type=int, default=5)
    c = command(compare)
    c.add_argument("model_a")
    c.add_argument("model_b")
    command(detect).add_argument("--target", required=True)
    command(vocab).add_argument("--truth")
    command(stability)
    c = command(generate_probes, bank=False)
    c.add_argument("--documents", required=True)
    c.add_argument("--lang", choices=sorted(probes.LANGUAGES), required=True)
    c.add_argument("--count", type=int, default=500)
    c.add_argument("--seed", type=int, default=42)
    c.add_argument("--max-rows", type=int)
    c.add_argument("--legacy-controls", action="store_true", help="keep control characters")
    c = command(template_probes, bank=False)
    c.add_argument("--count", type=int, default=500)
    c.add_argument("--seed", type=int, default=42)
    for f in (collect, build_reference, detect_online):
        c = command(f, bank=False)
        c.add_argument("--probes", required=True, help="a JSON array, or a folder of JSON lines")
        c.add_argument("--logs", required=True, help="folder of the response log; what it holds isn't asked again")
        c.add_argument("--only", nargs="*", help="names of the endpoints to ask")
        c.add_argument("--first", type=int, help="only the first probes")
        c.add_argument("--exclude-probes")
        c.add_argument("--repeats", type=int, default=1)
        c.add_argument("--stability-ratio", type=float, default=0.1)
        c.add_argument("--partitions", type=int, default=1)
        c.add_argument("--status", help="a file for one JSON line per event")
        c.add_argument("--method", choices=("strict", "soft"), default="strict")
        if f is not collect:
            c.add_argument("--bank", required=True)
    c = command(tokenizer_baselines, bank=False)
    c.add_argument("--manifest", required=True)
    c.add_argument("--samples")
    c.add_argument("--most-samples", type=int, default=128)
    a = p.parse_args(argv)
    began = time.time()
    a.run(SparkSession.builder.appName("spanforge").getOrCreate(), a)
    print(json.dumps({"command": a.command, "seconds": round(time.time() - began, 1)}), file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
