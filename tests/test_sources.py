import json
import os
import signal
import sys
import threading
import time
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.errors import PySparkException

from spanforge import api
from spanforge.sources import connector, readers, servers, sinks, status
from spanforge.streaming import vocab_stream


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_probe_defaults(spark, tmp_path):
    r = readers.probes(spark, write(tmp_path / "p.json", json.dumps([{"id": "1", "text": "t", "category": "c"}]))).first()
    assert (r.probe_id, r.truncation_ratio, r.source_lang) == ("1", 0.0, "mixed")


def test_observation_lines(spark, tmp_path):
    lines = [{"probe_id": "1", "model_name": "m", "output_text": "a", "raw_response": {}}, {"probe_id": "2", "model_name": "m", "output_text": "", "raw_response": {"error": None}}]
    path = write(tmp_path / "o.jsonl", "\n".join(map(json.dumps, lines)) + "\n\n")
    rows = readers.observations(spark, path).orderBy("seq").collect()
    assert [r.error for r in rows] == [None, ""]
    bad = write(tmp_path / "b.jsonl", json.dumps(lines[0]) + "\nnot json\n[1]\n")
    assert readers.observations(spark, bad, strict=False).count() == 1
    with pytest.raises(PySparkException):
        readers.observations(spark, bad).collect()


def test_exclusions(spark, tmp_path):
    for x in (["1", "2"], [{"id": "1"}, {"id": "2"}], {"blacklist": ["1", {"probe_id": "2"}]}):
        assert sorted(r.probe_id for r in readers.exclude_list(spark, write(tmp_path / "x.json", json.dumps(x))).collect()) == ["1", "2"]
    with pytest.raises(ValueError):
        readers.exclude_list(spark, write(tmp_path / "x.json", "[]"))


def test_truth(spark, tmp_path):
    got = readers.truth_table(spark, write(tmp_path / "t.yaml", "truth:\n  m1:\n    - m2\n    - m3\n  m4:\n    - none\n  m5:\n    - m1\n"))
    assert sorted(map(tuple, got.collect())) == [("m1", "m2"), ("m1", "m3"), ("m5", "m1")]


def test_bank_index_and_config(spark, tmp_path, monkeypatch):
    path = write(tmp_path / "index.json", json.dumps({"models": [{"model_name": "b", "family": "f", "path": "p", "n_probes": 3}, {"model_name": "a", "family": "f", "path": "q", "n_probes": 3}]}))
    assert [(r.bank_ord, r.model_name) for r in readers.bank_index(spark, path).orderBy("bank_ord").collect()] == [(0, "b"), (1, "a")]
    monkeypatch.setenv("A_KEY", "k")
    assert readers.resolve_env("${A_KEY}x") == "kx"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("m", 1, 'a"b', 2, 0.5)], "model_name string, rank int, token string, n int, share double")
    sinks.vocabulary(df, str(tmp_path / "v"))
    assert spark.read.option("header", True).csv(str(tmp_path / "v")).first().share == "0.50000000" and len(spark.read.option("header", True).csv(str(tmp_path / "v")).columns) == 9
    sinks.vocabulary(df, str(tmp_path / "v"), layout="run")
    assert spark.read.option("header", True).csv(str(tmp_path / "v")).columns == ["model_name", "next_token", "frequency", "share", "rank", "char_length", "byte_length"]
    assert sinks.markdown(df).splitlines()[0] == "| model_name | rank | token | n | share |"
    rows = spark.createDataFrame([("1", ("e", "x"))], "probe_id string, raw_response struct<error: string, other: string>")
    sinks.append_observations(rows, str(tmp_path / "o"))
    sinks.append_observations(rows, str(tmp_path / "o"))
    back = spark.read.json(str(tmp_path / "o"))
    assert back.count() == 2 and back.select("raw_response.*").columns == ["error"]


class Stub:
    def __init__(self, *answers):
        self.answers, self.asked = list(answers), []

    def __call__(self, url, headers, payload):
        self.asked.append((url, payload))
        return self.answers.pop(0) if len(self.answers) > 1 else self.answers[0]


CHAT = lambda t: (200, {}, {"choices": [{"message": {"content": t}}]})
TEXT = lambda t: (200, {}, {"choices": [{"text": t}]})


def client(stub, **o):
    waits = []
    return connector.Client(connector.Options("m", "http://h/v1", retry_delay=1.0, **o), stub, waits.append), waits


def test_missing_template_falls_back_for_good():
    stub = Stub((400, {}, "no chat template"), TEXT("a"), TEXT("b"))
    c, _ = client(stub)
    assert [c.ask("1", "x")["output_text"], c.ask("2", "x")["output_text"]] == ["a", "b"]
    assert [u.rsplit("/", 1)[1] for u, _ in stub.asked] == ["completions"] * 3 and "prompt" in stub.asked[2][1]


def test_retries():
    c, waits = client(Stub((429, {"Retry-After": "7"}, ""), (503, {}, ""), CHAT("x")))
    assert c.ask("1", "t")["output_text"] == "x" and waits == [7.0, 2.0]
    c, waits = client(Stub((404, {}, "gone")))
    assert c.ask("1", "t")["error"].startswith("HTTP 404") and waits == []


def test_empty_outputs_are_asked_again():
    c, _ = client(Stub(CHAT(""), CHAT("x")), empty_retries=3)
    r = c.ask("1", "t")
    assert r["recovered_after_empty"] and r["empty_retries_used"] == 1
    c, _ = client(Stub(CHAT("")), empty_retries=2)
    r = c.ask("1", "t")
    assert r["is_empty"] and r["empty_retries_used"] == 2 and r["error"] is None


def test_batches_that_tell_to_stop():
    with pytest.raises(connector.ConfigurationError):
        connector.check_batch([{"error": "HTTP 401: invalid api key", "output_text": ""}])
    with pytest.raises(connector.ConfigurationError):
        connector.check_batch([{"error": None, "output_text": "<think>"}] * 2)
    connector.check_batch([{"error": None, "output_text": "a"}] * 2)


def test_overrides():
    assert connector.validate_overrides({"temperature": 0.5}) == {"temperature": 0.5}
    for bad in ({"temperature": 3}, {"x": 1}, {"max_tokens": True}):
        with pytest.raises(ValueError):
            connector.validate_overrides(bad)


def test_anthropic_request():
    stub = Stub((200, {}, {"content": [{"text": "a"}]}))
    c, _ = client(stub, provider="anthropic", system="s", api_key="k")
    assert c.ask("1", "t")["output_text"] == "a" and stub.asked[0][1]["system"] == "s" and stub.asked[0][0].endswith("/messages")


def test_collect(spark):
    prompts = spark.createDataFrame([(str(i), f"t{i}") for i in range(9)], "probe_id string, text string")
    out = connector.collect(prompts, connector.Options("m", "http://h"), lambda u, h, p: CHAT(p["messages"][-1]["content"][-1]), 2).collect()
    assert {r.probe_id: r.output_text for r in out} == {str(i): str(i) for i in range(9)}
    assert connector.with_repeats(prompts, prompts.limit(2), 3).count() == 13


def test_fatal_markers():
    for bad in ("HTTP 400: x", "http 404: gone", "HTTP 401", "Model does not exist", "model_not_found", "Forbidden", "invalid_request_error"):
        assert connector.is_fatal(bad)
    for passing in ("HTTP 500: request id 84031", "HTTP 503: 404 seconds", "timeout 403"):
        assert not connector.is_fatal(passing)
    for mark in connector.THINKING:
        with pytest.raises(connector.ConfigurationError):
            connector.check_batch([{"error": None, "output_text": mark}])


def test_message_modes():
    for mode in connector.PREFIX_MODES:
        c, _ = client(Stub(CHAT("a")), message_mode=mode)
        assert c.messages("text")[-1] == {"role": "assistant", "content": "text", "prefix": True} and len(c.messages("text")) == 3
    c, _ = client(Stub(CHAT("a")), message_mode="assistant_prefill", system=None)
    assert [m["role"] for m in c.messages("t")] == ["user", "assistant"] and "prefix" not in c.messages("t")[1]


def test_prepared_options(monkeypatch):
    make = lambda **o: connector.prepared(connector.Options(**({"model": "m", "base_url": "http://h/v1"} | o)))
    assert make().mode == "chat" and make(model="Qwen/Qwen3-8B-Base").mode == "completions" and make(base_url="http://h:18103/v1").mode == "completions"
    monkeypatch.setenv("SPANFORGE_FORCE_COMPLETIONS", "0")
    assert make(model="Qwen/Qwen3-8B-Base").mode == "chat"
    local = make(model="Qwen/Qwen3-4B", base_url="http://localhost:8000/v1", extra_body={"x": 1})
    assert local.extra_body == {"x": 1, "enable_thinking": False, "chat_template_kwargs": {"enable_thinking": False}}


def test_targets(monkeypatch):
    monkeypatch.setenv("HAVE", "k")
    found, skipped = connector.targets([{"name": "a", "model": "a", "base_url": "u", "api_key": "${HAVE}", "endpoint": "completions"}, {"model": "b", "base_url": "u", "api_key": "${HAVE_NOT}"}, {"model": "c", "base_url": "u"}])
    assert [(o.model, o.api_key, o.mode) for o in found] == [("a", "k", "completions"), ("c", "", "chat")] and skipped == ["b"]
    assert [o.model for o in connector.targets([{"model": "a", "base_url": "u"}, {"model": "c", "base_url": "u"}], ["c"])[0]] == ["c"]


def test_requests_leave_one_interval_apart():
    at, lock = [], threading.Lock()

    def transport(*_):
        with lock:
            at.append(time.monotonic())
        return CHAT("x")

    c = connector.Client(connector.Options("m", "http://h", min_interval=0.05), transport)
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda i: c.ask(str(i), "t"), range(8)))
    assert min(b - a for a, b in zip(sorted(at), sorted(at)[1:])) > 0.03


def test_log_goes_on_where_it_broke_off(spark, tmp_path):
    """Two probes of 20 are asked three times; the run breaks off in its third wave and is taken up again."""
    prompts = spark.createDataFrame([(str(i), f"t{i}", i, '{"seed": 7}' if i == 3 else None) for i in range(20)], "probe_id string, text string, seq int, extra string")
    asked = connector.with_repeats(prompts, prompts.where("seq in (2, 5)"), 3)
    assert [r.probe_id for r in asked.limit(9).collect()] == ["0", "1", "2", "2", "2", "3", "4", "5", "5"]
    path, options, marker = str(tmp_path / "log"), connector.Options("m", "http://h", max_retries=1), tmp_path / "down"

    def transport(_u, _h, p):
        if p["messages"][-1]["content"] == "t14" and marker.exists():
            return 401, {}, "unauthorized"
        return CHAT(f"{p['messages'][-1]['content']}{p.get('seed', '')}")

    marker.touch()
    options.concurrency = 1
    with pytest.raises(PySparkException):
        connector.collect_to(path, asked, options, lambda u, h, p: (401, {}, "unauthorized") if marker.exists() and int(p["messages"][-1]["content"][1:]) >= 14 else transport(u, h, p), wave=8)
    first = readers.observations(spark, path)
    assert first.count() == 16 and first.where("error is not null").count() == 0
    marker.unlink()
    told = []
    assert connector.collect_to(path, asked, options, transport, wave=8, progress=lambda *x: told.append(x)) == 8 and told == [(8, 8)]
    rows = readers.observations(spark, path).collect()
    assert Counter(r.probe_id for r in rows) == Counter({str(i): 3 if i in (2, 5) else 1 for i in range(20)})
    assert {r.output_text for r in rows if r.probe_id == "3"} == {"t37"}
    assert connector.collect_to(path, asked, options, transport) == 0


def test_bank_and_fingerprints_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("org/b:1", "f", 0, str(i), "c", i, "x" * (i % 3), None) for i in range(9)] + [("a", "g", 1, str(i), "c", i, " y", None) for i in range(9)], "model_name string, family string, ord int, probe_id string, category string, seq bigint, output_text string, error string")
    sinks.bank(rows, str(tmp_path / "bank"))
    back = readers.bank(spark, str(tmp_path / "bank"))
    key = lambda df: sorted(map(tuple, df.select("ord", "model_name", "family", "probe_id", "output_text").collect()))
    assert key(back) == key(rows)
    assert [(r.model_name, r.path, r.n_probes) for r in readers.bank_index(spark, str(tmp_path / "bank/index.json")).orderBy("bank_ord").collect()][0] == ("org/b:1", "rows/family=f/model=org_b_1", 9)
    sinks.fingerprints(api.fingerprint(rows), rows, str(tmp_path / "fp"))
    got = {r.model_name: r for r in readers.features(spark, str(tmp_path / "fp")).collect()}
    assert got["a"].leading_space_rate == 1.0 and got["org/b:1"].char_lengths["0"] == pytest.approx(1 / 3) and got["a"].types["whitespace_prefixed"] == 1.0
    assert readers.fingerprints(spark, str(tmp_path / "fp/fingerprints")).count() == 0
    assert readers.fingerprints(spark, str(tmp_path / "fp/fingerprints"), str(tmp_path / "fp/raw_results")).count() == 18


def test_reports_and_summary(spark, tmp_path):
    df = spark.createDataFrame([("m", 1, ["a", "b"])], "model string, n int, tokens array<string>")
    sinks.report({"models": df}, str(tmp_path / "r"), "Title", {"n": 1})
    assert json.loads(spark.read.text(str(tmp_path / "r/report.json"), wholetext=True).first()[0]) == {"n": 1, "models": [{"model": "m", "n": 1, "tokens": ["a", "b"]}]}
    assert "| m | 1 |" in "\n".join(r.value for r in spark.read.text(str(tmp_path / "r/report.md")).collect())
    assert spark.read.option("header", True).csv(str(tmp_path / "r/models.csv")).columns == ["model", "n", "tokens"]
    whole = sinks.summary(spark, str(tmp_path / "s"), mode="m", status="failed", seconds=1.0, stages={"a": 1.0}, config={"api_key": "x", "targets": [{"token": "y", "model": "z"}]}, error="e")
    assert whole["config"] == {"api_key": "***", "targets": [{"token": "***", "model": "z"}]} and json.loads(spark.read.text(str(tmp_path / "s/timing.json")).first()[0])["error"] == "e"


def test_run_log(tmp_path):
    log = status.RunLog(str(tmp_path / "status.jsonl"))
    with pytest.raises(status.Stopped), log.running(3):
        log.progress(1, 3)
        os.kill(os.getpid(), signal.SIGTERM)
        time.sleep(1)
    assert [json.loads(x)["event"] for x in (tmp_path / "status.jsonl").read_text().splitlines()] == ["total", "progress", "failed"]


def test_servers(tmp_path):
    command = [sys.executable, "-m", "http.server", "18765", "--bind", "127.0.0.1", "--directory", str(tmp_path)]
    with servers.serving(command, "http://127.0.0.1:18765/", wait=20, every=0.1) as p:
        assert p.poll() is None
    assert p.poll() is not None
    with pytest.raises(RuntimeError):
        with servers.serving([sys.executable, "-c", "raise SystemExit(3)"], "http://127.0.0.1:1/", wait=20, every=0.1):
            pass


def test_tokenizer_sources(spark, tmp_path):
    entry = {"name": "a", "family": "f", "model_id": "x/a", "source": "hf", "local_dir": "d", "role": "base"}
    path = write(tmp_path / "m.json", json.dumps({"tokenizers": [entry, {**entry, "name": "b", "source": "tiktoken", "encoding": "e"}]}))
    assert [(r.ord, r.name, r.preferred_rank) for r in readers.manifest(spark, path).orderBy("ord").collect()] == [(0, "a", 1000), (1, "b", 1000)]
    for bad in ([entry, entry], [{**entry, "local_dir": None}], [{**entry, "role": "boss"}]):
        with pytest.raises(ValueError):
            readers.manifest(spark, write(tmp_path / "m.json", json.dumps(bad)))
    assert readers.encoding_samples(spark).count() == 8
    samples = readers.encoding_samples(spark, write(tmp_path / "s.json", json.dumps(["x", {"text": "y"}, "x", ""])))
    assert [r.text for r in samples.orderBy("seq").collect()] == ["x", "y"]
    ranks = write(tmp_path / "r.tiktoken", "YQ== 0\nYg== 1\n")
    assert sorted((r.token, r.id) for r in readers.tiktoken_vocab(spark, ranks, "m", {"<end>": 2}).collect()) == [("b64:YQ==", 0), ("b64:Yg==", 1), ("special:<end>", 2)]
    files = {"tokenizer.json": b"{}", "merges.txt": b""}
    got = readers.download_tokenizer("x/a", str(tmp_path), lambda url: files.get(url.rsplit("/", 1)[1]))
    assert got == ["tokenizer.json", "merges.txt"] and (tmp_path / "x__a" / "tokenizer.json").read_bytes() == b"{}"
    with pytest.raises(ValueError):
        readers.download_tokenizer("x/b", str(tmp_path), lambda url: None)


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    line = lambda p, t, e=None: json.dumps({"probe_id": p, "model_name": "m", "output_text": t, "ts": "2024-01-01T00:00:00Z", "raw_response": {"error": e} if e else {}})
    write(folder / "a.jsonl", "\n".join([line("1", "x"), line("2", "x"), line("3", "", "boom")]))
    q = vocab_stream.to_table(vocab_stream.token_counts(vocab_stream.observations(spark, str(folder))), "vocab_so_far", str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [(r.token, r.n) for r in spark.table("vocab_so_far").collect()] == [("x", 2)]
