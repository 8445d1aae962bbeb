import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from spanforge.__main__ import main


@pytest.fixture
def bank(tmp_path):
    models = [("a1", "a"), ("a2", "a"), ("b1", "b")]
    (tmp_path / "index.json").write_text(json.dumps({"models": [{"model_name": m, "family": f, "path": m, "n_probes": 20} for m, f in models]}))
    rows = [{"probe_id": str(i), "model_name": m, "output_text": "x" if (i * (k + 1)) % 5 else " the", "raw_response": {}} for i in range(20) for k, (m, _) in enumerate(models)]
    (tmp_path / "log.jsonl").write_text("\n".join(map(json.dumps, rows)))
    return ["--logs", str(tmp_path / "log.jsonl"), "--index", str(tmp_path / "index.json")]


def test_commands(spark, bank, tmp_path, capsys):
    assert main(["compare-bank", *bank, "--output", str(tmp_path / "pairs")]) == 0
    assert "n_cross_pairs" in capsys.readouterr().out
    assert spark.read.option("header", True).csv(str(tmp_path / "pairs")).count() == 3
    main(["detect", *bank, "--target", "a1", "--method", "soft"])
    assert json.loads(capsys.readouterr().out)["target"] == "a1"
    main(["compare", *bank, "a1", "b1"])
    assert "bcs" in capsys.readouterr().out
    (tmp_path / "truth.yaml").write_text("truth:\n  a1:\n    - a2\n")
    main(["vocab", *bank, "--truth", str(tmp_path / "truth.yaml")])
    assert "score_threshold" in capsys.readouterr().out
    main(["stability", *bank])


def test_probe_command(spark, tmp_path):
    text = "Die Bundesregierung hat gestern eine wichtige Entscheidung über Donaudampfschiffe getroffen. Zweiter Satz mit Wörterbuchern."
    (tmp_path / "docs.json").write_text(json.dumps({"id": "1", "title": "t", "url": "u", "text": text}))
    main(["generate-probes", "--documents", str(tmp_path / "docs.json"), "--lang", "de", "--count", "5", "--output", str(tmp_path / "out")])
    rows = spark.read.json(str(tmp_path / "out")).collect()
    assert len(rows) == 5 and all(r.id.startswith("german_partial_") for r in rows)


class Endpoint(BaseHTTPRequestHandler):
    """Answers with the last word of the prompt; model b with its length."""

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["content-length"])))
        text = body["messages"][-1]["content"]
        answer = " " + text.split()[-1] if body["model"].startswith("a") else str(len(text))
        out = json.dumps({"choices": [{"message": {"content": answer}}]}).encode()
        self.send_response(200)
        self.send_header("content-length", str(len(out)))
        self.end_headers()
        self.wfile.write(out)

    def log_message(self, *_):
        pass


@pytest.fixture
def endpoint():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Endpoint)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1"
    server.shutdown()


def test_asking_commands(spark, endpoint, tmp_path, capsys):
    main(["template-probes", "--count", "40", "--output", str(tmp_path / "probes")])
    assert spark.read.json(str(tmp_path / "probes")).count() == 40
    targets = [{"name": m, "model": m, "family": m[0], "base_url": endpoint, "api_key": "k"} for m in ("a1", "b1", "b2")]
    config = tmp_path / "c.yaml"
    config.write_text(json.dumps({"targets": targets}))
    common = ["--config", str(config), "--probes", str(tmp_path / "probes"), "--logs", str(tmp_path / "log")]
    main(["build-reference", *common, "--bank", str(tmp_path / "ref"), "--output", str(tmp_path / "run"), "--status", str(tmp_path / "status.jsonl")])
    summary = json.loads(spark.read.text(str(tmp_path / "run/summary.json")).first()[0])
    assert summary["status"] == "completed" and summary["config"]["targets"][0]["api_key"] == "***" and len(summary["stage_elapsed_seconds"]) == 4
    assert json.loads((tmp_path / "status.jsonl").read_text().splitlines()[-1])["event"] == "completed"
    config.write_text(json.dumps({"targets": [{**targets[0], "name": "a2", "model": "a2"}]}))
    capsys.readouterr()
    main(["detect-online", *common, "--bank", str(tmp_path / "ref"), "--repeats", "2"])
    found = json.loads(capsys.readouterr().out)
    assert found["target"] == "a2" and found["same_source_of"] in ("a1", None)
    assert spark.read.json(str(tmp_path / "log")).where("model_name = 'a2'").count() == 44
    main(["collect", *common, "--repeats", "2"])
    assert spark.read.json(str(tmp_path / "log")).where("model_name = 'a2'").count() == 44


def test_tokenizer_command(spark, tmp_path):
    import public_tokenizers

    for name in ("byte_bpe_50k", "word_bpe_49k"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "tokenizer.json").write_bytes(open(public_tokenizers.path(f"{name}.json"), "rb").read())
    entries = [{"name": n, "family": "f", "model_id": n, "source": "hf", "local_dir": str(tmp_path / d), "role": "base"} for n, d in (("x", "byte_bpe_50k"), ("y", "byte_bpe_50k"), ("z", "word_bpe_49k"))]
    (tmp_path / "m.json").write_text(json.dumps(entries))
    main(["tokenizer-baselines", "--manifest", str(tmp_path / "m.json"), "--output", str(tmp_path / "out")])
    report = json.loads(spark.read.text(str(tmp_path / "out/report.json"), wholetext=True).first()[0])
    assert report["baselines"] == sorted(report["baselines"], key=lambda r: r["baseline_id"]) or len(report["baselines"]) == 2
    assert {p["model_a"] + p["model_b"]: p["equivalence_label"] for p in report["pairs"]} == {"xy": "hard_equivalent", "xz": "distinct", "yz": "distinct"}
