"""Response collection: one-token queries to text-generation endpoints as a partition-wise transformation.

Each partition queries its prompts in batches, at most `concurrency / partitions` at a time, and yields
result rows. collect_to() does that in waves, each of which is appended to the log before the next one is asked, so that an
interrupted or failed run loses one wave at most and goes on, by an anti-join, with what the log lacks. The HTTP layer is a
callable transport(url, headers, payload) -> (status, headers, body), so that tests and other clients can
stand in for it; by default the standard library's client is used.
"""

from __future__ import annotations

import json
import os
import re
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, fields
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.operators import observations as O
from spanforge.sources import readers, sinks

Transport = Callable[[str, dict, dict], tuple[int, dict, Any]]

# Request defaults, retried statuses, texts that tell fatal from passing failures, markers of thinking models,
# prompts of the message modes, models and a port that are always asked for plain completions.
DEFAULTS = {"max_tokens": 1, "temperature": 0, "top_p": 1}
PENALTIES = {"frequency_penalty": 0, "presence_penalty": 0}
RETRIED = (500, 502, 503, 504)
FATAL_MARKERS = ("HTTP 400", "HTTP 401", "HTTP 403", "HTTP 404", "model_not_found", "model does not exist", "invalid_request_error", "unauthorized", "forbidden")
THINKING = ("<think>", "Thinking", "thinking", "嗯", "首先", "好的", "Hmm", "我们", "We", "Okay")
SYSTEM = "直接续写，不要解释，不要补充说明。"
PREFILL = "继续上一条 assistant 消息的文本，只输出紧接着的后续内容。不要解释，不要另起段落，不要输出换行。"
CONTINUE = "Continue the assistant message exactly. Output only the immediate continuation, with no explanation, no preface, and no newline."
PREFIX_MODES = ("deepseek_chat_prefix", "chat_prefix_completion", "chat_prefix")
COMPLETION_MODELS = ("Qwen/Qwen2.5-7B", "Qwen/Qwen3-8B-Base", "LLM-Research/Meta-Llama-3-8B", "LLM-Research/Meta-Llama-3.1-8B")
COMPLETION_PORTS = (":18103/",)
LOCAL = ("http://127.0.0.1:", "http://localhost:")
NO_TEMPLATE = re.compile(r"(?i)chat template")
OVERRIDES = {"temperature": (0.0, 2.0), "top_p": (0.0, 1.0), "max_tokens": (1, 16), "frequency_penalty": (-2.0, 2.0), "presence_penalty": (-2.0, 2.0)}


class ConfigurationError(RuntimeError):
    """A whole batch failed for a reason that more requests won't mend."""


@dataclass
class Options:
    """One endpoint. api_key may be ${NAME}."""

    model: str
    base_url: str
    provider: str = "openai"  #: or anthropic
    api_key: str = ""
    mode: str = "chat"  #: or completions
    message_mode: str = "user_prompt"  #: or assistant_prefill, or one of PREFIX_MODES
    system: str | None = SYSTEM
    timeout: float = 300.0
    max_retries: int = 5
    retry_delay: float = 2.0
    empty_retries: int = 0
    empty_delay: float = 0.2
    concurrency: int = 8
    min_interval: float = 0.0
    strip_leading_newlines: bool = False
    extra_body: dict = field(default_factory=dict)


def is_fatal(error: str) -> bool:
    """Whether an error tells that more requests won't mend it."""
    return any(m.lower() in error.lower() for m in FATAL_MARKERS)


def prepared(o: Options) -> Options:
    """Options with what follows from the model and the address: plain completions for models without a chat template
    (unless $SPANFORGE_FORCE_COMPLETIONS is 0), thinking switched off for local models that would think."""
    changed = dict(o.__dict__, extra_body=json.loads(json.dumps(o.extra_body)))
    base = o.base_url.rstrip("/") + "/"
    if os.environ.get("SPANFORGE_FORCE_COMPLETIONS", "1") != "0" and (o.model in COMPLETION_MODELS or any(p in base for p in COMPLETION_PORTS)):
        changed["mode"] = "completions"
    if o.model.startswith("Qwen/Qwen3") and base.startswith(LOCAL):
        changed["extra_body"].setdefault("enable_thinking", False)
        kwargs = changed["extra_body"].setdefault("chat_template_kwargs", {})
        if isinstance(kwargs, dict):
            kwargs.setdefault("enable_thinking", False)
    return Options(**changed)


def targets(configs: list[dict], names: list[str] | None = None) -> tuple[list[Options], list[str]]:
    """Endpoints of a configuration's `targets`, those named if names are given, and the names of those that are left out
    because their key is missing."""
    known = {f.name for f in fields(Options)}
    out, skipped = [], []
    for c in configs:
        name = c.get("name") or c.get("model", "")
        if names and name not in names:
            continue
        key = re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m[1], ""), str(c.get("api_key") or ""))
        if "api_key" in c and not key:
            skipped.append(name)
            continue
        renamed = {"endpoint": "mode", "request_timeout": "timeout", "request_interval": "min_interval", "empty_output_retries": "empty_retries", "empty_retry_delay": "empty_delay", "system_prompt": "system"}
        given = {renamed.get(k, k): v for k, v in c.items()}
        out.append(prepared(Options(**({k: v for k, v in given.items() if k in known} | {"api_key": key}))))
    return out, skipped


def validate_overrides(given: dict) -> dict:
    """Hyperparameter overrides within their bounds."""
    for k, v in given.items():
        lo, hi = OVERRIDES.get(k, (None, None))
        if lo is None:
            raise ValueError(f"unknown hyperparameter {k}")
        if isinstance(v, bool) or not isinstance(v, (int, float)) or not lo <= v <= hi:
            raise ValueError(f"{k} must lie between {lo} and {hi}")
    return dict(given)


def http(url: str, headers: dict, payload: dict, timeout: float = 300.0) -> tuple[int, dict, Any]:
    """POST without proxies."""
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"content-type": "application/json", **headers})
    opener = urllib.request.build_opener(urllib.request.ProxyHandler({}))
    try:
        with opener.open(request, timeout=timeout) as r:
            return r.status, dict(r.headers), json.loads(r.read())
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), e.read().decode("utf-8", "replace")


class Client:
    """Requests, retries and fallbacks for one endpoint."""

    def __init__(self, options: Options, transport: Transport | None = None, sleep: Callable[[float], None] = time.sleep):
        self.o, self.sleep, self.completions = options, sleep, options.mode == "completions"
        self.transport = transport or (lambda u, h, p: http(u, h, p, options.timeout))
        self.key = re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m[1], ""), options.api_key)
        self.next, self.lock = 0.0, threading.Lock()

    def wait(self) -> None:
        """Until it is this request's turn. A slot is taken under the lock and waited for outside, so that threads leave one
        interval apart."""
        if self.o.min_interval <= 0:
            return
        with self.lock:
            now = time.monotonic()
            mine = max(now, self.next)
            self.next = mine + self.o.min_interval
        if mine > now:
            self.sleep(mine - now)

    def messages(self, text: str) -> list[dict]:
        out = [{"role": "system", "content": self.o.system}] if self.o.system and self.o.provider != "anthropic" else []
        if self.o.message_mode in PREFIX_MODES:
            return [*out, {"role": "user", "content": CONTINUE}, {"role": "assistant", "content": text, "prefix": True}]
        if self.o.message_mode == "assistant_prefill":
            return [*out, {"role": "user", "content": PREFILL}, {"role": "assistant", "content": text}]
        return [*out, {"role": "user", "content": text}]

    def request(self, text: str, extra: dict) -> tuple[str, dict, dict]:
        body = {"model": self.o.model, **DEFAULTS}
        base = self.o.base_url.rstrip("/")
        if self.o.provider == "anthropic":
            body["messages"] = self.messages(text)
            if self.o.system:
                body["system"] = self.o.system
            return f"{base}/messages", {"x-api-key": self.key, "anthropic-version": "2023-06-01"}, body | self.o.extra_body | extra
        body |= PENALTIES
        head = {"authorization": f"Bearer {self.key}"} if self.key else {}
        if self.completions:
            return f"{base}/completions", head, body | {"prompt": text} | self.o.extra_body | extra
        return f"{base}/chat/completions", head, body | {"messages": self.messages(text)} | self.o.extra_body | extra

    def text_of(self, body: dict) -> str:
        if self.o.provider == "anthropic":
            return "".join(x.get("text", "") for x in body.get("content", []))
        choice = (body.get("choices") or [{}])[0]
        return (choice.get("text") if self.completions else (choice.get("message") or {}).get("content")) or ""

    def once(self, text: str, extra: dict) -> tuple[str | None, str | None]:
        """(output, error) after retries."""
        error, tries, attempt = "no attempt", max(1, self.o.max_retries), 0
        while attempt < tries:
            self.wait()
            attempt += 1
            backoff = self.o.retry_delay * 2 ** (attempt - 1)
            try:
                status, headers, body = self.transport(*self.request(text, extra))
            except Exception as e:  # a connection that fails is tried again
                error = f"{type(e).__name__}: {e}"
                if attempt < tries:
                    self.sleep(backoff)
                continue
            if status == 200:
                return self.text_of(body), None
            shown = (body if isinstance(body, str) else json.dumps(body))[:500]
            error = f"HTTP {status}: {shown}"
            if status == 400 and NO_TEMPLATE.search(shown) and not self.completions and self.o.provider != "anthropic":
                self.completions, attempt = True, attempt - 1  # from now on
                continue
            if status == 429:
                hold = {k.lower(): v for k, v in headers.items()}.get("retry-after")
                backoff = float(hold) if hold and re.fullmatch(r"\d+(\.\d+)?", hold) else backoff
            elif status not in RETRIED:
                break
            if attempt < tries:
                self.sleep(backoff)
        return None, error

    def ask(self, probe_id: str, text: str, extra: dict | None = None) -> dict:
        """One result row, with what was done to get it."""
        began, empties = time.monotonic(), 0
        while True:
            out, error = self.once(text, extra or {})
            if error is not None or out != "" or empties >= self.o.empty_retries:
                break
            empties += 1
            self.sleep(self.o.empty_delay)
        raw, out = out, out or ""
        if self.o.strip_leading_newlines:
            out = out.lstrip("\r\n")
        return {
            "probe_id": probe_id, "model_name": self.o.model, "output_text": out, "char_length": len(out), "byte_length": len(out.encode()), "has_leading_space": out.startswith(" "),
            "has_leading_newline": out.startswith("\n"), "token_type": "other", "is_empty": out == "", "latency_ms": (time.monotonic() - began) * 1000, "error": error,
            "raw_output_text": raw, "changed": raw is not None and raw != out, "empty_retries_used": empties, "recovered_after_empty": empties > 0 and out != "",
        }


RESULT = (
    "probe_id string, model_name string, output_text string, char_length int, byte_length int, has_leading_space boolean, has_leading_newline boolean, token_type string, is_empty boolean, "
    "latency_ms double, error string, raw_output_text string, changed boolean, empty_retries_used int, recovered_after_empty boolean"
)


def check_batch(rows: list[dict]) -> None:
    """Stop when a whole batch shows that going on is pointless."""
    if rows and all(r["error"] and is_fatal(r["error"]) for r in rows):
        raise ConfigurationError(rows[0]["error"])
    if rows and all(r["error"] is None and r["output_text"] in THINKING for r in rows):
        raise ConfigurationError("the endpoint answers with thinking markers only")


def collect(prompts: DataFrame, options: Options, transport: Transport | None = None, partitions: int = 1) -> DataFrame:
    """Query every row of prompts (probe_id, text, and optionally extra, a JSON object for the request's body). The limits on
    concurrency and rate are shared out over the partitions."""
    share = max(1, options.concurrency // partitions)
    own = Options(**{**options.__dict__, "concurrency": share, "min_interval": options.min_interval * partitions})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = Client(own, transport)
        with ThreadPoolExecutor(share) as pool:
            for b in batches:
                todo = [(i, t, json.loads(x) if x else {}) for i, t, x in zip(b["probe_id"], b["text"], b["extra"])]
                for i in range(0, len(todo), 2 * share):
                    rows = list(pool.map(lambda x: client.ask(*x), todo[i : i + 2 * share]))
                    check_batch(rows)
                    yield pd.DataFrame(rows)

    extra = F.col("extra") if "extra" in prompts.columns else F.lit(None).cast("string")
    rows = prompts.select("probe_id", "text", extra.alias("extra"))
    return (rows.repartition(partitions, "probe_id") if partitions > 1 else rows.coalesce(1)).mapInPandas(run, RESULT)


def with_repeats(prompts: DataFrame, sample: DataFrame, repeats: int) -> DataFrame:
    """Prompts in order of seq; those of the stability sample as often as they are to be asked, one after the other."""
    if repeats < 2:
        return prompts.orderBy("seq") if "seq" in prompts.columns else prompts
    chosen = sample.select(F.col("probe_id").alias("__chosen")).distinct()
    times = F.when(F.col("__chosen").isNull(), 1).otherwise(repeats)
    out = prompts.join(chosen, prompts["probe_id"] == F.col("__chosen"), "left").withColumn("copy", F.explode(F.sequence(F.lit(1), times))).drop("__chosen")
    return out.orderBy("seq", "copy") if "seq" in out.columns else out


def as_log(rows: DataFrame) -> DataFrame:
    """Results in the layout of a response log: what was done to an answer lies in raw_response."""
    raw = F.struct(F.col("error"), F.col("raw_output_text").alias("_raw_output_text"))
    return rows.select(*(c for c in rows.columns if c not in ("error", "raw_output_text", "changed", "empty_retries_used", "recovered_after_empty")), raw.alias("raw_response"))


def resume(prompts: DataFrame, required: DataFrame, done: DataFrame, options: Options, transport: Transport | None = None, partitions: int = 1) -> DataFrame:
    """Query what a log still lacks."""
    return collect(prompts.join(O.pending(required, done, options.model), "probe_id"), options, transport, partitions)


def collect_to(path: str, prompts: DataFrame, options: Options, transport: Transport | None = None, partitions: int = 1, wave: int = 1024, progress: Callable[[int, int], None] | None = None) -> int:
    """Query prompts (probe_id, text, seq; a probe as often as it has rows) and append the answers to the log at path, one wave
    of prompts after the other. What the log holds without an error is not asked again. Returns the number of new rows."""
    spark = prompts.sparkSession
    order = F.row_number().over(Window.partitionBy("probe_id").orderBy("seq"))
    asked = prompts.withColumn("__nth", order)
    try:
        log = readers.observations(spark, path, strict=False)
        done = O.valid(log).where(F.col("model_name") == options.model).groupBy("probe_id").agg(F.count("*").alias("__done"))
        asked = asked.join(done, "probe_id", "left").where(F.col("__nth") > F.coalesce("__done", F.lit(0))).drop("__done")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    asked = asked.persist()
    first, total, told = None, asked.count(), 0
    while told < total:  # a job per wave, which bounds what an interruption loses
        rest = asked if first is None else asked.where((F.col("seq") > first[0]) | ((F.col("seq") == first[0]) & (F.col("__nth") > first[1])))
        batch = rest.orderBy("seq", "__nth").limit(wave).persist()
        last = batch.agg(F.max(F.struct("seq", "__nth")).alias("x")).first()["x"]
        n = batch.count()
        sinks.append_observations(as_log(collect(batch, options, transport, partitions)), path)
        batch.unpersist()
        first, told = (last[0], last[1]), told + n
        if progress:
            progress(told, total)
    asked.unpersist()
    return told
