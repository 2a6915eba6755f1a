"""Connectors to models: a mock as expressions, and HTTP calls by Arrow batches with retries, rate limit and breaker."""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOCK_TOTAL_MS, MOCK_FIRST_MS, MOCK_PROMPT_TOKENS = 5.0, 1.0, 12


def mock_answers(prompts: DataFrame, prompt: str) -> DataFrame:
    """prompts with output and timings of a deterministic model: it adds one where asked to, else it doesn't know."""
    n = F.regexp_extract(prompt, r"(?i)what is (-?\d+) plus one\?", 1)
    answer = F.when(n != "", (n.cast("bigint") + 1).cast("string")).otherwise("unknown")
    return prompts.withColumns({"output": answer, "total_ms": F.lit(MOCK_TOTAL_MS), "ttft_ms": F.lit(MOCK_FIRST_MS), "prompt_tokens": F.lit(MOCK_PROMPT_TOKENS)})


class TokenBucket:
    """At most `per_minute` units a minute, refilled steadily; one bucket a partition."""

    def __init__(self, per_minute: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.rate, self.level, self.most, self.clock, self.sleep = per_minute / 60, per_minute, per_minute, clock, sleep
        self.at = clock()

    def take(self, units: float) -> float:
        """Waits until the units are there; returns the seconds waited. More than a minute's worth is charged as a minute's worth."""
        units, waited = min(units, self.most), 0.0
        while True:
            now = self.clock()
            self.level, self.at = min(self.most, self.level + (now - self.at) * self.rate), now
            if self.level >= units - 1e-9:
                self.level -= units
                return waited
            pause = (units - self.level) / self.rate
            self.sleep(pause)
            waited += pause


class CircuitBreaker:
    """Opens after `limit` failures in a row, lets one call through after `cooldown` seconds, closes when that succeeds."""

    def __init__(self, limit: int = 5, cooldown: float = 30.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.limit, self.cooldown, self.clock = limit, cooldown, clock
        self.failures, self.opened, self.trial = 0, None, False

    @property
    def state(self) -> str:
        if self.opened is None:
            return "closed"
        return "half_open" if self.clock() - self.opened >= self.cooldown else "open"

    def allow(self) -> bool:
        state = self.state
        if state == "half_open":
            if self.trial:
                return False
            self.trial = True
        return state != "open"

    def record(self, ok: bool) -> None:
        self.trial = False
        if ok:
            self.failures, self.opened = 0, None
        else:
            self.failures += 1
            if self.failures >= self.limit or self.opened is not None:
                self.opened = self.clock()


def backoff(attempt: int, base: float = 0.5, cap: float = 30.0, retry_after: float | None = None, rng: random.Random | None = None) -> float:
    """Full jitter up to min(cap, base * 2^attempt), but never before the server's Retry-After."""
    wait = (rng or random).uniform(0, min(cap, base * 2**attempt))
    return max(wait, retry_after or 0.0)


@dataclass(frozen=True)
class Endpoint:
    """Where and how to call: style is chat_lines (NDJSON stream) or chat_events (server-sent events)."""

    url: str
    model: str
    style: str = "chat_events"
    headers: dict = field(default_factory=dict)
    params: dict = field(default_factory=dict)
    timeout: float = 60.0
    attempts: int = 3
    per_minute: float = 600.0


def read_stream(lines: Iterator[bytes], style: str) -> dict:
    """The text, finish reason and token counts of a streamed answer; tool-call fragments are joined by index."""
    out = {"output": "", "finish_reason": None, "prompt_tokens": None, "completion_tokens": None, "tool_calls": []}
    calls: dict[int, dict] = {}
    for raw in lines:
        line = raw.decode("utf-8", "replace").strip()
        if style == "chat_events":
            if not line.startswith("data:"):
                continue
            line = line[5:].strip()
            if line == "[DONE]":
                break
        if not line:
            continue
        piece = json.loads(line)
        if style == "chat_lines":
            out["output"] += (piece.get("message") or {}).get("content") or ""
            if piece.get("done"):
                out |= {"finish_reason": piece.get("done_reason"), "prompt_tokens": piece.get("prompt_eval_count"), "completion_tokens": piece.get("eval_count")}
            continue
        usage = piece.get("usage") or {}
        out["prompt_tokens"], out["completion_tokens"] = usage.get("prompt_tokens", out["prompt_tokens"]), usage.get("completion_tokens", out["completion_tokens"])
        for choice in piece.get("choices") or ():
            delta = choice.get("delta") or {}
            out["output"] += delta.get("content") or ""
            out["finish_reason"] = choice.get("finish_reason") or out["finish_reason"]
            for part in delta.get("tool_calls") or ():
                call = calls.setdefault(part.get("index", 0), {"name": "", "arguments": ""})
                call["name"] += (part.get("function") or {}).get("name") or ""
                call["arguments"] += (part.get("function") or {}).get("arguments") or ""
    out["tool_calls"] = [calls[i] for i in sorted(calls)]
    return out


def call_model(endpoint: Endpoint, prompt: str) -> dict:
    body = json.dumps({"model": endpoint.model, "messages": [{"role": "user", "content": prompt}], "stream": True} | endpoint.params).encode()
    request = urllib.request.Request(endpoint.url, body, {"Content-Type": "application/json"} | endpoint.headers)
    with urllib.request.urlopen(request, timeout=endpoint.timeout) as answer:
        return read_stream(answer, endpoint.style)


def cacheable(endpoint: Endpoint) -> bool:
    """Only answers at temperature 0, which is the default, may stand for later ones."""
    return float(endpoint.params.get("temperature", 0.0)) == 0.0


def cache_key(endpoint: Endpoint, prompt: Column) -> Column:
    """Digest of what an answer depends on: model, place, way of asking, parameters and prompt."""
    fixed = json.dumps({"decode": dict(endpoint.params), "model": endpoint.model, "style": endpoint.style, "url": endpoint.url}, sort_keys=True, separators=(",", ":"))
    return F.sha2(F.concat(F.lit(fixed + "\n"), F.coalesce(prompt, F.lit(""))), 256)


def retry_after(headers: object) -> float | None:
    """Seconds that an answer asks to wait, if it says so in seconds."""
    value = headers.get("Retry-After") if headers is not None else None
    try:
        return max(0.0, float(value)) if value is not None else None
    except ValueError:
        return None


ANSWER_DDL = "output string, outcome string, finish_reason string, prompt_tokens int, completion_tokens int, attempts int, total_ms double, attempt_log string"


def generate(prompts: DataFrame, prompt: str, endpoint: Endpoint, call: Callable[[Endpoint, str], dict] = call_model) -> DataFrame:
    """prompts with an answer each, called by partition: parallelism is the number of partitions.

    Each partition has its rate limit and breaker. A call that fails is tried again with growing pauses; what
    happened to each try is in attempt_log, and a row that got no answer says so in outcome.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prompts.schema) + ", " + ANSWER_DDL

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, breaker = TokenBucket(endpoint.per_minute), CircuitBreaker()
        for f in frames:
            yield f.join(pd.DataFrame([_attempts(endpoint, p, bucket, breaker, call) for p in f[prompt]], index=f.index))

    return prompts.mapInPandas(each, schema)


def _attempts(endpoint: Endpoint, prompt: str, bucket: TokenBucket, breaker: CircuitBreaker, call: Callable) -> dict:
    log, began, outcome = [], time.monotonic(), "harness_error"
    for attempt in range(endpoint.attempts):
        if not breaker.allow():
            log.append({"error": "circuit open"})
            break
        bucket.take(1)
        try:
            got = call(endpoint, prompt)
            breaker.record(True)
            log.append({"ok": True})
            reason = got.get("finish_reason")
            kind = "empty_output" if not (got["output"] or "").strip() else "truncated" if reason == "length" else "content_filtered" if reason == "content_filter" else "passed"
            return {"output": got["output"], "outcome": kind, "finish_reason": reason, "prompt_tokens": got.get("prompt_tokens"), "completion_tokens": got.get("completion_tokens"), "attempts": attempt + 1, "total_ms": (time.monotonic() - began) * 1000, "attempt_log": json.dumps(log)}
        except urllib.error.HTTPError as e:  # other 4xx mean the same however often they are asked
            outcome, wait = "harness_error", retry_after(e.headers)
            log.append({"error": f"http {e.code}"})
            if e.code < 500 and e.code not in (408, 429):
                break
            breaker.record(False)
            if attempt + 1 < endpoint.attempts:
                time.sleep(backoff(attempt) if wait is None else wait)
            continue
        except TimeoutError:
            outcome = "harness_timeout"
            log.append({"error": "timeout"})
            breaker.record(False)
        except (urllib.error.URLError, OSError, ValueError) as e:
            outcome = "harness_error"
            log.append({"error": type(e).__name__})
            breaker.record(False)
        if attempt + 1 < endpoint.attempts:
            time.sleep(backoff(attempt))
    return {"output": None, "outcome": outcome, "finish_reason": None, "prompt_tokens": None, "completion_tokens": None, "attempts": len(log), "total_ms": (time.monotonic() - began) * 1000, "attempt_log": json.dumps(log)}
