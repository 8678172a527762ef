"""Providers that speak to a service through a transport that is passed in.

A transport is any callable that takes a request (a dict) and returns the service's answer, so an
adapter holds no client, address or key, and is tested without a network.  Adapters are made in the
task that uses them; ``make`` builds them, or the offline ones, by name.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable
from functools import partial

from rillmark.functions.text import repaired_json
from rillmark.operators.prompts import STRUCTURED_PHRASES
from rillmark.providers import EchoGenerator, HashEmbedding, OverlapReranker

Transport = Callable[[dict], dict]


class Throttled(Exception):
    """A transport raises it when the service asks to come back later."""


def with_retries(send: Callable, request: dict, attempts: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep):
    """The answer of ``send``; a throttled call is made again after one, two, ... times ``wait``."""
    for attempt in range(1, attempts + 1):
        try:
            return send(request)
        except Throttled:
            if attempt == attempts:
                raise
            sleep(wait * attempt)
    raise ValueError("attempts must be positive")


class RateLimit:
    """Calls at least ``60 / per_minute`` seconds apart."""

    def __init__(self, per_minute: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep = 60.0 / per_minute if per_minute > 0 else 0.0, clock, sleep
        self.next = float("-inf")

    def share(self, callers: int) -> None:
        """Keep to one of ``callers`` equal parts of the limit."""
        self.gap *= callers

    def wait(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap


class LineStreamGenerator:
    """A service that streams its answer as one JSON document a line."""

    def __init__(self, send: Callable[[dict], Iterable[str]], model: str, temperature: float = 0.0, max_tokens: int = 1024):
        self.send, self.model, self.options = send, model, {"temperature": temperature, "num_predict": max_tokens}

    def generate(self, messages: list[dict[str, str]]) -> dict:
        parts, last = [], {}
        for line in self.send({"model": self.model, "messages": messages, "stream": True, "options": self.options}):
            if not line.strip():
                continue
            last = json.loads(line)
            if last.get("error"):
                raise RuntimeError(last["error"])
            parts.append((last.get("message") or {}).get("content") or "")
        return {"content": "".join(parts), "model": last.get("model") or self.model, "prompt_tokens": last.get("prompt_eval_count"), "completion_tokens": last.get("eval_count")}


class ConverseGenerator:
    """A service that takes system texts apart from turns and answers in content blocks."""

    def __init__(self, send: Transport, model: str, temperature: float = 0.0, max_tokens: int = 1024, attempts: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep):
        self.send, self.model = partial(with_retries, send, attempts=attempts, wait=wait, sleep=sleep), model
        self.options = {"temperature": temperature, "maxTokens": max_tokens}

    def generate(self, messages: list[dict[str, str]]) -> dict:
        system = [{"text": m["content"]} for m in messages if m["role"] == "system" and m["content"]]
        turns = [{"role": "assistant" if m["role"] == "assistant" else "user", "content": [{"text": m["content"]}]} for m in messages if m["role"] != "system" and m["content"]]
        found = self.send({"modelId": self.model, "system": system, "messages": turns, "inferenceConfig": self.options})
        blocks = found.get("output", {}).get("message", {}).get("content") or []
        usage = found.get("usage") or {}
        return {"content": "".join(b.get("text") or "" for b in blocks), "model": self.model, "prompt_tokens": usage.get("inputTokens"), "completion_tokens": usage.get("outputTokens"), "total_tokens": usage.get("totalTokens")}


class CandidateGenerator:
    """A rate-limited service that answers with candidates; the first one with a text counts.

    A question that asks for JSON gets a document or, after ``attempts`` answers, the last text."""

    REMINDER = "Return only one valid JSON document."

    def __init__(self, send: Transport, model: str, per_minute: float = 0.0, attempts: int = 3, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.send, self.model, self.attempts = send, model, attempts
        self.limit = RateLimit(per_minute, clock, sleep)

    def share(self, callers: int) -> None:
        self.limit.share(callers)

    def _ask(self, messages: list[dict[str, str]]) -> dict:
        self.limit.wait()
        system = "\n".join(m["content"].strip() for m in messages if m["role"] == "system" and (m["content"] or "").strip())
        turns = [{"role": "model" if m["role"] == "assistant" else "user", "parts": [{"text": m["content"].strip()}]} for m in messages if m["role"] != "system" and (m["content"] or "").strip()]
        return self.send({"model": self.model, "system_instruction": system or None, "contents": turns})

    def generate(self, messages: list[dict[str, str]]) -> dict:
        wanted = any(m["role"] == "user" and any(p in (m["content"] or "").lower() for p in STRUCTURED_PHRASES) for m in messages)
        asked, text, usage = list(messages), "", {}
        for _ in range(self.attempts if wanted else 1):
            found = self._ask(asked)
            texts = ("".join(p.get("text") or "" for p in c.get("parts") or []) for c in found.get("candidates") or [])
            text, usage = next((t for t in texts if t.strip()), ""), found.get("usage") or {}
            if not wanted:
                break
            document = repaired_json(text)
            if document is not None:
                text = document
                break
            asked = [*messages, {"role": "assistant", "content": text}, {"role": "user", "content": self.REMINDER}]
        return {"content": text, "model": self.model, "prompt_tokens": usage.get("prompt_tokens"), "completion_tokens": usage.get("completion_tokens"), "total_tokens": usage.get("total_tokens")}


class ServiceReranker:
    """A service that answers with (index, score) of the texts; a score of zero is a score."""

    def __init__(self, send: Transport, model: str, attempts: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep):
        self.send, self.model = partial(with_retries, send, attempts=attempts, wait=wait, sleep=sleep), model

    def scores(self, query: str, texts: list[str]) -> list[float | None]:
        found = self.send({"model": self.model, "query": query, "documents": texts, "top_n": len(texts)})
        out: list[float | None] = [None] * len(texts)
        for row in found.get("results") or []:
            score = next((row[k] for k in ("relevance_score", "relevanceScore", "score") if row.get(k) is not None), None)
            if 0 <= row.get("index", -1) < len(texts):
                out[row["index"]] = None if score is None else float(score)
        return out


class ServiceEmbedding:
    """A service that answers with one vector a text; the dimension is that of its first answer."""

    def __init__(self, send: Transport, model: str):
        self.send, self.model, self.size = send, model, 0

    def dimension(self) -> int:
        if not self.size:
            self.embed(["dimension"])
        return self.size

    def embed(self, texts: list[str]):
        import numpy as np

        out = np.asarray(self.send({"model": self.model, "input": texts})["embeddings"], np.float32)
        self.size = out.shape[1] if out.size else self.size
        return out


class ChatAdapter:
    """A generator for callers whose messages hold parts, nulls and other names of roles."""

    ROLES = {"ai": "assistant", "assistant": "assistant", "system": "system"}

    def __init__(self, generator):
        self.generator = generator

    @staticmethod
    def text(content) -> str:
        if content is None:
            return ""
        if isinstance(content, str):
            return content
        return "".join(p if isinstance(p, str) else str(p.get("text") or "") for p in content)

    def __call__(self, messages: list[dict]) -> str:
        return self.generator.generate([{"role": self.ROLES.get(m.get("role"), "user"), "content": self.text(m.get("content"))} for m in messages])["content"]


MAKERS: dict[str, dict[str, Callable]] = {
    "embedding": {"hash": HashEmbedding, "service": ServiceEmbedding},
    "generator": {"echo": EchoGenerator, "lines": LineStreamGenerator, "converse": ConverseGenerator, "candidates": CandidateGenerator},
    "reranker": {"overlap": OverlapReranker, "service": ServiceReranker},
}


def make(kind: str, name: str, **options) -> Callable[[], object]:
    """A function that a task calls to have its own provider of that kind and name."""
    if name not in MAKERS.get(kind, {}):
        raise ValueError(f"no {kind} named {name}: {sorted(MAKERS.get(kind, {}))}")
    return partial(MAKERS[kind][name], **options)
