"""A provider behind HTTP: JSON requests with retries, timeouts and a circuit breaker, and the usual shapes of replies."""

from __future__ import annotations

import base64
import json
import random
import threading
import time
import urllib.error
import urllib.request
from collections import deque
from dataclasses import dataclass, field

import numpy as np


@dataclass(frozen=True)
class Resilience:
    """Fixed values by default: retries with exponential delays, seconds an attempt and in all, and when to stop asking."""

    retries: int = 3
    delay: float = 0.5
    attempt_timeout: float = 60.0
    total_timeout: float = 90.0
    failure_ratio: float = 0.2
    sampling_seconds: float = 120.0
    least_calls: int = 10
    break_seconds: float = 15.0


class CircuitOpen(RuntimeError):
    """Too many of the last calls failed; none is made for a while."""


@dataclass
class _Circuit:
    rules: Resilience
    calls: deque = field(default_factory=deque)  # (time, failed)
    closed_until: float = 0.0
    lock: threading.Lock = field(default_factory=threading.Lock)

    def check(self) -> None:
        if time.monotonic() < self.closed_until:
            raise CircuitOpen("service unavailable: too many failed calls")

    def note(self, failed: bool) -> None:
        with self.lock:
            now = time.monotonic()
            self.calls.append((now, failed))
            while self.calls[0][0] < now - self.rules.sampling_seconds:
                self.calls.popleft()
            if len(self.calls) >= self.rules.least_calls and sum(f for _, f in self.calls) >= self.rules.failure_ratio * len(self.calls):
                self.closed_until = now + self.rules.break_seconds
                self.calls.clear()


def post_json(url: str, body: dict, headers: dict[str, str], rules: Resilience, circuit: _Circuit) -> dict:
    """The reply's JSON. Errors that may pass (429, 5xx, no connection) are tried again; all others raise at once."""
    deadline = time.monotonic() + rules.total_timeout
    for attempt in range(rules.retries + 1):
        circuit.check()
        try:
            request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
            with urllib.request.urlopen(request, timeout=max(0.001, min(rules.attempt_timeout, deadline - time.monotonic()))) as reply:
                out = json.loads(reply.read())
            circuit.note(False)
            return out
        except urllib.error.HTTPError as e:
            message, passing = f"HTTP {e.code}: {e.read()[:500].decode(errors='replace')}", e.code in (408, 429) or e.code >= 500
        except OSError as e:
            message, passing = f"service unavailable: {e}", True
        circuit.note(passing)
        wait = rules.delay * 2**attempt * random.uniform(1, 1.5)
        if not passing or attempt == rules.retries or time.monotonic() + wait > deadline:
            raise RuntimeError(message)
        time.sleep(wait)
    raise AssertionError


def decode_embedding(value: list[float] | str) -> list[float]:
    """A vector as numbers, or as base64 of little-endian single precision."""
    return np.frombuffer(base64.b64decode(value), "<f4").tolist() if isinstance(value, str) else [float(x) for x in value]


class HttpProvider:
    """Chat, embeddings and reranking by the routes that hosted models share; names of models by capability.

    models: chat, embed, rerank; a capability without a model is one that the provider lacks.
    """

    ROUTES = {"chat": "/chat/completions", "embed": "/embeddings", "rerank": "/rerank"}

    def __init__(self, base_url: str, models: dict[str, str], key: str | None = None, encoding: str = "float", rules: Resilience = Resilience()):
        self.base_url, self.models, self.encoding, self.rules = base_url.rstrip("/"), models, encoding, rules
        self.headers = {"Authorization": f"Bearer {key}"} if key else {}
        self._circuit = _Circuit(rules)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_circuit"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._circuit = _Circuit(self.rules)

    @property
    def features(self) -> frozenset[str]:
        return frozenset(self.models)

    def _ask(self, what: str, body: dict) -> dict:
        if what not in self.models:
            raise ValueError(f"this provider has no model for {what}")
        return post_json(self.base_url + self.ROUTES[what], {"model": self.models[what], **body}, self.headers, self.rules, self._circuit)

    def embed(self, texts: list[str], kind: str) -> list[list[float]]:
        found = self._ask("embed", {"input": texts, "encoding_format": self.encoding, "input_type": kind})["data"]
        return [decode_embedding(x["embedding"]) for x in sorted(found, key=lambda x: x.get("index", 0))]

    def rerank(self, query: str, documents: list[str], top_n: int | None = None) -> list[tuple[int, float]]:
        found = self._ask("rerank", {"query": query, "documents": documents, **({"top_n": top_n} if top_n else {})})["results"]
        return [(x["index"], x["relevance_score"]) for x in found]

    def chat(self, messages: list[tuple[str, str]], temperature: float | None = None) -> str:
        body = {"messages": [{"role": r, "content": t} for r, t in messages], **({} if temperature is None else {"temperature": temperature})}
        return self._ask("chat", body)["choices"][0]["message"]["content"] or ""
