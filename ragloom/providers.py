"""Calls to models, behind one protocol, and a deterministic offline stand-in."""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Callable
from typing import Protocol

import numpy as np


class Provider(Protocol):
    def embed(self, texts: list[str], kind: str) -> list[list[float]]: ...

    def rerank(self, query: str, documents: list[str], top_n: int | None = None) -> list[tuple[int, float]]: ...

    def chat(self, messages: list[tuple[str, str]], temperature: float | None = None) -> str: ...


class OfflineProvider:
    """Embeddings by signed word hashes, reranking by shared words, chat by template: not a measure of model quality."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def _words(self, text: str) -> list[str]:
        return re.findall(r"\w+", text.lower())

    def embed(self, texts: list[str], kind: str) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension), np.float64)
        for row, text in zip(out, texts, strict=True):
            for w in self._words(text):
                h = zlib.crc32(w.encode())
                row[h % self.dimension] += 1 if h & 1 << 20 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).astype(np.float32).tolist()

    def rerank(self, query: str, documents: list[str], top_n: int | None = None) -> list[tuple[int, float]]:
        q = set(self._words(query))
        scores = [len(q & set(self._words(d))) / max(1, len(q)) for d in documents]
        return sorted(enumerate(scores), key=lambda x: (-x[1], x[0]))[:top_n]

    def chat(self, messages: list[tuple[str, str]], temperature: float | None = None) -> str:
        return " ".join(messages[-1][1].split()[:40]) if messages else ""

    features = frozenset({"embed", "rerank", "chat"})


def has(provider: Provider, feature: str) -> bool:
    """Whether the provider says that it has a feature; one that says nothing has what it has methods for."""
    named = getattr(provider, "features", None)
    return feature in named if named is not None else callable(getattr(provider, feature, None))


#: Makers of providers by name.
REGISTRY: dict[str, Callable[..., Provider]] = {"offline": OfflineProvider}


def register(name: str, make: Callable[..., Provider]) -> None:
    REGISTRY[name] = make


def create(name: str, **settings: object) -> Provider:
    if name == "http" and name not in REGISTRY:
        from .providers_http import HttpProvider

        register("http", HttpProvider)
    if name not in REGISTRY:
        raise ValueError(f"no provider is registered as {name}")
    return REGISTRY[name](**settings)


def wait_until_processed(status: Callable[[], str], timeout: float = 300.0, interval: float = 1.0) -> str:
    """Asks for a file's status until it is a last one; TimeoutError after `timeout` seconds."""
    deadline = time.monotonic() + timeout
    while True:
        found = status()
        if found in ("completed", "failed", "cancelled"):
            return found
        left = deadline - time.monotonic()
        if left <= 0:
            raise TimeoutError(f"the file was still {found} after {timeout} s")
        time.sleep(min(interval, left))
