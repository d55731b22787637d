"""Token counters: a local one over a tokenizer's file, a remote one that sums parts, and columns of either's counts."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.grounding import split_for_limit
from ..options import ChunkOptions


class TokenCounter(Protocol):
    def count(self, text: str) -> int: ...


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


class LocalCounter:
    """Counts by a tokenizers file, which each worker opens once; indices are code points, as Python texts have them."""

    def __init__(self, path: str):
        self.path = path

    def _offsets(self, text: str) -> list[tuple[int, int]]:
        return _tokenizer(self.path).encode(text, add_special_tokens=False).offsets

    def count(self, text: str) -> int:
        return len(self._offsets(text))

    def index_from_start(self, text: str, n: int) -> int:
        """Where the first n tokens end."""
        found = self._offsets(text)
        return len(text) if n >= len(found) else found[n - 1][1] if n > 0 else 0

    def index_from_end(self, text: str, n: int) -> int:
        """Where the last n tokens begin."""
        found = self._offsets(text)
        return 0 if n >= len(found) else found[-n][0] if n > 0 else len(text)

    def chunk_options(self, size: int, overlap: int = 0) -> ChunkOptions:
        """Recursive chunks whose sizes are tokens of this counter."""
        return ChunkOptions(size, overlap, count_tokens=self.count, index_from_start=self.index_from_start, index_from_end=self.index_from_end)


class RemoteCounter:
    """Counts by calls that take `limit` characters each; a longer text is split after white space and summed."""

    def __init__(self, call: Callable[[str], int], limit: int = 65_536):
        self.call, self.limit = call, limit

    def count(self, text: str) -> int:
        return sum(map(self.call, split_for_limit(text, self.limit)))


def token_count(text: Column, counter: TokenCounter) -> Column:
    """Counts of a column; null for null. What the counter raises fails the query, as a wrong budget would go unnoticed."""

    @F.pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else counter.count(t) for t in texts], dtype="Int32")

    return run(text)
