"""Chunkers: documents (document_id, text) to chunks (document_id, chunk_index, start_offset, end_offset, text).

Offsets count UTF-16 units. A null or empty text gives no chunks.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import utf16_length
from ..options import ChunkOptions, SemanticOptions
from ..providers import Provider

SCHEMA = "document_id string, chunk_index int, start_offset int, end_offset int, text string"
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def fixed_chunks(docs: DataFrame, options: ChunkOptions = ChunkOptions()) -> DataFrame:
    """Chunks of `size` code points, each `overlap` after the start of the next; native, in time linear in the text.

    A text is cut into pieces of size - overlap code points; a chunk is some pieces on, cut to its size. Offsets are the
    pieces' lengths summed up.
    """
    step = options.size - options.overlap
    n = F.length("text")
    cut = docs.where(n > 0).select("document_id", n.alias("n"), F.regexp_extract_all("text", F.lit(f"(?s)(.{{1,{step}}})"), F.lit(1)).alias("pieces"))
    # the last chunk is the first that reaches the end
    count = F.greatest(F.lit(1), F.ceil((F.col("n") - options.size) / step) + 1).cast("int")
    start = F.aggregate(F.transform("pieces", utf16_length), F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    own = F.transform(F.slice("pieces", F.lit(1), count), lambda _, k: F.substring(F.array_join(F.slice("pieces", k + 1, -(-options.size // step)), ""), 1, options.size))
    placed = cut.select("document_id", own.alias("own"), start.alias("starts")).select("document_id", "starts", F.posexplode("own").alias("chunk_index", "text"))
    begin = F.get("starts", F.col("chunk_index"))
    return placed.select("document_id", "chunk_index", begin.alias("start_offset"), (begin + utf16_length(F.col("text"))).alias("end_offset"), "text")


def recursive_spans(text: str, options: ChunkOptions) -> list[tuple[int, int]]:
    """Code point spans: text is cut at the first separator of the ladder that occurs, pieces are merged while they fit,
    and pieces too large go on to the next separator; the empty one cuts anywhere."""
    astral = max(text, default="") > "￿"
    units = list(accumulate((2 if c > "￿" else 1 for c in text), initial=0)) if astral else None

    def size(a: int, b: int) -> int:
        return options.count_tokens(text[a:b]) if options.count_tokens else units[b] - units[a] if units else b - a

    if not text:
        return []
    if size(0, len(text)) <= options.size:
        return [(0, len(text))]
    raw: list[tuple[int, int, bool]] = []
    todo = [(0, len(text), 0)]  # regions, the next one last
    while todo:
        a, b, level = todo.pop()
        if b <= a:
            continue
        if level < 0 or size(a, b) <= options.size:
            raw.append((a, b, False))
            continue
        if level >= len(options.separators):
            raw.append((a, b, True))
            continue
        separator = options.separators[level]
        if not separator:
            raw += [(x, y, False) for x, y in _hard_cuts(text, a, b, options)]
            continue
        starts, at = [a], text.find(separator, a, b)
        while at >= 0:
            starts.append(at + len(separator))
            at = text.find(separator, starts[-1], b)
        if len(starts) == 1:
            todo.append((a, b, level + 1))
            continue
        edges, parts, first = [*starts, b], [], 0
        while first < len(starts):
            # the furthest edge that a chunk from here may reach; sizes grow with the edge
            reach = bisect_right(range(first + 1, len(edges)), options.size, key=lambda i: size(edges[first], edges[i]))  # noqa: B023
            parts.append((edges[first], edges[first + max(1, reach)], -1 if reach else level + 1))
            first += max(1, reach)
        todo += reversed(parts)
    return _overlapped(text, raw, options)


def _hard_cuts(text: str, a: int, b: int, options: ChunkOptions) -> Iterator[tuple[int, int]]:
    stride = options.size - options.overlap
    while a < b:
        if options.count_tokens:
            if not options.index_from_start:
                raise ValueError("a cut inside a word needs index_from_start where sizes are tokens")
            to = a + options.index_from_start(text[a:b], stride)
            rest = to >= b
        else:
            to, rest = a + stride, a + options.size >= b
        to = b if rest else max(a + 1, to)
        yield a, to
        a = to


def _overlapped(text: str, raw: list[tuple[int, int, bool]], options: ChunkOptions) -> list[tuple[int, int]]:
    out = [(a, b) for a, b, _ in raw[:1]]
    for (before, before_end, _), (a, b, oversized) in zip(raw, raw[1:], strict=False):
        start = a
        if options.overlap and options.count_tokens:
            start = min(a, before + options.index_from_end(text[before:before_end], options.overlap))
            if not oversized:
                start = min(a, start + options.index_from_end(text[start:b], options.size))
        elif options.overlap:
            start = min(a, max(before, before_end - options.overlap))
            start = start if oversized else min(a, max(start, b - options.size))
        out.append((start, b))
    return out


def _rows(document_id: object, text: str, spans: list[tuple[int, int]]) -> Iterator[tuple]:
    units = np.cumsum([0, *(2 if c > "￿" else 1 for c in text)]) if max(text, default="") > "￿" else None
    for k, (a, b) in enumerate(spans):
        yield document_id, k, int(units[a]) if units is not None else a, int(units[b]) if units is not None else b, text[a:b]


def recursive_chunks(docs: DataFrame, options: ChunkOptions = ChunkOptions()) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for i, t in zip(batch["document_id"], batch["text"], strict=True) if t for r in _rows(i, t, recursive_spans(t, options))]
            yield pd.DataFrame(rows, columns=["document_id", "chunk_index", "start_offset", "end_offset", "text"])

    return docs.select(F.col("document_id").cast("string"), "text").mapInPandas(run, SCHEMA)


def split_sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE_END.split(text) if s.strip()]


def sentence_spans(text: str, split: Callable[[str], list[str]] = split_sentences) -> list[tuple[int, int]]:
    """Where the sentences are: each searched from the end of the one before."""
    spans, at = [], 0
    for s in split(text):
        found = text.find(s, at)
        found = found if found >= 0 else text.find(s)
        if found >= 0:
            spans.append((found, found + len(s)))
            at = found + len(s)
    return spans


def similarity_threshold(similar: np.ndarray, percentile: float) -> np.float32:
    """Percentile by linear interpolation in single precision; minus infinity where all are equal."""
    ordered = np.sort(similar.astype(np.float32))
    if not len(ordered) or ordered[-1] - ordered[0] <= np.float32(1e-6):
        return np.float32(-np.inf)
    rank = np.float32(percentile) / np.float32(100) * np.float32(len(ordered) - 1)
    low = int(np.floor(rank))
    weight = np.float32(rank - np.float32(low))
    return ordered[low] * (np.float32(1) - weight) + ordered[min(low + 1, len(ordered) - 1)] * weight


def semantic_spans(text: str, vectors: np.ndarray, spans: list[tuple[int, int]], options: SemanticOptions) -> list[tuple[int, int]]:
    """Sentences go on in one chunk until the next is dissimilar, or a limit would be passed."""
    starts = [0, *(a for a, _ in spans[1:]), len(text)]
    for k in range(len(spans)):
        if starts[k + 1] - starts[k] > options.max_chars:
            raise ValueError(f"the sentence at {starts[k]} is longer than max_chars")
    wide = vectors.astype(np.float64)
    norms = np.linalg.norm(wide, axis=1)
    size = norms[1:] * norms[:-1]
    similar = np.divide((wide[1:] * wide[:-1]).sum(1), size, out=np.zeros(len(size)), where=size > 0).astype(np.float32)
    if options.percentile is None:
        low = similar < np.float32(options.threshold)
    else:
        low = similar <= similarity_threshold(similar, options.percentile)
    cuts = [0]
    for k in range(1, len(spans)):
        if low[k - 1] or starts[k + 1] - starts[cuts[-1]] > options.max_chars or k - cuts[-1] + 1 > options.max_sentences:
            cuts.append(k)
    return [(starts[a], starts[b]) for a, b in zip(cuts, [*cuts[1:], len(spans)], strict=True)] if spans else []


#: A sentence splitter: the sentences of a text, in order, as they stand in it.
Splitter = Callable[[str], list[str]]


def semantic_chunks(docs: DataFrame, provider: Provider, options: SemanticOptions = SemanticOptions(), split: Splitter = split_sentences) -> DataFrame:
    """Sentences joined while they are alike; one call to the provider a text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, t in zip(batch["document_id"], batch["text"], strict=True):
                spans = sentence_spans(t or "", split)
                if spans:
                    vectors = np.array(provider.embed([t[a:b] for a, b in spans], "document")) if len(spans) > 1 else np.zeros((1, 1))
                    rows += _rows(i, t, semantic_spans(t, vectors, spans, options))
            yield pd.DataFrame(rows, columns=["document_id", "chunk_index", "start_offset", "end_offset", "text"])

    return docs.select(F.col("document_id").cast("string"), "text").mapInPandas(run, SCHEMA)
