"""Batching and bulk embedding with validation and retry; errors are values, not exceptions."""

from __future__ import annotations

import random
import re
import time
from collections import deque
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import TRANSIENT_PHRASES, TRANSIENT_STATUS
from ..options import EmbedOptions
from ..providers import Provider

_TRANSIENT = re.compile(f"{TRANSIENT_STATUS}|{TRANSIENT_PHRASES}", re.I)
_RESULT = "document_id string, chunk_index int, start_offset int, end_offset int, text string, batch_index long, embedding array<float>, is_success boolean, error_message string, attempts int"


def item_batches(rows: DataFrame, group: list[str], order: list[str], size: int = 32) -> DataFrame:
    """batch_index by count, in order, within each group."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("batch_index", F.floor((place - 1) / size).cast("long"))


def token_batches(rows: DataFrame, group: list[str], order: list[str], tokens: str, budget: int, size: int = 32) -> DataFrame:
    """Greedy batches of at most `budget` tokens and `size` items; a first item above the budget is admitted alone.

    One fold for each group, so groups should be of the size of a document.
    """
    item = F.struct(*order, F.col(tokens).cast("long").alias("_tokens"), F.struct(*[c for c in rows.columns if c not in group]).alias("_row"))
    items = F.array_sort(F.collect_list(item))
    start = F.struct(F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.array().cast("array<long>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = (acc["n"] > 0) & ((acc["used"] + x["_tokens"] > budget) | (acc["n"] >= size))
        batch = acc["batch"] + F.when(new, 1).otherwise(0)
        return F.struct(batch.alias("batch"), F.when(new, x["_tokens"]).otherwise(acc["used"] + x["_tokens"]).alias("used"), F.when(new, 1).otherwise(acc["n"] + 1).alias("n"), F.concat(acc["out"], F.array(batch)).alias("out"))

    folded = rows.groupBy(*group).agg(items.alias("_items")).withColumn("_batches", F.aggregate("_items", start, step)["out"])
    return folded.select(*group, F.explode(F.arrays_zip("_items", "_batches")).alias("_x")).select(*group, "_x._items._row.*", F.col("_x._batches").alias("batch_index"))


def call_with_retry(provider: Provider, texts: list[str], options: EmbedOptions, kind: str = "document") -> tuple[list | None, str | None, int]:
    """Vectors or an error message, and the attempts it took."""
    for attempt in range(options.retries + 1):
        try:
            vectors = provider.embed(texts, kind)
            problem = response_problem(vectors, len(texts), options.dimension)
            return (None, problem, attempt + 1) if problem else (vectors, None, attempt + 1)
        except Exception as e:  # noqa: BLE001 - a bad batch must not fail the job
            message = str(e) or type(e).__name__
            if attempt == options.retries or not _TRANSIENT.search(message):
                return None, message, attempt + 1
            delay = options.base_delay * 2**attempt
            time.sleep(delay + random.uniform(0, 0.5) * delay)
    raise AssertionError


def response_problem(vectors: list, n: int, dimension: int | None) -> str | None:
    if len(vectors) != n:
        return f"{len(vectors)} embeddings for {n} texts"
    want = dimension or (len(vectors[0]) if vectors else 0)
    for v in vectors:
        if not len(v):
            return "an embedding is empty"
        if len(v) != want:
            return f"an embedding has {len(v)} components, not {want}"
    if n and not np.isfinite(np.asarray(vectors, np.float64)).all():
        return "an embedding is not finite"
    return None


def embed_chunks(chunks: DataFrame, provider: Provider, options: EmbedOptions = EmbedOptions()) -> DataFrame:
    """Chunks with embedding, is_success, error_message and attempts; batches are cut within each partition.

    batch_index orders batches over all partitions: the partition in the upper bits, the batch within it in the lower 33.
    Up to `concurrency` batches of a partition are with the provider at once; results come in the order of the batches.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(options.concurrency) as pool:
            waiting: deque = deque()
            for rows, index in cut(batches):
                waiting.append(pool.submit(done, rows, index))
                if len(waiting) >= options.concurrency:
                    yield waiting.popleft().result()
            while waiting:
                yield waiting.popleft().result()

    def done(rows: pd.DataFrame, index: int) -> pd.DataFrame:
        vectors, error, attempts = call_with_retry(provider, rows["text"].tolist(), options)
        rows["batch_index"] = index
        rows["embedding"] = [np.asarray(v, np.float32) for v in vectors] if vectors else [None] * len(rows)
        rows["is_success"], rows["error_message"], rows["attempts"] = vectors is not None, error, attempts
        return rows

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, int]]:
        """Slices of the rows that hold a batch each."""
        context = TaskContext.get()
        index = (context.partitionId() if context else 0) << 33
        rest, used = [], [0, 0]  # slices of the open batch, its items and tokens
        for batch in batches:
            first = 0
            for k, cost in enumerate(len(t.encode("utf-16-le")) // 8 for t in batch["text"]):
                if used[0] and (used[0] >= options.max_items or options.max_tokens and used[1] + cost > options.max_tokens):
                    yield pd.concat([*rest, batch.iloc[first:k]], ignore_index=True), index
                    rest, used, first, index = [], [0, 0], k, index + 1
                used = [used[0] + 1, used[1] + cost]
            rest.append(batch.iloc[first:])
        if used[0]:
            yield pd.concat(rest, ignore_index=True), index

    valid = F.assert_true((F.trim("document_id") != "") & F.col("text").isNotNull() & (F.col("chunk_index") >= 0) & (F.col("start_offset") <= F.col("end_offset")), F.lit("a chunk is not valid"))
    return chunks.where(valid.isNull()).select("document_id", "chunk_index", "start_offset", "end_offset", "text").mapInPandas(run, _RESULT)


def progress(results: DataFrame) -> DataFrame:
    """Completed batches, chunks and failed batches, cumulative by batch_index.

    One row a batch meets in the window; it has no partition, as the totals run over all batches.
    """
    each = results.groupBy("batch_index").agg(F.count("*").alias("n"), F.max(F.when(F.col("is_success"), 0).otherwise(1)).alias("failed"))
    w = Window.orderBy("batch_index").rowsBetween(Window.unboundedPreceding, 0)
    return each.select("batch_index", F.count("*").over(w).alias("completed_batches"), F.sum("n").over(w).alias("total_chunks"), F.sum("failed").over(w).alias("failed_batches"))
