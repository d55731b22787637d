"""Streaming answers: questions answered as they come, and token streams put together by state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.rag import AskOptions, Retriever, converse
from ..providers import Provider


def file_stream(spark: SparkSession, path: str, schema: str, kind: str = "json", max_files: int = 100) -> DataFrame:
    """Rows of files as they appear, `max_files` a batch at most, so that a backlog doesn't become one batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(kind).load(path)


def ask_stream(questions: DataFrame, retrievers: list[Retriever], provider: Provider, path: str, checkpoint: str, options: AskOptions = AskOptions()) -> StreamingQuery:
    """Answers each micro-batch of questions (query_id, query) into a folder of its own, which a repeated batch replaces."""

    def write(batch: DataFrame, number: int) -> None:
        converse(batch, retrievers, provider, options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return questions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def assemble_stream(lines: DataFrame, idle: str = "10 minutes") -> DataFrame:
    """Event-stream lines (request_id, seq, line) of many requests, as they come, to whole answers (request_id, answer, finished).

    A request's pieces are its state, in the order of seq; it is given out when all up to its [DONE] have come, or, unfinished,
    when nothing has come for `idle`. Malformed events and lines without data add nothing. seq counts from 0 without gaps.
    """
    seconds = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pieces: dict[str, str] = json.loads(state.get[0]) if state.exists else {}
        done = state.get[1] if state.exists else -1
        if state.hasTimedOut:
            state.remove()
            yield _answer(key, pieces, False)
            return
        for batch in batches:
            for seq, line in zip(batch["seq"], batch["line"], strict=True):
                data = line[5:].strip() if line is not None and line.startswith("data:") else ""
                if data == "[DONE]":
                    done = int(seq) if done < 0 else min(done, int(seq))
                pieces[str(seq)] = _delta(data)
        if 0 <= done and all(str(k) in pieces for k in range(done)):
            state.remove()
            yield _answer(key, {k: v for k, v in pieces.items() if int(k) < done}, True)
            return
        state.update((json.dumps(pieces), done))
        state.setTimeoutDuration(seconds)

    kind = lines.schema["request_id"].dataType.simpleString()
    return lines.select("request_id", "seq", "line").groupBy("request_id").applyInPandasWithState(step, f"request_id {kind}, answer string, finished boolean", "pieces string, done long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def _delta(data: str) -> str:
    try:
        found = json.loads(data)
    except ValueError:
        return ""
    return found["delta"] if isinstance(found, dict) and isinstance(found.get("delta"), str) else ""


def _answer(key: tuple, pieces: dict[str, str], finished: bool) -> pd.DataFrame:
    return pd.DataFrame({"request_id": [key[0]], "answer": ["".join(pieces[k] for k in sorted(pieces, key=int))], "finished": [finished]})
