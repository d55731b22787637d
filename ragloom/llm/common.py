"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one worker handles at once; what it holds besides is a small multiple of this.
SUB_BATCH_BYTES = 1 << 20

#: Bytes of an Arrow batch on its way to a worker; a row count alone would let long texts fill the memory.
ARROW_BATCH_BYTES = 16 << 20

#: ASCII white space that separates words, as bytes: space, and tab to carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_shipped: set[str] = set()


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, whatever else the table holds.

    Columns are found by exact name (the first of that name), so further columns that repeat a name or differ from
    it in case only cannot make the reference ambiguous.
    """
    found = [df.columns.index(n) for n in names]
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"c{i}").alias(n) for i, n in zip(found, names, strict=True)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; where it is unset, one of our own if all run in one process."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(named)
        return named
    at = sc._jsc.sc().getCheckpointDir()
    if not at.isDefined():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ragloom-checkpoint-"))
        at = sc._jsc.sc().getCheckpointDir()
    return str(at.get())


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows go to the shared folder, the lineage ends there, a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_shared_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, and make this package importable on workers whose PYTHONPATH lacks it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH_BYTES)
    root = Path(__file__).resolve().parents[2]
    sc = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or sc.applicationId in _shipped:
        return
    at = tempfile.mkdtemp(prefix="ragloom-ship-")  # read by the driver's file server only
    os.makedirs(f"{at}/in")
    shutil.copytree(root / "ragloom", f"{at}/in/ragloom", ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(f"{at}/ragloom", "zip", f"{at}/in"))
    _shipped.add(sc.applicationId)


def text_slices(batches: Iterator[pa.RecordBatch], text: str, budget: int = SUB_BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of about equal bytes of text; null texts become empty.

    A slice holds one row at least, so that a text above the budget is a slice of its own.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        i = batch.schema.get_field_index(text)
        filled = pc.fill_null(batch.column(i), "")
        batch = batch.set_column(i, pa.field(text, filled.type), filled)
        ends = np.cumsum(pc.binary_length(filled).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + budget, side="right")))
            yield batch.slice(at, to - at)
            at = to


def sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each text."""
    return pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def runs(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[pa.RecordBatch]:
    """Of batches sorted by a column, one batch for each run of equal values; a run may span batches."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if rest and rest[0].column(key)[0].as_py() != keys[0]:
            yield _joined(rest)
            rest = []
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        at = 0
        for to in cuts.tolist():
            yield _joined([*rest, batch.slice(at, to - at)])
            rest, at = [], to
        rest.append(batch.slice(at))
    if rest:
        yield _joined(rest)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
