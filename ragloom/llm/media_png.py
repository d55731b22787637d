"""Media columns: payloads stored as PNG images in binary columns, read back, and hashed by their low frequencies.

A payload becomes an 8-bit grey image of 64 samples a row. `encode_png` writes signature, IHDR, IDAT and IEND, each
with its checksum; `decode_png` tests signature, lengths, checksums and sizes, inflates, and undoes the five row
filters with numpy. `low_frequency_hash` shrinks the image to 32 by 32 means and keeps the signs of the 8 by 8 lowest
cosine coefficients against their median, as 16 hex digits.

Defined results: a null text is the empty text; the empty text is stored as one row of 64 zeros; equal texts give
equal values; repeated rows give repeated rows; a null id stays null; no rows: no rows. Long texts are stored whole, further
columns ignored. A corrupt or null image raises ValueError naming what failed.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SUB_BATCH_BYTES, pick, ship, text_slices

WIDTH = 64
LEVEL = 3
#: Row filters that are chosen from: those that are undone by running sums. All five are read.
CHOICES = (0, 1, 2)
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_GRID, _LOW = 32, 8


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def pad(data: bytes, unit: int = WIDTH) -> bytes:
    """Zeros after the data, up to a positive multiple of unit."""
    return data + bytes(-len(data) % unit if data else unit)


def _filter(image: np.ndarray, kind: int) -> np.ndarray:
    """What filter `kind` stores for each row of samples (one byte a sample)."""
    wide = image.astype(np.int16)
    left = np.zeros_like(wide)
    left[:, 1:] = wide[:, :-1]
    up = np.zeros_like(wide)
    up[1:] = wide[:-1]
    corner = np.zeros_like(wide)
    corner[1:, 1:] = wide[:-1, :-1]
    guess = (0, left, up, (left + up) >> 1, _paeth(left, up, corner))[kind]
    return (wide - guess).astype(np.uint8)


def _paeth(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    by_left, by_up, by_corner = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
    return np.where((by_left <= by_up) & (by_left <= by_corner), left, np.where(by_up <= by_corner, up, corner))


def choose_filters(image: np.ndarray) -> np.ndarray:
    """For each row the filter of CHOICES whose differences, taken as signed, sum up to least; the first of equals."""
    sums = [np.abs(_filter(image, kind).view(np.int8).astype(np.int16)).sum(1) for kind in CHOICES]
    return np.array(CHOICES, np.uint8)[np.argmin(sums, axis=0)]


def encode_png(payload: bytes, width: int = WIDTH, level: int = LEVEL, filters: bytes | None = None) -> bytes:
    """An 8-bit grey PNG; filters: the filter of each row, by default chosen for each."""
    if not payload or len(payload) % width:
        raise ValueError(f"payload must be a positive multiple of {width} bytes")
    image = np.frombuffer(payload, np.uint8).reshape(-1, width)
    rows = np.zeros((len(image), width + 1), np.uint8)
    rows[:, 1:] = image
    rows[:, 0] = choose_filters(image) if filters is None else np.frombuffer(filters, np.uint8)
    for kind in (1, 2, 3, 4):
        at = rows[:, 0] == kind
        if at.any():
            rows[at, 1:] = _filter(image, kind)[at]
    head = struct.pack(">IIBBBBB", width, len(image), 8, 0, 0, 0, 0)
    return b"".join((_SIGNATURE, _chunk(b"IHDR", head), _chunk(b"IDAT", zlib.compress(rows, level)), _chunk(b"IEND", b"")))


def _unfilter(rows: np.ndarray) -> np.ndarray:
    """Samples of rows that start with their filter's number; runs of equal filters are undone at once where possible."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown row filter")
    starts = np.flatnonzero(np.diff(kinds, prepend=255))
    for at, to in zip(starts, [*starts[1:], len(rows)], strict=True):
        kind, part = kinds[at], out[at:to]
        if kind == 1:  # left: a running sum along the row, modulo 256
            np.cumsum(part, axis=1, dtype=np.uint8, out=part)
        elif kind == 2:  # up: a running sum down the rows
            if at:
                part[0] += out[at - 1]
            np.cumsum(part, axis=0, dtype=np.uint8, out=part)
        elif kind > 2:  # a sample needs those left of it and above: diagonals of samples are undone at once
            held = np.zeros((to - at + 1, out.shape[1] + 1), np.int16)
            held[1:, 1:] = part
            held[0, 1:] = out[at - 1] if at else 0
            for d in range(2, held.shape[0] + held.shape[1] - 1):
                y = np.arange(max(1, d - held.shape[1] + 1), min(held.shape[0], d))
                x = d - y
                left, up = held[y, x - 1], held[y - 1, x]
                guess = (left + up) >> 1 if kind == 3 else _paeth(left, up, held[y - 1, x - 1])
                held[y, x] = (held[y, x] + guess) & 255
            part[:] = held[1:, 1:]
    return out


def decode_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG, after all tests."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, shape, parts, ended = 8, None, [], False
    while at < len(data):
        if len(data) < at + 12:
            raise ValueError("a chunk is cut off")
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body, check = data[at + 8 : at + 8 + n], data[at + 8 + n : at + 12 + n]
        if len(body) != n or len(check) != 4:
            raise ValueError("a chunk is cut off")
        if struct.unpack(">I", check)[0] != zlib.crc32(kind + body):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", body)
            if rest != [8, 0, 0, 0, 0] or not width or not height:
                raise ValueError("not an 8-bit grey image without interlace")
            shape = height, width
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            ended = True
            break
        elif not kind[0] & 32:
            raise ValueError(f"unknown critical chunk {kind!r}")
        at += 12 + n
    if not shape or not ended:
        raise ValueError("IHDR or IEND is missing")
    try:
        raw = zlib.decompress(b"".join(parts))
    except zlib.error as e:
        raise ValueError(f"zlib: {e}") from e
    if len(raw) != shape[0] * (shape[1] + 1):
        raise ValueError("wrong number of samples")
    return _unfilter(np.frombuffer(raw, np.uint8).reshape(shape[0], shape[1] + 1))


@lru_cache(maxsize=1)
def _cosines() -> np.ndarray:
    k, x = np.arange(_LOW)[:, None], np.arange(_GRID)[None]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * _GRID))


def _means(image: np.ndarray, axis: int) -> np.ndarray:
    """_GRID means along an axis: of each bin's samples, or the nearest sample where there are fewer than bins."""
    n = image.shape[axis]
    edges = np.arange(_GRID + 1) * n // _GRID
    starts = np.minimum(edges[:-1], n - 1)
    sums = np.add.reduceat(image, starts, axis=axis) if n >= _GRID else np.take(image, starts, axis=axis)
    count = np.maximum(1, np.diff(edges)) if n >= _GRID else np.ones(_GRID)
    return sums / (count[:, None] if axis == 0 else count)


def low_frequency_hash(image: np.ndarray) -> str:
    """16 hex digits: which of the 64 lowest cosine coefficients exceed their median."""
    small = _means(_means(image.astype(np.float64), 0), 1)
    low = np.round(_cosines() @ small @ _cosines().T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, media binary (the PNG) of each text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SUB_BATCH_BYTES):
            data = [t.encode() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array([encode_png(pad(x)) for x in data], pa.binary())], names=["id", "n_bytes", "media"])

    kept = pick(docs, id_col, text_col).toDF("id", "text")
    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def media_features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads the stored images back: sizes and digests of payload and stored form, and the low-frequency hash."""
    ship(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for stored in batch.column(2):
                data = stored.as_py()
                if data is None:
                    raise ValueError("an image is null")
                image = decode_png(data)
                payload = image.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), low_frequency_hash(image)))
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            columns = [pa.array(x, pa.int64() if k in (0, 2, 3) else pa.string()) for k, x in enumerate(zip(*rows, strict=True))] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["id", "n_bytes", *names])

    kept = pick(media, id_col, "n_bytes", "media").toDF("id", "n_bytes", "media")
    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").withColumnRenamed("id", id_col)
