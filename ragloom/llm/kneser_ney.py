"""Language-model scoring: an interpolated modified Kneser-Ney bigram model, counted in Spark.

Tokens are the words between ASCII white space, A-Z in lower case, then one end. The training texts are counted in
three rounds, each a map over the texts that sends sorted, counted arrays to the parts of a table, and a reduce that
merges a part and writes it to the shared folder as sorted arrays:

1. words: 64-bit hashes in order, with counts. A word's number is its place in the order.
2. bigrams: pairs of word numbers in order, with counts; parts are a grid over both words, so that a word with very
   many neighbours is spread over a row or column of parts.
3. for each word number, how many different words come once, twice and more often after it, and how many before it.

Workers map the arrays into memory and look up each batch's distinct words and pairs by binary search. What a worker
holds is bounded by its batch; the model stays in the page cache and on the shared disk, and grows with the corpus.

P(w|v) = (max(c(v,w) - D, 0) + (D1 n1(v) + D2 n2(v) + D3 n3(v)) P(w)) / c(v), with D by c(v,w) = 1, 2, 3 or more, and
P(w) likewise from the number of different words before w, over a uniform 1 / (V + 1), V words and the unknown one. The
first word's context is the start; an unseen context leaves P(w). Where counts of counts leave a discount undefined,
it is 0.5, 1 or 1.5.

Defined results: a null text is the empty text, which has one token, the end; repeated rows give repeated rows and
count repeatedly; a row without id is held out of training. Without training texts every token has probability 1.
The shared folder must be mounted on the workers (a path or file: URI), as they map its files; a missing file is an
error. More than 2^32 - 3 distinct words are refused. No rows: no rows. Long texts are scored whole.
Further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, new_shared_path, pick, runs, ship, text_slices
from .shingles import words_of

#: Tokens that a worker counts before it sends them on.
CHUNK_TOKENS = 3_000_000
SLICE_BYTES = 2 << 20
#: Bytes of text a part of the model at most, which bounds what the worker that merges a part holds.
PART_BYTES = 32 << 20
#: The hash of the end; the number of the start, which no word has.
END = np.uint64(0xE4D5_0F7E_57E4_D001)
START = np.uint64(0xFFFF_FFFF)
_LOW = np.uint64(0xFFFF_FFFF)
#: Bytes of a count on its way to its part; zeros in the upper ones cost next to nothing once compressed.
COUNT_BYTES = 6


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens in order, ends included, and the number of tokens of each text."""
    words, counts = words_of(texts)
    ends = np.cumsum(counts)
    return np.insert(words, ends, END), counts + 1


def _pack(values: np.ndarray, width: int) -> bytes:
    """Numbers as their bytes by place, compressed; increasing numbers are best given as differences."""
    raw = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return zlib.compress(np.ascontiguousarray(raw.T), 1)


def _unpack(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def _blobs(parts: np.ndarray, n_parts: int, columns: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each part that occurs: its rows of the columns, the first in increasing order and sent as differences."""
    order = np.lexsort((columns[0], parts))
    parts, columns = parts[order], [c[order] for c in columns]
    cuts = np.searchsorted(parts, np.arange(n_parts + 1))
    used = np.flatnonzero(np.diff(cuts)).tolist()
    packed = [pa.array([_pack(np.diff(c[cuts[p] : cuts[p + 1]], prepend=np.uint64(0)) if k == 0 else c[cuts[p] : cuts[p + 1]], 8 if k == 0 else COUNT_BYTES) for p in used], pa.binary()) for k, c in enumerate(columns)]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *packed], names=["part", *(f"c{k}" for k in range(len(columns)))])


def _merged(group: pa.RecordBatch, n_columns: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct first numbers of a part in order, and the sums of the further columns."""
    key = np.concatenate([np.cumsum(_unpack(x.as_py(), 8), dtype=np.uint64) for x in group.column(1)])
    rest = [np.concatenate([_unpack(x.as_py(), COUNT_BYTES) for x in group.column(k + 2)]) for k in range(n_columns)]
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[starts], [np.add.reduceat(c[order], starts) for c in rest]


def _save(path: str, values: np.ndarray) -> None:
    """Whole or not at all, whichever attempt of a task comes last."""
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        np.save(f, values)
    os.replace(own, path)


def _hash_part(hashes: np.ndarray, n: int) -> np.ndarray:
    """Parts in the order of the hashes."""
    return (hashes >> np.uint64(40)) * np.uint64(n) >> np.uint64(24)


def _spread(numbers: np.ndarray, n: int) -> np.ndarray:
    return (numbers * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(n)


def _pair_part(pairs: np.ndarray, rows: int, columns: int) -> np.ndarray:
    return _spread(pairs >> np.uint64(32), rows) * np.uint64(columns) + _spread(pairs & _LOW, columns)


class Model:
    """The arrays in a folder, mapped into memory."""

    def __init__(self, path: str):
        self.path = path
        with open(f"{path}/model.json") as f:
            self.meta = json.load(f)
        for kind in ("word_parts", "pair_parts"):  # parts that hold something
            self.meta[kind] = set(self.meta.get(kind, ()))
        self.n = self.meta["parts"]
        self.starts = np.array(self.meta["starts"], np.uint64)  # the number of each part's first word
        self.maps: dict[str, np.ndarray] = {}

    def array(self, name: str) -> np.ndarray | None:
        if name not in self.maps:
            kind, part = name.rsplit("-", 1)
            held = self.meta["pair_parts" if kind.startswith("pair") else "word_parts"]
            # a file that is missing without being an empty part's is an error, not an unknown word
            self.maps[name] = np.load(f"{self.path}/{name}.npy", mmap_mode="r") if int(part) in held else None
        return self.maps[name]

    def _each_part(self, parts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(parts, kind="stable")
        cuts = np.searchsorted(parts[order], np.arange(self.n + 1, dtype=np.uint64))
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            yield p, order[cuts[p] : cuts[p + 1]]

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of distinct hashes in order; a count of 0: unknown."""
        number, count = np.full(len(hashes), _LOW - np.uint64(1), np.uint64), np.zeros(len(hashes), np.int64)
        for p, at in self._each_part(_hash_part(hashes, self.n)):
            keys = self.array(f"words-{p}")
            if keys is None:
                continue
            place = np.searchsorted(keys, hashes[at])
            found = keys[np.minimum(place, len(keys) - 1)] == hashes[at]
            number[at[found]] = self.starts[p] + place[found].astype(np.uint64)
            count[at[found]] = self.array(f"counts-{p}")[place[found]]
        return number, count

    def pairs(self, keys: np.ndarray) -> np.ndarray:
        """Counts of distinct pairs."""
        count = np.zeros(len(keys), np.int64)
        for p, at in self._each_part(_pair_part(keys, *self.meta["grid"])):
            known = self.array(f"pairs-{p}")
            if known is None:
                continue
            place = np.minimum(np.searchsorted(known, keys[at]), len(known) - 1)
            found = known[place] == keys[at]
            count[at[found]] = self.array(f"pair-counts-{p}")[place[found]]
        return count

    def around(self, number: np.ndarray) -> np.ndarray:
        """Of known word numbers: different words that come once, twice and more often after, and before (4 columns)."""
        out = np.zeros((len(number), 4), np.float64)
        parts = np.searchsorted(self.starts, number, side="right") - 1
        for p, at in self._each_part(parts):
            out[at] = self.array(f"around-{p}")[(number[at] - self.starts[p]).astype(np.int64)]
        return out

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, known tokens, base score and model score (log10) of each text."""
        m = self.meta
        hashes, lengths = tokens_of(texts)
        distinct, token = np.unique(hashes, return_inverse=True)
        number, count = self.words(distinct)
        known = count > 0
        around = np.zeros((len(distinct), 4))
        around[known] = self.around(number[known])
        total, size = m["tokens"], m["words"] + 1
        base = np.log10((count + 0.1) / (total + 0.1 * size))
        low = np.array([0.0, *m["low_discounts"]])
        before = around[:, 3]
        prior = np.full(len(distinct), 1.0 / size)
        if m["pairs"]:
            prior = (np.maximum(before - low[np.minimum(before, 3).astype(int)], 0) + m["low_left"] / size) / m["pairs"]
        # contexts: the token before, or the start
        firsts = np.cumsum(lengths) - lengths
        context = np.empty(len(token), np.int64)
        context[1:] = token[:-1]
        context[firsts] = len(distinct)
        seen = np.append(np.where(distinct == END, 0, count), m["texts"]).astype(np.float64)
        high = np.array(m["discounts"])
        left = np.append(around[:, :3] @ high, np.array(m["start"]) @ high)
        names = np.append(number, START)
        both = (seen[context] > 0) & known[token]
        keys = names[context[both]] << np.uint64(32) | number[token[both]]
        pair, place = np.unique(keys, return_inverse=True)
        c = np.zeros(len(token))
        c[both] = self.pairs(pair)[place]
        over = np.maximum(c - np.array([0.0, *high])[np.minimum(c, 3).astype(int)], 0)
        p = prior[token]
        inside = seen[context] > 0
        p[inside] = (over[inside] + left[context[inside]] * p[inside]) / seen[context[inside]]
        return lengths, np.add.reduceat(known[token].astype(np.int64), firsts), np.add.reduceat(base[token], firsts), np.add.reduceat(np.log10(p), firsts)


@lru_cache(maxsize=2)
def open_model(path: str) -> Model:
    return Model(path)


def discounts(times: list[int]) -> list[float]:
    """Of counts 1, 2, and 3 or more, from how many things were counted 1, 2, 3 and 4 times."""
    if min(times[:3]) <= 0:
        return [0.5, 1.0, 1.5]
    y = times[0] / (times[0] + 2 * times[1])
    return [min(max(k + 1 - (k + 2) * y * times[k + 1] / times[k], 0.0), k + 1.0) for k in range(3)]


def train(texts: DataFrame) -> str:
    """Counts the column `text` and returns the folder that holds the model."""
    spark = texts.sparkSession
    ship(spark)
    shared = urlparse(new_shared_path(spark, "kneser-ney"))
    if shared.scheme not in ("", "file"):
        raise ValueError(f"workers map the model's files, so spark.checkpoint.dir must be a mounted path, not {shared.scheme}:")
    path = shared.path
    os.makedirs(path, exist_ok=True)
    texts = pick(texts, "text").select(F.coalesce("text", F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")), int(size // PART_BYTES))
    rows = max(1, int(n**0.5))
    grid = [rows, n // rows]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
        held, tokens = [], 0
        for part in text_slices(batches, "text", SLICE_BYTES):
            held.append(tokens_of(part.column(0)))
            tokens += len(held[-1][0])
            if tokens >= CHUNK_TOKENS:
                yield held
                held, tokens = [], 0
        if held:
            yield held

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in chunks(batches):
            key, count = np.unique(np.concatenate([h for h, _ in held]), return_counts=True)
            yield _blobs(_hash_part(key, n), n, [key, count.astype(np.uint64)])

    def save_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches):
            p = group.column(0)[0].as_py()
            key, (count,) = _merged(group, 1)
            _save(f"{path}/words-{p}.npy", key)
            _save(f"{path}/counts-{p}.npy", count.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([len(key)], pa.int64()), pa.array([int(count.sum())], pa.int64())], names=["part", "words", "tokens"])

    sent = texts.mapInArrow(count_words, "part int, c0 binary, c1 binary")
    found = sent.repartition(n, "part").sortWithinPartitions("part").mapInArrow(save_words, "part int, words long, tokens long").collect()
    sizes = np.zeros(n, np.int64)
    for r in found:
        sizes[r["part"]] = r["words"]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    meta = {"parts": n, "grid": grid, "starts": starts.tolist(), "word_parts": np.flatnonzero(sizes).tolist(), "words": int(sizes.sum()), "tokens": sum(r["tokens"] for r in found)}
    if meta["words"] >= int(START) - 1:
        raise ValueError("too many distinct words for 32-bit numbers")
    _write_meta(path, meta)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(path)
        for held in chunks(batches):
            distinct, token = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            number = model.words(distinct)[0][token]
            lengths = np.concatenate([c for _, c in held])
            context = np.empty_like(number)
            context[1:] = number[:-1]
            context[np.cumsum(lengths) - lengths] = START
            key, count = np.unique(context << np.uint64(32) | number, return_counts=True)
            yield _blobs(_pair_part(key, *grid), n, [key, count.astype(np.uint64)])

    def save_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Writes a part of the pairs; sends on what it holds of each word: (number, comes after once, twice, more, before)."""
        for group in runs(batches):
            p = group.column(0)[0].as_py()
            key, (count,) = _merged(group, 1)
            _save(f"{path}/pairs-{p}.npy", key)
            _save(f"{path}/pair-counts-{p}.npy", count.astype(np.int64))
            v, w = key >> np.uint64(32), key & _LOW
            at = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            after = [np.add.reduceat((np.minimum(count, 3) == k).astype(np.uint64), at) for k in (1, 2, 3)]
            ends, before = np.unique(w, return_counts=True)
            number = np.concatenate([v[at], ends])
            zeros = np.zeros(len(ends), np.uint64)
            columns = [np.concatenate([a, zeros]) for a in after] + [np.concatenate([np.zeros(len(at), np.uint64), before.astype(np.uint64)])]
            times = [int((count == k).sum()) for k in (1, 2, 3, 4)] + [len(key)]
            first = v[at] == START
            own = [int(a[first].sum()) for a in after] + [int(count[v == START].sum())]
            inner = number != START
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), *(pa.array([x], pa.binary()) for x in (json.dumps([*times, *own, p]).encode(), None, None, None, None))], names=["part", "c0", "c1", "c2", "c3", "c4"])
            home = np.searchsorted(starts, number[inner], side="right") - 1
            yield _blobs(home.astype(np.uint64), n, [number[inner], *(c[inner] for c in columns)])



    sent = texts.mapInArrow(count_pairs, "part int, c0 binary, c1 binary")
    parts = cut(sent.repartition(n, "part").sortWithinPartitions("part").mapInArrow(save_pairs, "part int, c0 binary, c1 binary, c2 binary, c3 binary, c4 binary"))
    sums, held = np.zeros(9, np.int64), []
    for r in parts.where("part < 0").select("c0").collect():  # a row for each part
        *own, p = json.loads(bytes(r["c0"]))
        sums += own
        held.append(p)
    meta |= {"pair_parts": held, "discounts": discounts(sums[:4].tolist()), "pairs": int(sums[4]), "start": sums[5:8].tolist(), "texts": int(sums[8])}

    def save_around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches):
            p = group.column(0)[0].as_py()
            key, columns = _merged(group, 4)
            out = np.zeros((int(sizes[p]), 4), np.uint32)  # numbers of different words, which are under 2^32
            out[(key - np.uint64(starts[p])).astype(np.int64)] = np.stack(columns, 1)
            _save(f"{path}/around-{p}.npy", out)
            yield pa.RecordBatch.from_arrays([pa.array([[int((out[:, 3] == k).sum()) for k in (1, 2, 3, 4)] + [int((out[:, 3] > 4).sum())]], pa.list_(pa.int64()))], names=["times"])

    times = np.zeros(5, np.int64)
    for r in parts.where("part >= 0").repartition(n, "part").sortWithinPartitions("part").mapInArrow(save_around, "times array<long>").collect():
        times += r["times"]
    low = discounts(times[:4].tolist())
    meta |= {"low_discounts": low, "low_left": low[0] * int(times[0]) + low[1] * int(times[1]) + low[2] * int(times[2:].sum())}
    _write_meta(path, meta)
    return path


def _write_meta(path: str, meta: dict) -> None:
    with open(f"{path}/model.json.new", "w") as f:
        json.dump(meta, f)
    os.replace(f"{path}/model.json.new", f"{path}/model.json")


def score_texts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of each row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = open_model(model)
        for part in text_slices(batches, "text", SLICE_BYTES):
            n, known, base, score = own.score(part.column(2))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(known), pa.array(np.full(len(n), own.meta["tokens"], np.int64)), pa.array(base), pa.array(score), pa.array(10 ** (-score / n))], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    kept = pick(docs, id_col, text_col).toDF("id", "text")
    kept = kept.select("id", held_out(F.col("id")).alias("held_out"), "text")
    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double").withColumnRenamed("id", id_col)


def held_out(id_column: F.Column, folds: int = 10) -> F.Column:
    """Whether a row is kept out of training; rows without id are."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds == 0, F.lit(True))


def train_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learns from the rows that aren't held out and scores all rows."""
    plain = pick(docs, id_col, text_col)
    model = train(plain.where(~held_out(F.col(id_col))).select(F.col(text_col).alias("text")))
    return score_texts(plain, model, id_col, text_col)
