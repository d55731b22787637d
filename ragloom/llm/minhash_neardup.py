"""Near-duplicate documents: MinHash with tensored banding, links confirmed on full shingle sets.

Tensored banding: two collections of m small keys, each of ROWS minimum hashes; every pair of one key from either
side is a table key. m * m tables of 2 * ROWS hashes so need 2 * m * ROWS minimum hashes a document, not
m * m * 2 * ROWS. A pair of similarity s shares a table unless it differs in all keys of a side, so it is found with
probability (1 - (1 - s^ROWS)^m)^2; m is the least number that makes this 1 - MISS at the threshold.

Steps, all distributed:
1. Documents with equal shingle sets become one class, of the least id.
2. First pass, over the m diagonal tables: each class is compared with one leader, the least id it meets in a
   bucket, and takes it as its label if they are linked. This joins most of a large group by one comparison a member.
3. Second pass, over all tables: only buckets that hold two labels or more matter. Sizes and sketches say which
   members of different labels may be links; such pairs join documents to clusters.
4. Within clusters, such pairs are confirmed on full sets, a pair of blocks at a time; components of all links are the
   result.

Steps 3 and 4 pass on spanning forests, never the pairs of a group. A link left out by 3 would join what is one component already, so the classes lose nothing by it. The sketch (one
byte of each minimum hash) drops pairs that agree in far fewer places than the threshold lets expect: by five standard
deviations, which a pair at the threshold does with probability under 1e-6.

Defined results: a null or empty text, or one of white space only, has an empty set and links with nothing; repeated
rows of one id get equal results; a row without id links with nothing: no component, not kept. No rows: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pick, runs, ship, text_slices
from .components import connected_components
from .shingles import mix, shingles_of

ROWS = 3
MISS = 1e-4
#: Members of a bucket that meet in one task at once; larger buckets are dealt as pairs of blocks.
BLOCK = 1024
#: Documents and shingles of a cluster that meet in one task at once, likewise.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 200_000
#: Bits of the maps of hashed ids and bucket keys that workers filter by; a fixed size, so what is sent to them is bounded.
FILTER_BITS = 1 << 24


def side_size(percent: int) -> int:
    """Small keys a side."""
    return math.ceil(math.log(MISS / 2) / math.log(1 - (percent / 100) ** ROWS)) if percent < 100 else 1


def sketch_least(percent: int) -> int:
    """Places in which the sketches of a pair at the threshold agree at least, but for five standard deviations."""
    n, s = 2 * side_size(percent) * ROWS, percent / 100
    return max(0, math.floor(n * s - 5 * math.sqrt(n * s * (1 - s))))


def minimum_hashes(hashes: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """n minima for each document with shingles, as columns."""
    starts = np.cumsum(counts[counts > 0]) - counts[counts > 0]
    low = (hashes >> np.uint64(16)).astype(np.uint32)
    spread = (mix(np.arange(1, 2 * n + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((n, len(starts)), np.uint32)
    for k in range(n):
        out[k] = np.minimum.reduceat((low ^ spread[2 * k]) * (spread[2 * k + 1] | np.uint32(1)), starts) if len(starts) else 0
    return out


def _small_keys(minima: np.ndarray) -> np.ndarray:
    """The keys of both sides, each of ROWS minima."""
    parts = minima.astype(np.uint64).reshape(len(minima) // ROWS, ROWS, minima.shape[1])
    key = np.arange(len(parts), dtype=np.uint64)[:, None] + np.zeros((1, parts.shape[2]), np.uint64)
    for k in range(ROWS):
        key = mix(key ^ parts[:, k])
    return key.astype(np.int64)


def table_keys(keys: np.ndarray) -> np.ndarray:
    """The keys of all tables: each pair of a left and a right small key."""
    side = keys.shape[1] // 2
    left, right = keys[:, :side, None].astype(np.uint64), keys[:, None, side:].astype(np.uint64)
    return mix((mix(left) ^ right) * np.uint64(0x9E3779B97F4A7C15)).reshape(len(keys), -1).astype(np.int64)


def _all_keys(column: pa.Array) -> np.ndarray:
    return table_keys(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1))


def signatures(docs: DataFrame, side: int) -> DataFrame:
    """id, n (shingles), s1, s2 (128 bits of the set), keys (array of 2 * side), sketch (a byte of each minimum)."""
    both = 2 * side

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            hashes, counts = shingles_of(part.column(1))
            full = np.flatnonzero(counts)
            minima = minimum_hashes(hashes, counts, both * ROWS)
            keys = np.zeros((len(counts), both), np.int64)
            keys[full] = _small_keys(minima).T
            sketch = np.zeros((len(counts), len(minima)), np.uint8)
            sketch[full] = (minima & np.uint32(255)).T
            sums = np.zeros((2, len(counts)), np.uint64)
            if len(full):
                starts = (np.cumsum(counts) - counts)[full]
                sums[0, full] = np.add.reduceat(hashes, starts)
                sums[1, full] = np.add.reduceat(mix(hashes ^ np.uint64(0xA0761D6478BD642F)), starts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts), *(pa.array(s.view(np.int64)) for s in sums), pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * both), pa.array(keys.ravel())), pa.array([r.tobytes() for r in sketch], pa.binary())], names=["id", "n", "s1", "s2", "keys", "sketch"])

    return docs.mapInArrow(run, "id long, n long, s1 long, s2 long, keys array<long>, sketch binary")


def _similar_size(a: F.Column, b: F.Column, percent: int) -> F.Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _bit_map(hashes: DataFrame) -> np.ndarray:
    """A map of FILTER_BITS bits, those of the column's numbers set.

    It has one size whatever the input; with more numbers than bits it only lets more rows pass, and exact joins follow.
    """
    slots = hashes.toDF("h").select(F.pmod("h", F.lit(FILTER_BITS)).alias("slot"))
    words = slots.groupBy((F.col("slot") / 32).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(slot % 32))")).alias("bits"))
    found = words.toPandas()
    bits = np.zeros(FILTER_BITS // 32, np.uint32)
    bits[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).astype(np.uint32)
    return bits


def _in_map(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes.astype(np.int64) & (32 * len(bits) - 1)
    return bits[at >> 5] >> (at & 31).astype(np.uint32) & np.uint32(1) > 0


def _filtered(docs: DataFrame, ids: DataFrame, repeated: bool = True) -> DataFrame:
    """The documents (id, text) whose id may be among the ids; if ids are repeated, each different text of one once."""
    bits = _bit_map(ids.select(F.xxhash64(*ids.columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(pa.array(_in_map(bits, batch.column(2).to_numpy(zero_copy_only=False))))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["id", "text"])

    found = docs.where(F.col("id").isNotNull()).select("id", "text", F.xxhash64("id").alias("h")).mapInArrow(run, "id long, text string")
    return found.distinct() if repeated else found


def confirm(pairs: DataFrame, docs: DataFrame, percent: int, repeated: bool = True) -> DataFrame:
    """Those of the pairs (a, b) whose full sets satisfy 100 * intersection >= percent * union; a checkpoint."""
    texts = _filtered(docs, pairs.select(F.explode(F.array("a", "b"))), repeated)
    first = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = first.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[int | None, np.ndarray] = None, np.zeros(0)  # pairs come sorted by b, which often repeats
        for part in text_slices(batches, "text_a"):
            left, n = shingles_of(part.column(2))
            at = np.cumsum(n) - n
            ids_b = part.column(1).to_pylist()
            good = []
            for k, b in enumerate(ids_b):
                if known[0] != b:
                    known = b, shingles_of(pa.array([part.column(3)[k].as_py() or ""]))[0]
                own, other = left[at[k] : at[k] + n[k]], known[1]
                shared = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * shared >= percent * (len(own) + len(other) - shared):
                    good.append(k)
            kept = part.take(pa.array(good, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])

    return cut(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"))


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a graph, given as a symmetric matrix of booleans."""
    unseen, edges = np.ones(len(near), bool), []
    for root in np.flatnonzero(near.any(1)).tolist():
        if not unseen[root]:
            continue
        unseen[root], stack = False, [root]
        while stack:
            at = stack.pop()
            new = np.flatnonzero(near[at] & unseen)
            unseen[new] = False
            stack += new.tolist()
            edges += [(at, k) for k in new.tolist()]
    return edges


def _alike(component: np.ndarray, n: np.ndarray, own: np.ndarray, sketch: np.ndarray, percent: int) -> np.ndarray:
    """Matrix of the pairs that may be links: of different components, of similar size, with sketches that agree.

    Where rows of two blocks meet, pairs within one block are left to the group of that block alone.
    """
    least, out = sketch_least(percent), np.zeros((len(n), len(n)), bool)
    crossing = own.min() != own.max()
    for i in range(len(n) - 1):
        rest = slice(i + 1, None)
        near = (component[rest] != component[i]) & (np.minimum(n[rest], n[i]) * 100 >= np.maximum(n[rest], n[i]) * percent)
        if crossing:
            near &= own[rest] != own[i]
        if near.any():
            at = np.flatnonzero(near)
            out[i, i + 1 + at[(sketch[rest][at] == sketch[i]).sum(1) >= least]] = True
    return out | out.T


def _sketches(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(s.as_py(), np.uint8) for s in column])


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _dealt(rows: DataFrame, key: str, blocks: F.Column) -> DataFrame:
    """Rows of a key, split into blocks, once for each block that theirs meets; g: the pair of blocks."""
    own = F.pmod(F.xxhash64("id", key), F.col("blocks")).cast("int")
    split = rows.withColumn("blocks", blocks.cast("int")).withColumn("own", own)
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return split.withColumn("g", F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other"))).drop("other", "blocks", key)


def _clusters(members: DataFrame, percent: int) -> DataFrame:
    """(node, component): documents that possible links of one bucket or another join.

    members: key, size (rows of the bucket), id, component, n, sketch. A bucket gives a spanning forest of its pairs,
    not the pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for group in runs(batches):
            if group.num_rows < 2:
                continue
            ids, component, n, own = (group.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3, 4))
            found += [(int(ids[i]), int(ids[k])) for i, k in _forest(_alike(component, n, own, _sketches(group.column(5)), percent))]
            if len(found) > 10_000:
                yield _edges(found)
                found = []
        yield _edges(found)

    dealt = _dealt(members, "key", F.ceil(F.col("size") / BLOCK)).select("g", "id", "component", "n", "own", "sketch")
    return connected_components(dealt.repartition("g").sortWithinPartitions("g").mapInArrow(run, "a long, b long"))


def _intersections(texts: pa.Array) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by products of incidence matrices, some shingles at a time."""
    hashes, counts = shingles_of(texts)
    owner = np.repeat(np.arange(len(counts)), counts)
    _, shingle, times = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = times[shingle] > 1
    owner, shingle = owner[shared], np.unique(shingle[shared], return_inverse=True)[1]
    order = np.argsort(shingle, kind="stable")
    owner, shingle = owner[order], shingle[order]
    out = np.zeros((len(counts), len(counts)), np.float32)
    most = int(shingle[-1]) + 1 if len(shingle) else 0
    for low in range(0, most, 4096):
        at, to = np.searchsorted(shingle, [low, low + 4096])
        part = np.zeros((len(counts), min(4096, most - low)), np.float32)
        part[owner[at:to], shingle[at:to] - low] = 1
        out += part @ part.T
    return out.astype(np.int64)


def _confirm_clusters(clustered: DataFrame, docs: DataFrame, percent: int, repeated: bool) -> DataFrame:
    """Links (a, b) of different components within clusters: of each pair of blocks a spanning forest; a checkpoint.

    clustered: id, cluster, component, n, sketch.
    """
    sizes = clustered.groupBy("cluster").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_DOCS)).alias("most"))
    dealt = cut(_dealt(clustered.join(cut(sizes), "cluster"), "cluster", F.col("most")))
    texts = _filtered(docs, dealt.select("id"), repeated)
    whole = dealt.join(texts, "id").select("g", "id", "component", "n", "own", "sketch", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches):
            if group.num_rows < 2:
                continue
            ids, component, n, own = (group.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3, 4))
            near = _alike(component, n, own, _sketches(group.column(5)), percent)
            use = np.flatnonzero(near.any(1))
            if not len(use):
                continue
            ids, n, near = ids[use], n[use], near[np.ix_(use, use)]
            shared = _intersections(group.column(6).take(pa.array(use)).fill_null(""))
            near &= 100 * shared >= percent * (n[:, None] + n[None] - shared)
            yield _edges([(int(ids[i]), int(ids[k])) for i, k in _forest(near)])

    return cut(whole.repartition("g").sortWithinPartitions("g").mapInArrow(run, "a long, b long"))


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id, kept of each row."""
    ship(docs.sparkSession)
    plain = pick(docs, id_col, text_col).toDF("id", "text").select(F.col("id").cast("long").alias("id"), "text")
    side = side_size(percent)
    signed = cut(signatures(plain, side))
    sets = signed.where((F.col("n") > 0) & F.col("id").isNotNull())
    # classes of equal sets, which have equal signatures
    grouped = sets.groupBy("n", "s1", "s2")
    reps = cut(grouped.agg(F.min("id").alias("id"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")))

    # first pass: diagonal tables, one leader each
    left, right = F.slice("keys", 1, side), F.slice("keys", side + 1, side)
    diagonal = reps.select("id", F.explode(F.zip_with(left, right, lambda x, y: F.xxhash64(x, y))).alias("key"))
    leaders = diagonal.groupBy("key").agg(F.min("id").alias("lead"), F.count("*").alias("size")).where("size > 1").select("key", "lead")
    met = diagonal.join(cut(leaders), "key").where("id > lead").groupBy("id").agg(F.min("lead").alias("lead"))
    counted = reps.select("id", "n")
    pairs = met.join(counted, "id").join(counted.select(F.col("id").alias("lead"), F.col("n").alias("m")), "lead")
    pairs = cut(pairs.where(_similar_size(F.col("n"), F.col("m"), percent)).select(F.col("id").alias("a"), F.col("lead").alias("b")))
    # copies of a row must not meet each other's in the joins below
    repeated = not sets.groupBy("id").count().where("count > 1").isEmpty()
    links = confirm(pairs, plain, percent, repeated)
    # a label for each class that has a link: what it is linked to; equal labels are one component
    labels = links.select(F.col("a").alias("id"), F.col("b").alias("label"))

    # second pass: all tables, buckets of several labels
    labelled = cut(reps.join(labels, "id", "left").select("id", "n", "keys", "sketch", F.coalesce("label", "id").alias("component")))

    def every_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                keys = _all_keys(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(len(keys)), keys.shape[1]))), pa.array(keys.ravel())], names=["component", "key"])

    in_buckets = labelled.select("component", "keys").mapInArrow(every_key, "component long, key long")
    several = cut(in_buckets.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low < high").select("key", "size"))
    bits = _bit_map(several.select("key"))

    def some_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                keys = _all_keys(part.column(4))
                row, place = np.nonzero(_in_map(bits, keys))
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns[:4], pa.array(keys[row, place])], names=["id", "n", "component", "sketch", "key"])

    members = labelled.select("id", "n", "component", "sketch", "keys").mapInArrow(some_keys, "id long, n long, component long, sketch binary, key long").join(several, "key")
    clusters = _clusters(members, percent).select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    more = _confirm_clusters(labelled.select("id", "component", "n", "sketch").join(clusters, "id"), plain, percent, repeated)
    final = connected_components(links.unionByName(more))

    named_classes = reps.select("id", "n", "s1", "s2").join(final.withColumnRenamed("node", "id"), "id", "left").select("n", "s1", "s2", F.coalesce("component", "id").alias("component"))
    out = signed.select("id", "n", "s1", "s2").join(named_classes, ["n", "s1", "s2"], "left")
    component = F.when(F.col("id").isNull(), None).otherwise(F.when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("component", "id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))
