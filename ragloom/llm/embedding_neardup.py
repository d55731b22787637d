"""Near-duplicate vectors by an inverted multi-index.

Two codebooks, one for each half of the normalised vectors, form a product grid of cells. Every vector lies in one
cell and visits the cells nearest to it in the multi-sequence order: by the sum of its two squared distances to the
codewords. It is compared with all vectors of the cells it visits: in single precision first, and in double precision
wherever that leaves a doubt.

How many cells are visited follows from the target recall: the least number at which that share of pairs at just the
threshold have one of the pair visit the other's cell. Such pairs are made by turning sampled vectors, which the
codebooks were not fitted on, by the threshold's angle in random directions. Closer pairs are found more often. Nothing
cuts the number off: it grows until the target is met, at the latest when all cells are visited, which is exact.

The codebooks are fitted on a sample of SAMPLE vectors and SAMPLE_BYTES bytes at most (those of the least hashed ids);
every vector is indexed. Codewords a half grow with the number of vectors, so that a cell holds about PER_CELL, as long
as the sample holds POINTS vectors a codeword, i.e. up to 4096 codewords a half and some 7e10 vectors. Vectors of each
length are searched by themselves.

Members and visitors of a cell meet in pairs of blocks, so no cell, however full, must fit one task. A block pair
returns a partial count of links a vector and a spanning forest of its links, never all pairs. A vector is shipped as
it is stored, once for each cell that it visits, so what is shuffled is a multiple of the table: the number of visits.

Defined results: a vector that is null, empty, zero, or holds null or non-finite components has no links. Vectors of
different lengths have none with each other. Equal vectors are one class that is searched once; each counts the others
as links. A row without id links with nothing: no component, not kept. No rows: no rows. Further columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pick, runs, ship
from .components import connected_components

SAMPLE, SAMPLE_BYTES = 65_536, 64 << 20
#: Sampled vectors a codeword, and at least.
POINTS, LEAST_SAMPLE = 16, 16_384
#: Sampled vectors that calibrate, and share of the sample that they may take.
HELD_OUT, HELD_OUT_SHARE = 2048, 0.25
PER_CELL = 4096
ROUNDS = 12
#: Members and visitors of a cell that meet in one task at once; rows that are compared at once.
BLOCK_MEMBERS, BLOCK_VISITORS, ROWS = 8192, 32_768, 512
#: More than what rounding can add to or take from a cosine in single precision, for each component.
SLACK = 2e-7
SEED = 20_240_607


def fit_codes(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k centres by Lloyd's rounds; a centre without points stays where it is."""
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = squared_distances(points, centres).argmin(1)
        count = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, points[:, d], len(centres)) for d in range(points.shape[1])], 1)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def squared_distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)[None]


class Grid:
    """The product of two codebooks."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second, self.visits = first, second, 1

    @property
    def cells(self) -> int:
        return len(self.first) * len(self.second)

    def nearest(self, units: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of each vector, in multi-sequence order.

        The i-th and k-th nearest codewords of the halves come after all i * k pairs of nearer ones, so only pairs
        with (i + 1) * (k + 1) <= n need be looked at.
        """
        half = self.first.shape[1]
        parts = [squared_distances(units[:, :half], self.first), squared_distances(units[:, half:], self.second)]
        orders = [np.argsort(p, axis=1, kind="stable")[:, :n] for p in parts]
        dist = [np.take_along_axis(p, o, 1) for p, o in zip(parts, orders, strict=True)]
        pairs = np.array([(i, k) for i in range(orders[0].shape[1]) for k in range(min(orders[1].shape[1], n // (i + 1)))])
        total = np.round(dist[0][:, pairs[:, 0]] + dist[1][:, pairs[:, 1]], 9)
        first = np.argsort(total, axis=1, kind="stable")[:, :n]
        cells = orders[0][:, pairs[:, 0]] * len(self.second) + orders[1][:, pairs[:, 1]]
        return np.take_along_axis(cells, first, 1).astype(np.int32)

    def calibrate(self, units: np.ndarray, threshold: float, recall: float, rng: np.random.Generator) -> None:
        """Set visits to the least number with which that share of pairs at the threshold is found by one of the two."""
        turn = rng.normal(size=units.shape)
        turn -= (turn * units).sum(1)[:, None] * units
        norm = np.linalg.norm(turn, axis=1)
        turned = threshold * units + np.sqrt(1 - threshold**2) * turn / np.where(norm > 0, norm, 1)[:, None]
        most = min(self.cells, 64)
        while True:
            a, b = self.nearest(units, most), self.nearest(turned, most)
            seen = lambda x, y: np.where((x == y[:, :1]).any(1), (x == y[:, :1]).argmax(1), most)  # noqa: E731, B023
            rank = np.sort(np.minimum(seen(a, b), seen(b, a)))
            self.visits = int(rank[min(len(rank) - 1, int(np.ceil(recall * len(rank))))] + 1)
            if self.visits <= most or most == self.cells:
                self.visits = min(self.visits, self.cells)
                return
            most = min(self.cells, 4 * most)


def _units(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in double precision, and divided by their lengths."""
    raw = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
    return raw, _normalised(raw)


def _normalised(raw: np.ndarray) -> np.ndarray:
    """Scaled first by the largest component, so that no square overflows or vanishes."""
    scaled = raw / np.maximum(np.abs(raw).max(1, initial=0), 1e-308)[:, None]
    return scaled / np.linalg.norm(scaled, axis=1)[:, None]


def _forest(near: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of links between rows and columns of a matrix; ids: of the rows, then of the columns."""
    node, n_rows = np.unique(ids, return_inverse=True)[1], near.shape[0]
    rows, cols = np.nonzero(near)
    a, b = node[rows], node[n_rows + cols]
    label, edges = np.arange(node.max() + 1), []

    def root(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    # each round links every class to one other, so a few rounds settle; edges in question shrink at once
    while True:
        roots = label
        while True:
            up = roots[roots]
            if np.array_equal(up, roots):
                break
            roots = up
        label = roots.copy()
        open_ = np.flatnonzero(label[a] != label[b])
        if not len(open_):
            return edges
        a, b, rows, cols = a[open_], b[open_], rows[open_], cols[open_]
        _, pick_one = np.unique(label[a], return_index=True)
        for k in pick_one.tolist():
            x, y = root(int(a[k])), root(int(b[k]))
            if x != y:
                label[max(x, y)] = min(x, y)
                edges.append((int(ids[rows[k]]), int(ids[n_rows + cols[k]])))


def _blocks(rows: pd.DataFrame, column: str, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells whose members, or visitors, need more than one block, in order, and how many."""
    need = -(-rows[column].to_numpy(np.int64) // block)
    rows, need = rows[need > 1], need[need > 1]
    order = np.argsort(rows["cell"].to_numpy())
    return rows["cell"].to_numpy(np.int64)[order], need[order]


def _need(known: tuple[np.ndarray, np.ndarray], cells: np.ndarray) -> np.ndarray:
    """Blocks of each of the cells: one unless known to be more."""
    if not len(known[0]):
        return np.ones(cells.shape, np.int64)
    at = np.minimum(np.searchsorted(known[0], cells), len(known[0]) - 1)
    return np.where(known[0][at] == cells, known[1][at], 1)


def _linked(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of a and b, unit vectors in double precision, have a cosine of the threshold or more."""
    out = np.zeros((len(a), len(b)), bool)
    small_a, small_b, slack = a.astype(np.float32), b.astype(np.float32), SLACK * (a.shape[1] + 8)
    for low in range(0, len(a), ROWS):
        cosine = small_a[low : low + ROWS] @ small_b.T
        near = out[low : low + ROWS]
        near[:] = cosine >= threshold + slack
        rows, cols = np.nonzero((cosine >= threshold - slack) & ~near)
        for at in range(0, len(rows), 1 << 16):
            r, c = rows[at : at + (1 << 16)], cols[at : at + (1 << 16)]
            near[r, c] = (a[low + r] * b[c]).sum(1) >= threshold
    return out


def _links(classes: DataFrame, grid: Grid, dimension: int, threshold: float) -> DataFrame:
    """(a, null, links): links that a vector has; (a, b, 0): links that join components. A checkpoint.

    classes: rep, times, v (all of one length).
    """
    kind = np.dtype(np.float64 if "double" in classes.schema["v"].dataType.simpleString() else np.float32)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                cells = grid.nearest(_units(part.column(0), dimension)[1], grid.visits)
                yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), pa.array(np.tile(np.arange(cells.shape[1], dtype=np.int32) == 0, len(cells)))], names=["cell", "home"])

    # only the cells that need several blocks, at most one for each BLOCK_MEMBERS vectors or BLOCK_VISITORS visits
    counts = classes.select("v").mapInArrow(visit, "cell int, home boolean").groupBy("cell").agg(F.count(F.when(F.col("home"), 1)).alias("members"), F.count("*").alias("visitors"))
    large = counts.where((F.col("members") > BLOCK_MEMBERS) | (F.col("visitors") > BLOCK_VISITORS)).toPandas()
    members, visitors = _blocks(large, "members", BLOCK_MEMBERS), _blocks(large, "visitors", BLOCK_VISITORS)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector, once for each pair of blocks it is in: as a member of its cell, as a visitor of those it visits."""
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                raw, units = _units(part.column(2), dimension)
                salt = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                cells = grid.nearest(units, grid.visits).astype(np.int64)
                m, v = _need(members, cells), _need(visitors, cells)
                # as a visitor: all member blocks of each cell; in its own it needn't where the members are one block
                need = m.copy()
                need[:, 0] = np.where((m[:, 0] == 1) & (v[:, 0] == 1), 0, m[:, 0])
                row, place = (np.repeat(x.ravel(), need.ravel()) for x in np.indices(cells.shape))
                block = np.arange(len(row)) - np.repeat(np.cumsum(need.ravel()) - need.ravel(), need.ravel())
                visit_of = [cells[row, place], block, salt[row] % v[row, place]]
                # as a member: all visitor blocks of its cell
                home = np.repeat(np.arange(len(ids)), v[:, 0])
                block = np.arange(len(home)) - np.repeat(np.cumsum(v[:, 0]) - v[:, 0], v[:, 0])
                member_of = [cells[home, 0], salt[home] % m[home, 0], block]
                taken = np.concatenate([row, home])
                data = [r.tobytes() for r in raw.astype(kind)]
                group = np.stack([np.concatenate(x) for x in zip(visit_of, member_of, strict=True)], 1)  # cell, its blocks of members and of visitors
                single = (_need(members, group[:, 0]) == 1) & (_need(visitors, group[:, 0]) == 1)
                role = np.arange(len(taken)) >= len(row)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in group], pa.binary()), pa.array(role), pa.array(single), part.column(0).take(pa.array(taken)), part.column(1).take(pa.array(taken)), pa.array([data[k] for k in taken.tolist()], pa.binary())], names=["g", "member", "single", "id", "times", "v"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches):
            member = group.column(1).to_numpy(zero_copy_only=False).astype(bool)
            ids, times = (group.column(k).to_numpy(zero_copy_only=False) for k in (3, 4))
            units = _normalised(np.frombuffer(b"".join(group.column(5).to_pylist()), kind).reshape(len(ids), dimension).astype(np.float64))
            m = np.flatnonzero(member)
            if not len(m):
                continue
            v = np.flatnonzero(~member)
            if group.column(2)[0].as_py():  # one block: members meet among themselves, as their own visitors
                v = np.concatenate([v, m])
            if not len(v):
                continue
            for low in range(0, len(v), ROWS * 8):  # what is held at once: so many rows by the members of a block
                own = v[low : low + ROWS * 8]
                near = _linked(units[own], units[m], threshold)
                near &= ids[own][:, None] != ids[m][None]
                if not near.any():
                    continue
                links = np.zeros(len(ids), np.int64)
                links[own] += near @ times[m]
                # where the member doesn't find the visitor by its own visits, the link counts for it here
                rows, cols = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
                homes = grid.nearest(units[own[rows]], 1)[:, 0]
                visits = grid.nearest(units[m[cols]], grid.visits)
                unseen = np.ones((len(rows), len(cols)), bool)
                for k, c in enumerate(visits):
                    unseen[:, k] = ~np.isin(homes, c)
                links[m[cols]] += times[own[rows]] @ (near[np.ix_(rows, cols)] & unseen)
                some = np.flatnonzero(links)
                edges = _forest(near, np.concatenate([ids[own], ids[m]]))
                a, b = zip(*edges, strict=True)
                n = len(some)
                yield pa.RecordBatch.from_arrays([pa.array([*ids[some].tolist(), *a], pa.int64()), pa.array([*[None] * n, *b], pa.int64()), pa.array([*links[some].tolist(), *[0] * len(a)], pa.int64())], names=["a", "b", "links"])

    dealt = classes.select(F.col("rep").alias("id"), "times", "v").mapInArrow(deal, "g binary, member boolean, single boolean, id long, times long, v binary")
    return cut(dealt.repartition("g").sortWithinPartitions("g").mapInArrow(meet, "a long, b long, links long"))


def vector_near_duplicates(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.99, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id_col, n_links, component_id, kept of each row."""
    spark = vectors.sparkSession
    ship(spark)
    plain = pick(vectors, id_col, vector_col).toDF("id", "v").select(F.col("id").cast("long").alias("id"), "v")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    plain = plain.withColumn("usable", F.coalesce(F.col("id").isNotNull() & F.col("v").isNotNull() & finite, F.lit(False)))
    keyed = plain.select("id", "usable", *(F.when(F.col("usable"), F.xxhash64(F.lit(k), "v")).alias(f"h{k}") for k in (1, 2)), "v")
    classes = cut(keyed.where("usable").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("times"), F.first("v").alias("v")).withColumn("length", F.size("v")))
    found = spark.createDataFrame([], "a long, b long, links long")
    for r in classes.groupBy("length").count().collect():  # as many rows as lengths
        if r["count"] > 1:
            own = classes.where(F.col("length") == r["length"])
            found = found.unionByName(_links(own, fit_grid(own, r["length"], r["count"], threshold, recall), r["length"], threshold))

    counted = found.where(F.col("b").isNull()).groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    joined = connected_components(found.where(F.col("b").isNotNull()).select("a", "b")).withColumnRenamed("node", "rep")
    known = classes.select("h1", "h2", "rep", "times").join(counted, "rep", "left").join(joined, "rep", "left")
    known = known.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = keyed.select("id", "h1", "h2").join(known, ["h1", "h2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def fit_grid(classes: DataFrame, dimension: int, total: int, threshold: float, recall: float) -> Grid:
    """The grid for a table of `total` vectors (columns rep, v), from a sample of them."""
    codes = int(np.ceil(np.sqrt(total / PER_CELL)))
    size = min(SAMPLE, max(LEAST_SAMPLE, POINTS * codes), max(64, SAMPLE_BYTES // (4 * dimension)))
    sample = classes.select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(size).toArrow()
    _, units = _units(sample.column("v").combine_chunks(), dimension)
    rng = np.random.default_rng(SEED)
    held = min(HELD_OUT, max(1, int(len(units) * HELD_OUT_SHARE)))
    fitted, held_out = units[held:], units[:held]
    codes = min(codes, max(1, len(fitted) // POINTS))
    half = max(1, dimension // 2)
    grid = Grid(fit_codes(fitted[:, :half], codes, rng), fit_codes(fitted[:, half:], codes if dimension > 1 else 1, rng))
    grid.calibrate(held_out, threshold, recall, rng)
    return grid
