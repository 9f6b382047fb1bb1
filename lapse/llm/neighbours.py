"""Approximate nearest neighbours by cosine, through a few stable projections.

Unit vectors are projected onto ``DIMENSIONS`` random normal directions.  The
square of a projected distance over the square of the true one then follows a
chi-square distribution, whatever the vectors.  A kd-tree over the projections
hands out a query's neighbours in the order of their projected distances; each
is verified on the whole vectors, and the search ends as soon as a row as
close as the kth best found would, with probability ``CERTAINTY``, have been
handed out already.

The upper tree, fitted on a bounded sample, cuts all rows into cells; the rows
of a cell (of a slice of it, if there are many) get a tree of their own in the
task that searches them.  A query first searches its own cell, which bounds
its kth distance, and then the cells that the same test does not rule out."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lapse.llm.common import drop_staged, staged, tidy, worker_path

DIMENSIONS = 8
CERTAINTY = 0.95
#: Cells of the upper tree: rows / CELL_ROWS, within these limits.
CELL_ROWS, MIN_CELLS, MAX_CELLS = 1 << 14, 64, 1 << 12
#: The upper tree is fitted on about so many rows per cell.
SAMPLE = 64
#: Rows in a leaf of a cell's tree; leaves opened and rows verified at once.
LEAF, OPEN, STEP = 64, 8, 128
#: Queries of a cell that one task answers.
SHARD = 1 << 14
_SEED, _BLOCK = 20, 1024


def chi_square_bound(certainty: float, dimensions: int) -> float:
    """x with P(chi-square of an even number of dimensions <= x) = certainty."""
    def missing(x: float) -> float:
        return math.exp(-x / 2) * math.fsum((x / 2) ** i / math.factorial(i) for i in range(dimensions // 2))

    low, high = 0.0, 1.0
    while missing(high) > 1 - certainty:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if missing(middle) > 1 - certainty else (low, middle)
    return high


class Projection:
    """Normal directions, the first n rows of one endless table for vectors of length n."""

    def __init__(self, dimensions: int):
        self.dimensions, self.table = dimensions, np.zeros((0, dimensions))

    def __call__(self, units: np.ndarray) -> np.ndarray:
        n = units.shape[1]
        while len(self.table) < n:
            rng = np.random.default_rng([_SEED, len(self.table) // _BLOCK])
            self.table = np.vstack([self.table, rng.standard_normal((_BLOCK, self.dimensions))])
        return np.einsum("ij,jk->ik", units, self.table[:n])


def scaled(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows times a power of two each, which changes no cosine and keeps squares in range, and their norms."""
    _, power = np.frexp(np.abs(v).max(axis=1, initial=0))
    x = np.ldexp(v, -power[:, None])
    return x, np.sqrt(np.einsum("ij,ij->i", x, x))


def split(points: np.ndarray, leaves: int) -> list[tuple]:
    """kd-tree nodes (axis, value, left, right) or (-1, leaf, -1, -1): widest
    axis, at the median; nodes of equal points are not split."""
    nodes: list[tuple] = []
    count = [0]

    def grow(p: np.ndarray, leaves: int) -> int:
        here = len(nodes)
        nodes.append(())
        axis = int(np.argmax(np.ptp(p, axis=0))) if len(p) else 0
        value = float(np.median(p[:, axis])) if len(p) else 0.0
        left = p[:, axis] < value if len(p) else np.zeros(0, bool)
        if leaves > 1 and len(p) and not left.any():  # the median is the least value
            value = float(min(p[p[:, axis] > value, axis], default=value))
            left = p[:, axis] < value
        if leaves < 2 or not left.any() or left.all():
            nodes[here] = (-1, float(count[0]), -1, -1)
            count[0] += 1
        else:
            nodes[here] = (axis, value, grow(p[left], leaves // 2), grow(p[~left], leaves - leaves // 2))
        return here

    grow(points, leaves)
    return nodes


def cell_of(nodes: list[tuple], points: np.ndarray) -> np.ndarray:
    axis, value, left, right = (np.array(c) for c in zip(*nodes, strict=True))
    at = np.zeros(len(points), np.int64)
    while (inner := np.flatnonzero(axis[at] >= 0)).size:
        node = at[inner]
        at[inner] = np.where(points[inner, axis[node]] < value[node], left[node], right[node])
    return value[at].astype(np.int64)


def box_distances(point: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of a point to each box."""
    d = np.maximum(low - point, 0) + np.maximum(point - high, 0)
    return np.einsum("ij,ij->i", d, d)


class Cell:
    """Rows of one cell under a kd-tree of their projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projected: np.ndarray, bound: float):
        self.bound = bound
        leaves = max(1, -(-len(ids) // LEAF))
        leaf = cell_of(split(projected, leaves), projected)
        order = np.argsort(leaf, kind="stable")
        self.ids, self.p = ids[order], projected[order]
        self.x, self.norm = scaled(vectors[order])
        start = np.flatnonzero(np.diff(leaf[order], prepend=-1))
        self.start = np.append(start, len(ids))
        self.low, self.high = np.minimum.reduceat(self.p, start), np.maximum.reduceat(self.p, start)
        self.verified = 0

    def search(self, query_id: int, query: np.ndarray, norm: float, point: np.ndarray, k: int, kth: float) -> list[tuple[float, int]]:
        """(-cosine, id) of the best rows of another id, best first; kth: the
        square of a distance within which k rows are known.

        Rows are verified in the order of their projected distance.  Leaves are
        opened as they come near: a row has its turn once no unopened leaf can
        hold a nearer one."""
        best: list[tuple[float, int]] = []
        far = box_distances(point, self.low, self.high)
        order = np.argsort(far, kind="stable")
        rows, dist, opened = np.zeros(0, np.int64), np.zeros(0), 0
        while True:
            limit = self.bound * kth + 1e-12  # beyond it the stopping test holds
            frontier = far[order[opened]] if opened < len(order) else np.inf
            if len(rows) and dist[0] <= frontier:
                if dist[0] > limit:
                    return best
                n = min(STEP, int(np.searchsorted(dist, min(frontier, limit), side="right")))
                best, kth = self._verified(query_id, query, norm, rows[:n], k, best, kth)
                rows, dist = rows[n:], dist[n:]
            elif frontier > limit or opened == len(order):
                return best
            else:
                leaves = order[opened : opened + OPEN]
                opened += len(leaves)
                fresh = np.concatenate([np.arange(self.start[i], self.start[i + 1]) for i in leaves])
                d = self.p[fresh] - point
                rows, dist = np.append(rows, fresh), np.append(dist, np.einsum("ij,ij->i", d, d))
                by = np.argsort(dist, kind="stable")
                rows, dist = rows[by], dist[by]

    def _verified(self, query_id: int, query: np.ndarray, norm: float, rows: np.ndarray, k: int, best: list, kth: float):
        rows = rows[self.ids[rows] != query_id]
        self.verified += len(rows)
        cosine = np.einsum("ij,j->i", self.x[rows], query) / (self.norm[rows] * norm)
        if len(best) == k:
            better = cosine >= -best[-1][0]
            rows, cosine = rows[better], cosine[better]
        if len(rows):
            best = sorted([*best, *zip((-cosine).tolist(), self.ids[rows].tolist(), strict=True)])[:k]
            if len(best) == k:
                kth = min(kth, max(0.0, 2 + 2 * best[-1][0]))
        return best, kth


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): vectors that have a direction."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0))  # -0.0 is 0.0
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite
                         & F.exists(vector_col, lambda x: x != 0)).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


_PLACED = "id long, v array<double>, n int, p array<double>, cell long"


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, max(1, rows.shape[1]), dtype=np.int32), rows.ravel())


def _placed(rows: DataFrame, dimensions: int, nodes: list[tuple] | None) -> DataFrame:
    """(id, v) with length, projection and cell."""

    def run(batches):
        project = Projection(dimensions)
        for b in batches:
            sizes = np.array(b.column(1).value_lengths())
            for n in np.unique(sizes):
                part = b.take(pa.array(np.flatnonzero(sizes == n)))
                x, norm = scaled(part.column(1).flatten().to_numpy().reshape(part.num_rows, n))
                p = project(x / norm[:, None])
                cell = cell_of(nodes, p) if nodes else np.zeros(len(p), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.full(len(p), n, np.int32)), _lists(p), pa.array(cell)],
                    names=["id", "v", "n", "p", "cell"])

    return rows.mapInArrow(tidy(run), _PLACED)


_KEY = ("n", "cell", "slice", "shard")
_FOUND = "query_id long, query long, id long, score double"


def _search(rows: DataFrame, asked: DataFrame, sizes: DataFrame, k: int, bound: float) -> DataFrame:
    """The k best rows that each query finds in each cell it asks.  asked: (n,
    cell, query_id, query, v, p, kth); sizes: (n, cell, slices)."""
    shards = asked.groupBy("n", "cell").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
    deal = sizes.join(shards, ["n", "cell"])  # one row per cell: at most MAX_CELLS per vector length
    one = F.lit(None).cast("long")
    left = rows.join(deal, ["n", "cell"]).select(
        "n", "cell", F.pmod(F.xxhash64("id"), "slices").alias("slice"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"),
        F.lit(0).alias("asks"), "id", one.alias("query"), "v", "p", F.lit(0.0).alias("kth"))
    right = asked.join(deal, ["n", "cell"]).select(
        "n", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices").cast("long") - 1)).alias("slice"),
        F.pmod("query", "shards").cast("int").alias("shard"), F.lit(1).alias("asks"), F.col("query_id").alias("id"), "query", "v", "p", "kth")
    stream = left.withColumn("slice", F.col("slice").cast("long")).unionByName(right)
    dealt = stream.repartition(*_KEY).sortWithinPartitions(*_KEY, "asks")

    def runs(b: pa.RecordBatch):
        """Stretches of a batch with one key, rows or queries."""
        key = np.stack([np.array(b.column(i)).astype(np.int64) for i in range(5)], axis=1)
        edges = np.append(np.flatnonzero(np.any(np.diff(key, axis=0, prepend=key[:1] - 1) != 0, axis=1)), len(key))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            part = b.slice(lo, hi - lo)
            n = int(key[lo, 0])
            v = part.column(7).flatten().to_numpy().reshape(hi - lo, n)
            p = part.column(8).flatten().to_numpy().reshape(hi - lo, -1)
            yield tuple(key[lo, :4]), bool(key[lo, 4]), part, v, p

    def run(batches):
        now, held, cell = None, [], None  # the rows of one cell; a cell's queries come after all of its rows
        for b in batches:
            for key, asks, part, v, p in runs(b):
                if key != now:
                    now, held, cell = key, [], None
                ids = part.column(5).to_numpy()
                if not asks:
                    held.append((ids, v, p))
                    continue
                if not held:
                    continue  # a slice without rows
                cell = cell or Cell(*(np.concatenate(c) for c in zip(*held, strict=True)), bound)
                names, kth = part.column(6).to_numpy(), part.column(9).to_numpy()
                x, norm = scaled(v)
                found = [(int(ids[i]), int(names[i]), row, -score) for i in range(len(ids))
                         for score, row in cell.search(ids[i], x[i], norm[i], p[i], k, kth[i])]
                if found:
                    q, name, row, score = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(name, pa.int64()), pa.array(row, pa.int64()),
                                                      pa.array(score, pa.float64())], names=["query_id", "query", "id", "score"])

    return dealt.mapInArrow(tidy(run), _FOUND)


def _further(asked: DataFrame, boxes: dict[int, tuple], bound: float) -> DataFrame:
    """Queries with each cell that is not theirs and that the test, at the
    cell's nearest point, does not rule out."""
    names = ["n", "cell", "query_id", "query", "v", "p", "kth"]

    def run(batches):
        for b in batches:
            rows, cells = [], []
            columns = {c: b.column(b.schema.names.index(c)) for c in names}
            sizes, home, kth = (columns[c].to_numpy() for c in ("n", "cell", "kth"))
            p = columns["p"].flatten().to_numpy().reshape(b.num_rows, -1)
            for i in range(b.num_rows):
                cell, low, high = boxes[int(sizes[i])]
                near = box_distances(p[i], low, high) <= bound * kth[i] + 1e-12
                found = cell[near & (cell != home[i])]
                rows += [i] * len(found)
                cells += found.tolist()
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()) if c == "cell" else columns[c].take(at) for c in names], names=names)

    return asked.select(*names).mapInArrow(tidy(run), "n int, cell long, query_id long, query long, v array<double>, p array<double>, kth double")


def nearest(vectors: DataFrame, query_condition: Callable[[Column], Column], k: int = 5, id_col: str = "vec_id",
            vector_col: str = "embedding", dimensions: int = DIMENSIONS, certainty: float = CERTAINTY) -> DataFrame:
    """(query_id, rank from 1, id_col, score): for each row that meets
    ``query_condition`` the k rows of other id with the largest cosine found,
    ties to the smaller id; all, if fewer.  ``certainty`` bounds, per row, how
    likely one of the k nearest is found; 1.0 makes the search exact.

    Rows without id and vectors that are null, zero or hold null or non-finite
    components take no part.  Only vectors of equal length are compared.
    Repeated rows count as rows among the candidates; different query vectors
    under one id are searched each by itself, equal ones once.  Of equal
    vectors only those with the k + 1 smallest ids are indexed: no other can be
    among a query's k best.  No vectors or no queries: no rows.  Other columns
    are not read."""
    if dimensions < 2 or dimensions % 2:
        raise ValueError("the number of dimensions must be even")
    worker_path(vectors.sparkSession)
    bound = math.inf if certainty >= 1 else chi_square_bound(certainty, dimensions)
    plain = _valid(vectors, id_col, vector_col)
    least = Window.partitionBy("v").orderBy("id")
    once = plain.groupBy("id", "v").agg(F.count("*").alias("copies")).withColumn("__at", F.row_number().over(least))
    rows = staged(once.where(F.col("__at") <= k + 1).select(
        "id", "v", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int")))).drop("col"), "vectors")
    total = rows.count()
    cells = min(MAX_CELLS, max(MIN_CELLS, 1 << (total // CELL_ROWS).bit_length()))
    share = min(1.0, cells * SAMPLE / max(1, total))
    picked = rows.where(F.pmod(F.xxhash64("id", F.lit(_SEED)), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    sample = np.array([r.p for r in _placed(picked, dimensions, None).select("p").collect()], float).reshape(-1, dimensions)
    nodes = split(sample, cells)
    index = staged(_placed(rows, dimensions, nodes), "cells")
    drop_staged(rows)
    edges = [f(F.col("p")[i]).alias(f"{name}{i}") for i in range(dimensions) for name, f in (("low", F.min), ("high", F.max))]
    stats = staged(index.groupBy("n", "cell").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("slices"), *edges), "boxes")
    boxes: dict[int, list] = {}
    for r in stats.collect():  # one row per cell
        boxes.setdefault(r.n, []).append((r.cell, [r[f"low{i}"] for i in range(dimensions)], [r[f"high{i}"] for i in range(dimensions)]))
    arrays = {n: tuple(np.array(c) for c in zip(*b, strict=True)) for n, b in boxes.items()}
    sizes = stats.select("n", "cell", "slices")
    queries = staged(_placed(plain.where(query_condition("id")).distinct(), dimensions, nodes).select(
        "n", "cell", F.col("id").alias("query_id"), F.xxhash64("id", "v").alias("query"), "v", "p"), "queries")
    home = staged(_search(index, queries.withColumn("kth", F.lit(math.inf)), sizes, k, bound), "home")
    best_first = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "id")
    ranked = home.withColumn("rank", F.row_number().over(best_first))
    reach = ranked.where(F.col("rank") == k).select("query_id", "query", F.greatest(F.lit(0.0), 2 - 2 * F.col("score")).alias("kth"))
    asked = queries.join(reach, ["query_id", "query"], "left").withColumn("kth", F.coalesce("kth", F.lit(math.inf)))
    pairs = staged(_further(asked, arrays, bound), "asked")
    found = staged(_search(index, pairs, sizes, k, bound), "found")
    drop_staged(index, pairs)
    both = home.unionByName(found).withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    return both.select("query_id", "rank", F.col("id").alias(id_col), "score")
