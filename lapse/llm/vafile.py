"""Exact top-k inner products over a vector-approximation file.

The file holds, for each vector, one small cell number per component beside the
exact vector, as columns of their own.  All cells of a component have the same
width, so the inner product of a query with a cell's centres misses the exact
one by at most a radius that depends on the query alone.

Phase one reads the cells and nothing else.  A first scan finds each query's kth
highest lower bound over all rows, a second one the rows whose upper bound is not
below it for some query.  Phase two reads the exact vectors of those rows only: a
task takes them best bound first, until no bound is left that could still change
the k best.  The k best of the tasks' results are the k best of all.

Queries are taken in blocks of at most about ``QUERY_BLOCK``; a block and one
bound per query of it are all that is collected and sent to the tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lapse.llm.common import drop_staged, shared_path, staged, tidy, worker_path

CELLS = 256
QUERY_BLOCK = 2048
#: Rows of the file per task, and per bound matrix.
TASK_ROWS, ROWS = 1 << 15, 4096
#: Exact vectors read at once.
STEP = 64
#: Sums below this are exact in doubles.
EXACT = 1 << 53


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v array<double>): floor(scale * x) of vectors without null or
    non-finite components; others take no part."""
    v = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("id"), v.alias("v"))


def cell_bounds(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per vector length, the smallest value and the cell width of each
    component over all vectors."""
    rows = vectors.select(F.size("v").alias("n"), F.posexplode("v").alias("at", "x")).groupBy("n", "at").agg(
        F.min("x").alias("lo"), F.max("x").alias("hi")).collect()  # one row per component of each length
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {0: (np.zeros(0), np.zeros(0))}
    for r in rows:
        low, width = out.setdefault(r.n, (np.zeros(r.n), np.zeros(r.n)))
        low[r.at], width[r.at] = r.lo, max((r.hi - r.lo + 1) / CELLS, 1.0)
    return out


def write_file(vectors: DataFrame, bounds: dict, path: str) -> None:
    """The approximation file: (row, id, cells binary, v array<double>), dealt
    out evenly; ``row`` is a number of each row's own."""
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", T.LongType()),
                           T.StructField("cells", T.BinaryType()), T.StructField("v", T.ArrayType(T.DoubleType()))])

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            cells = []
            for v in b.column(1):
                x = np.array(v.as_py(), float)
                low, width = bounds.get(len(x), (0.0, 1.0))
                cells.append(np.clip((x - low) // width, 0, CELLS - 1).astype(np.uint8).tobytes())
            rows = pa.array(np.arange(row, row + b.num_rows), pa.int64())
            row += b.num_rows
            yield pa.RecordBatch.from_arrays([rows, b.column(0), pa.array(cells, pa.binary()), b.column(1)], names=schema.names)

    tasks = max(vectors.sparkSession.sparkContext.defaultParallelism, -(-vectors.count() // TASK_ROWS))
    vectors.repartition(tasks).mapInArrow(tidy(run), schema).write.parquet(path)


class Queries:
    """The queries of a block that have one length, and what bounds their scores."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, keys: np.ndarray, low: np.ndarray, width: np.ndarray):
        self.ids, self.vectors, self.keys, self.low, self.width = ids, vectors, keys, low, width
        size = np.abs(vectors)
        most = np.maximum(np.abs(low), np.abs(low + CELLS * width))
        # half a cell on each component, and what rounding may add
        self.radius = size @ (width / 2) + 1e-12 * (size @ most) + 1e-6
        self.floor = np.full(len(ids), -np.inf)  # no result of the k best scores lower

    def middle(self, cells: np.ndarray) -> np.ndarray:
        """(query, row): the score is within ``radius`` of this."""
        return self.vectors @ (self.low + (cells + 0.5) * self.width).T


def _cell_blocks(b: pa.RecordBatch, queries: dict[int, Queries]):
    """(length, rows of the batch, their cells) in matrices of bounded size."""
    sizes = np.array(pc.binary_length(b.column("cells")))
    for n in queries:
        at = np.flatnonzero(sizes == n)
        for lo in range(0, len(at), ROWS):
            part = at[lo : lo + ROWS]
            cells = b.column("cells").take(pa.array(part)).to_pylist()
            yield n, part, np.frombuffer(b"".join(cells), np.uint8).reshape(len(part), n)


def kth_middles(cells: DataFrame, queries: dict[int, Queries], k: int) -> DataFrame:
    """(n, at, middle): of each query (its length and place) the kth highest
    middle over all rows but its own; queries with fewer rows have none."""

    def run(batches):
        best = {n: np.full((len(q.ids), k), -np.inf) for n, q in queries.items()}
        for b in batches:
            ids = np.array(b.column("id"))
            for n, part, c in _cell_blocks(b, queries):
                m = queries[n].middle(c)
                m[queries[n].ids[:, None] == ids[part]] = -np.inf
                both = np.concatenate([best[n], m], axis=1)
                best[n] = -np.partition(-both, k - 1, axis=1)[:, :k]
        for n, top in best.items():
            at, _ = np.nonzero(top > -np.inf)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n), pa.int32()), pa.array(at, pa.int32()),
                                                  pa.array(top[top > -np.inf])], names=["n", "at", "middle"])

    found = cells.mapInArrow(tidy(run), "n int, at int, middle double")
    order = Window.partitionBy("n", "at").orderBy(F.desc("middle"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.where(F.col("rank") == k).drop("rank")


def surviving_rows(cells: DataFrame, queries: dict[int, Queries]) -> DataFrame:
    """(row): rows whose upper bound reaches the floor of some query."""

    def run(batches):
        for b in batches:
            ids, keep = np.array(b.column("id")), np.zeros(b.num_rows, bool)
            for n, part, c in _cell_blocks(b, queries):
                q = queries[n]
                reach = (q.middle(c) + q.radius[:, None] >= q.floor[:, None]) & (q.ids[:, None] != ids[part])
                keep[part] = reach.any(axis=0)
            yield pa.RecordBatch.from_arrays([b.column("row").filter(pa.array(keep))], names=["row"])

    return cells.mapInArrow(tidy(run), "row long")


def _ints(rows: np.ndarray) -> np.ndarray:
    """Python integers, for sums too large for doubles."""
    return np.array([[int(x) for x in r] for r in rows], object).reshape(rows.shape)


class TaskSearch:
    """The k best of the rows that a task has seen, for each query of one length."""

    def __init__(self, queries: Queries, k: int):
        self.asked, self.ids, self.queries, self.k = queries, queries.ids, queries.vectors, k
        self.best: list[list[tuple[int, int]]] = [[] for _ in self.ids]  # (-score, id), best first
        self.kth = queries.floor.copy()
        self.size = np.abs(self.queries).max(initial=0)

    def add(self, ids: np.ndarray, cells: np.ndarray, exact: np.ndarray) -> None:
        upper = self.asked.middle(cells) + self.asked.radius[:, None]
        large = self.size * max(np.abs(exact).max(initial=0), 1) * exact.shape[1] >= EXACT
        for q in np.flatnonzero((upper >= self.kth[:, None]).any(axis=1)):
            self._query(q, ids, upper[q], exact, large)

    def _query(self, q: int, ids, upper, exact, large: bool) -> None:
        left = np.flatnonzero(upper >= self.kth[q])
        left = left[np.lexsort((ids[left], -upper[left]))]
        for at in range(0, len(left), STEP):
            part = left[at : at + STEP]
            if upper[part[0]] < self.kth[q]:
                return  # the kth result is certain
            part = part[ids[part] != self.ids[q]]
            if large:
                score = [int(s) for s in _ints(exact[part]) @ _ints(self.queries[q : q + 1])[0]]
            else:
                score = (exact[part] @ self.queries[q]).astype(np.int64).tolist()
            merged = sorted([*self.best[q], *zip((-s for s in score), ids[part].tolist(), strict=True)])
            self.best[q] = merged[: self.k]
            if len(self.best[q]) == self.k:
                self.kth[q] = -self.best[q][-1][0]


def _scan(rows: DataFrame, queries: dict[int, Queries], k: int) -> DataFrame:
    """(query_id, query, id, score): per task and query, the k best of the task's rows."""

    def run(batches):
        searches = {n: TaskSearch(q, k) for n, q in queries.items()}
        for b in batches:
            ids = np.array(b.column("id"))
            for n, part, cells in _cell_blocks(b, queries):
                exact = np.array(b.column("v").take(pa.array(part)).flatten(), float).reshape(len(part), n)
                searches[n].add(ids[part], cells, exact)
        for n, search in searches.items():
            rows = [(int(search.ids[q]), int(queries[n].keys[q]), i, -s) for q, best in enumerate(search.best) for s, i in best]
            if any(not -(1 << 63) <= r[3] < 1 << 63 for r in rows):
                raise OverflowError("an inner product does not fit into 64 bits")
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)],
                                                 names=["query_id", "query", "id", "score"])

    return rows.mapInArrow(tidy(run), "query_id long, query long, id long, score long")


def top_k(vectors: DataFrame, query_condition, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = 1024, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank from 1, id_col, score): for each row that meets
    ``query_condition`` the k rows of other id with the highest integer inner
    product of floor(scale * x), ties to the smaller id; all, if fewer.

    Rows without id, null vectors and vectors with null or non-finite
    components take no part.  Only vectors of equal length are compared.
    Repeated rows count as rows among the candidates; different query vectors
    under one id are searched each by itself, equal ones once.  No vectors or no queries: no rows.  An inner product that doesn't
    fit into 64 bits is an error.  Other columns are not read."""
    spark = vectors.sparkSession
    worker_path(spark)
    plain = staged(quantised(vectors, id_col, vector_col, scale), "vectors")
    bounds = cell_bounds(plain)
    path = shared_path(spark, "vafile")
    write_file(plain, bounds, path)
    file = spark.read.parquet(path)
    cells = file.select("row", "id", "cells")
    queries = plain.where(query_condition("id")).distinct().withColumn("query", F.xxhash64("id", "v"))
    blocks = max(1, -(-queries.count() // query_block))
    queries = staged(queries.withColumn("block", F.pmod("query", F.lit(blocks))), "queries")
    found = shared_path(spark, "found")
    for block in range(blocks):
        rows = queries.where(F.col("block") == block).collect()
        by_length: dict[int, list] = {}
        for r in rows:
            by_length.setdefault(len(r.v), []).append((r.id, r.v, r["query"]))
        sent = {n: Queries(np.array([x[0] for x in q]), np.array([x[1] for x in q], float).reshape(len(q), n),
                           np.array([x[2] for x in q]), *bounds[n]) for n, q in by_length.items()}
        for r in kth_middles(cells, sent, k).collect():  # at most one row per query of the block
            sent[r.n].floor[r["at"]] = r.middle - sent[r.n].radius[r["at"]]
        reached = staged(surviving_rows(cells, sent), "reached")
        _scan(file.join(reached, "row", "left_semi"), sent, k).write.mode("append").parquet(found)
        drop_staged(reached)
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "id")
    best = spark.read.parquet(found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("id").alias(id_col), "score")
