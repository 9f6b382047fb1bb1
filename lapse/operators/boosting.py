"""Gradient boosting over feature histograms, with L2 on the leaf values.

Features are binned once.  A round adds a tree: per open node, feature and bin
the gradients and hessians of the log loss are summed, the split with the
largest second-order gain is taken, and a leaf's value is -G / (H + L2) times
the learning rate.  Nodes are split best gain first, up to a number of leaves.

Gradients and hessians are rounded to multiples of 2**-24, so their sums are
whole numbers and the same however the rows are dealt out.  Two ways lead to
them: one Spark aggregate per level of a tree (about 255 rows per open node and
feature reach the driver), or, for at most ``LOCAL_ROWS`` rows, one task that
holds the binned rows and grows all trees by the same rules.  Both read a split's
smaller child only and sum features of few bins together."""

from __future__ import annotations

import heapq
import json
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapse.operators.quantiles import stacked_quantiles
from lapse.session import worker_path
from lapse.staging import drop_staged, staged

#: Fits of up to so many rows run in one task (about 100 bytes a row and 2 per feature).
LOCAL_ROWS = 1 << 21
SCALE = float(1 << 24)
#: Rounds between two writes of the gradients in the distributed fit.
KEEP_ROUNDS = 1
#: A row of the distributed fit at the start of a round.
STATE = "y double, w double, bins binary, raw double, g long, h long"


@dataclass(frozen=True)
class Params:
    rounds: int = 300
    learning_rate: float = 0.05
    max_depth: int = 6
    max_leaves: int = 31
    min_rows: int = 20
    min_hessian: float = 1e-3
    l2: float = 0.1
    max_bins: int = 255


@dataclass
class Tree:
    """Nodes in the order they were made; feature -1 marks a leaf.  A row goes
    left if its value is at most the threshold (its bin at most ``bin``)."""
    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    rows: list[int] = field(default_factory=list)

    def add(self, value: float, rows: int) -> int:
        for column, x in ((self.feature, -1), (self.bin, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1),
                          (self.value, value), (self.gain, 0.0), (self.rows, rows)):
            column.append(x)
        return len(self.feature) - 1


def _walk(tree: Tree, columns: np.ndarray, cuts: list) -> np.ndarray:
    """Leaf of each row; ``columns`` and ``cuts`` are values and thresholds, or bins and bins."""
    feature, left, right = np.array(tree.feature), np.array(tree.left), np.array(tree.right)
    cut, at = np.array(cuts), np.zeros(len(columns), np.int64)
    while (inner := np.flatnonzero(feature[at] >= 0)).size:
        node = at[inner]
        at[inner] = np.where(columns[inner, feature[node]] <= cut[node], left[node], right[node])
    return at


@dataclass
class HistogramBooster:
    """A fitted ensemble: constant size, whatever the number of rows."""
    names: list[str]
    trees: list[Tree]
    base: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += np.array(tree.value)[_walk(tree, x, tree.threshold)]
        return out

    def probability(self, features: Column) -> Column:
        """Of the positive class, from an array column of the features in order."""
        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            return pd.Series(1.0 / (1.0 + np.exp(-self.raw(np.stack(x.to_numpy()))))) if len(x) else pd.Series([], dtype=float)

        return score(features)

    @property
    def featureImportances(self) -> DenseVector:  # as pyspark.ml's ensembles call it
        gains = np.zeros(len(self.names))
        for tree in self.trees:
            np.add.at(gains, [f for f in tree.feature if f >= 0], [g for f, g in zip(tree.feature, tree.gain, strict=True) if f >= 0])
        return Vectors.dense(gains / gains.sum() if gains.sum() else gains)

    def to_json(self) -> str:
        return json.dumps({"names": self.names, "base": self.base, "trees": [vars(t) for t in self.trees]})

    @staticmethod
    def from_json(text: str) -> HistogramBooster:
        blob = json.loads(text)
        return HistogramBooster(blob["names"], [Tree(**t) for t in blob["trees"]], blob["base"])


def bin_edges(rows: DataFrame, names: list[str], max_bins: int, exact: bool = False) -> list[np.ndarray]:
    """Upper ends of all bins but the last, per feature: its values if there are
    at most ``max_bins``, else its quantiles (by sketch, or ``exact``)."""
    few = rows.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in names]).first()
    small = [c for c in names if few[c] <= max_bins * 1.2 + 8]  # so few values can be collected
    values = rows.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in small]).first() if small else {}
    probs = [i / max_bins for i in range(1, max_bins)]
    large = [c for c in names if c not in small or len(values[c]) > max_bins]
    quantiles = {}
    if large and exact:
        quantiles = {r["feature"]: [r[f"q{i}"] for i in range(len(probs))] for r in stacked_quantiles(rows, large, probs).collect()}
    elif large:
        found = rows.agg(*[F.percentile_approx(c, probs, 10_000).alias(c) for c in large]).first()
        quantiles = {c: found[c] for c in large}
    return [np.unique(np.array(quantiles[c], float)) if c in large else np.array(values[c][:-1], float) for c in names]


def _gain(g, h, l2: float):
    return g * g / (h + l2)


def best_splits(hists: np.ndarray, p: Params) -> list[tuple[float, int, int, np.ndarray] | None]:
    """Per node (gain, feature, bin, sums on the left) of the best allowed
    split; hists: nodes x features x bins x (gradient, hessian, rows).  Ties go
    to the first feature and bin."""
    left = np.cumsum(hists, axis=2)
    total = left[:, :, -1:, :]
    right = total - left
    g, h, n = np.moveaxis(left, 3, 0)
    gr, hr, nr = np.moveaxis(right, 3, 0)
    least = p.min_hessian * SCALE
    ok = (n >= p.min_rows) & (nr >= p.min_rows) & (h >= least) & (hr >= least)
    gain = (_gain(g / SCALE, h / SCALE, p.l2) + _gain(gr / SCALE, hr / SCALE, p.l2)
            - _gain(total[..., 0] / SCALE, total[..., 1] / SCALE, p.l2))
    gain = np.where(ok, gain, -np.inf).reshape(len(hists), -1)
    best = []
    for node, at in enumerate(np.argmax(gain, axis=1).tolist()):
        f, b = divmod(at, hists.shape[2])
        best.append((float(gain[node, at]), f, b, left[node, f, b]) if gain[node, at] > 0 else None)
    return best


def grow(histograms, edges: list[np.ndarray], p: Params) -> tuple[Tree, Tree, list[int]]:
    """A tree, all splits that were found, and the node of the tree that the rows
    of each of their nodes belong to.  ``histograms(tree, nodes)`` gives the histogram of each of the
    nodes, leaves of the tree so far.  A level is asked for at once, but of each
    split only the child with fewer rows: the other has the rest of its parent's
    sums, which are whole numbers.  Then the splits are taken in the order of
    their gains."""
    def value(sums):
        return float(-(sums[0] / SCALE) / (sums[1] / SCALE + p.l2) * p.learning_rate)

    full = Tree()
    full.add(0.0, 0)
    level, splits, sums = [0], {}, {}
    found = histograms(full, level)
    for depth in range(p.max_depth):
        after, parents, fewer = [], [], []
        for at, (node, hist, split) in enumerate(zip(level, found, best_splits(found, p), strict=True)):
            if node == 0:
                sums[0] = hist[0].sum(axis=0)
            if split is None:
                continue
            gain, f, b, left = split
            splits[node] = split
            full.feature[node], full.bin[node], full.threshold[node] = f, b, float(edges[f][b])
            full.left[node], full.right[node] = full.add(0.0, 0), full.add(0.0, 0)
            sums[full.left[node]], sums[full.right[node]] = left, sums[node] - left
            parents.append(at)
            fewer.append(int(2 * left[2] > sums[node][2]))
            after += [full.left[node], full.right[node]]
        level = after
        if not level or depth + 1 == p.max_depth:
            break
        one, pairs = np.array(fewer), np.arange(len(parents))
        part = histograms(full, [level[2 * i + k] for i, k in enumerate(fewer)])
        both = np.empty((len(parents), 2, *found.shape[1:]))
        both[pairs, one], both[pairs, 1 - one] = part, found[parents] - part
        found = both.reshape(len(level), *found.shape[1:])
    tree = Tree()
    tree.add(value(sums[0]), int(sums[0][2]))
    waiting, places = [(-splits[0][0], 0, 0)] if 0 in splits else [], {0: 0}
    leaves = 1
    while waiting and leaves < p.max_leaves:
        _, at, node = heapq.heappop(waiting)
        tree.feature[at], tree.bin[at], tree.threshold[at] = full.feature[node], full.bin[node], full.threshold[node]
        tree.gain[at] = splits[node][0]
        for side in ("left", "right"):
            child = getattr(full, side)[node]
            places[child] = tree.add(value(sums[child]), int(sums[child][2]))
            getattr(tree, side)[at] = places[child]
            if child in splits:
                heapq.heappush(waiting, (-splits[child][0], places[child], child))
        leaves += 1
    for node, (left, right) in enumerate(zip(full.left, full.right, strict=True)):
        if left >= 0:  # a parent comes before its children
            places.setdefault(left, places[node])
            places.setdefault(right, places[node])
    return tree, full, [places[node] for node in range(len(full.feature))]


def _base(y1: float, all_: float) -> float:
    share = y1 / all_ if all_ else 0.5
    return float(np.log(share / (1 - share))) if 0 < share < 1 else 0.0


def _bundles(widths: list[int]) -> list[list[int]]:
    """Features that are summed together: while their bins have at most 256
    combinations, those are the cells, and a feature's sums are sums of cells."""
    out: list[list[int]] = []
    for f in sorted(range(len(widths)), key=lambda f: widths[f]):
        if out and math.prod(widths[x] for x in out[-1]) * widths[f] <= 256:
            out[-1].append(f)
        else:
            out.append([f])
    return out


def _cells(bins: np.ndarray, bundles: list[list[int]], widths: list[int]) -> list[np.ndarray]:
    """Of each bundle the cell of every row; bins: rows x features."""
    shape = [tuple(widths[f] for f in some) for some in bundles]
    return [np.ravel_multi_index(tuple(bins[:, f] for f in some), by).astype(np.uint8) for some, by in zip(bundles, shape, strict=True)]


def _sums(cells: list[np.ndarray], g: np.ndarray, h: np.ndarray, bundles: list[list[int]], widths: list[int]) -> np.ndarray:
    """features x bins x (gradient, hessian, rows)."""
    out = np.zeros((len(widths), max(widths), 3))
    for cell, some in zip(cells, bundles, strict=True):
        by = [widths[f] for f in some]
        cell, n = cell.astype(np.intp), math.prod(by)
        joint = np.stack([np.bincount(cell, g, n), np.bincount(cell, h, n), np.bincount(cell, minlength=n)], axis=1).reshape(*by, 3)
        for i, f in enumerate(some):
            out[f, : by[i]] = joint.sum(axis=tuple(j for j in range(len(by)) if j != i))
    return out


def _gradients(raw: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    prob = 1.0 / (1.0 + np.exp(-raw))
    return np.round(w * (prob - y) * SCALE), np.round(w * prob * (1 - prob) * SCALE)


def _picked(x: np.ndarray, rows: np.ndarray | None) -> np.ndarray:
    return x if rows is None else x.take(rows)


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1).astype(np.uint8)


def fit_in_memory(x: np.ndarray, y: np.ndarray, w: np.ndarray, edges: list[np.ndarray], p: Params) -> tuple[list[Tree], float]:
    """All rounds over rows in memory."""
    return fit_bins(to_bins(x, edges), y, w, edges, p)


def fit_bins(bins: np.ndarray, y: np.ndarray, w: np.ndarray, edges: list[np.ndarray], p: Params) -> tuple[list[Tree], float]:
    """All rounds over binned rows in memory.  The rows of each node are kept as
    a list, so a level reads only the rows of the nodes that it asks for."""
    widths = [len(e) + 1 for e in edges]
    bundles, columns = _bundles(widths), list(np.ascontiguousarray(bins.T))
    cells = _cells(bins, bundles, widths)
    base = _base(float((w * y).sum()), float(w.sum()))
    raw, trees = np.full(len(y), base), []
    for _ in range(p.rounds):
        g, h = _gradients(raw, y, w)
        rows: dict[int, np.ndarray | None] = {0: None}  # None: all

        def split(tree, rows=rows):
            for node in [n for n in rows if tree.feature[n] >= 0]:
                mine = rows.pop(node)
                left = _picked(columns[tree.feature[node]], mine) <= tree.bin[node]
                for child, side in ((tree.left[node], left), (tree.right[node], ~left)):
                    rows[child] = np.flatnonzero(side) if mine is None else mine.compress(side)

        def histograms(tree, nodes, g=g, h=h, rows=rows):
            split(tree)
            return np.stack([_sums([_picked(c, rows[n]) for c in cells], _picked(g, rows[n]), _picked(h, rows[n]), bundles, widths) for n in nodes])

        tree, full, places = grow(histograms, edges, p)
        split(full)
        for node, mine in rows.items():
            raw[... if mine is None else mine] += tree.value[places[node]]
        trees.append(tree)
    return trees, base


def byte_column(bins: np.ndarray) -> pa.Array:
    """A matrix of bytes as a binary column, a value per row."""
    ends = np.arange(len(bins) + 1, dtype=np.int32) * bins.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(bins), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(bins))])


def byte_rows(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of ``width`` bytes a value as a matrix."""
    ends = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32, len(column) + 1 + column.offset)
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[column.offset]:ends[-1]].reshape(-1, width)


def _state(y: np.ndarray, w: np.ndarray, bins: pa.Array, raw: np.ndarray) -> pa.RecordBatch:
    """Rows at the start of a round."""
    g, h = (pa.array(c.astype(np.int64)) for c in _gradients(raw, y, w))
    return pa.RecordBatch.from_arrays([pa.array(y), pa.array(w), bins, pa.array(raw), g, h], names=["y", "w", "bins", "raw", "g", "h"])


def fit_distributed(binned: DataFrame, edges: list[np.ndarray], p: Params) -> tuple[list[Tree], float]:
    """One aggregate per level; ``binned``: y, w and bins, a byte per feature.
    Tasks sum their own rows, so at most a row per task, node, feature and bin
    is shuffled."""
    widths, features = [len(e) + 1 for e in edges], len(edges)
    bundles = _bundles(widths)
    table = staged(binned, "binned")
    one = table.agg(F.sum(F.col("w") * F.col("y")).alias("y"), F.sum("w").alias("w")).first()
    base = _base(one["y"] or 0.0, one["w"] or 0.0)

    def start(batches):
        for b in batches:
            raw = np.full(b.num_rows, base)
            yield _state(*map(np.asarray, b.columns[:2]), b.column(2), raw)

    def next_round(tree):
        def run(batches):
            for b in batches:
                if b.num_rows:
                    y, w, raw = (np.asarray(b.column(c)) for c in ("y", "w", "raw"))
                    bins = byte_rows(b.column("bins"), features)
                    yield _state(y, w, b.column("bins"), raw + np.array(tree.value)[_walk(tree, bins, tree.bin)])
        return run

    now, trees, kept = table.mapInArrow(start, STATE), [], table
    for done in range(p.rounds):
        if done % KEEP_ROUNDS == 0:
            now = staged(now, "boosting")
            drop_staged(kept)
            kept = now

        def histograms(tree, nodes, now=now):
            place = np.full(len(tree.feature), len(nodes))
            place[nodes] = np.arange(len(nodes))

            def partial(batches):
                total = np.zeros((len(nodes), features, max(widths), 3))
                for b in batches:
                    if not b.num_rows:
                        continue
                    bins = byte_rows(b.column(0), features)
                    at = place[_walk(tree, bins, tree.bin)]
                    g, h = (np.asarray(b.column(c)).astype(float) for c in (1, 2))
                    for i in range(len(nodes)):
                        mine = np.flatnonzero(at == i)
                        if len(mine):
                            total[i] += _sums(_cells(bins[mine], bundles, widths), g[mine], h[mine], bundles, widths)
                at = np.nonzero(total[..., 2])
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in at), *(pa.array(c.astype(np.int64)) for c in total[at].T)],
                                                 names=["node", "f", "b", "g", "h", "n"])

            parts = now.select("bins", "g", "h").mapInArrow(partial, "node int, f int, b int, g long, h long, n long")
            found = parts.groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toArrow()
            out = np.zeros((len(nodes), features, max(widths), 3))
            out[tuple(found.column(c).to_numpy() for c in range(3))] = np.stack([found.column(c).to_numpy() for c in range(3, 6)], axis=1)
            return out  # at most a row per node, feature and bin

        tree, _, _ = grow(histograms, edges, p)
        trees.append(tree)
        now = now.mapInArrow(next_round(tree), STATE)
    drop_staged(kept)
    return trees, base


def fit(prepared: DataFrame, names: list[str], label_col: str = "label", weight_col: str = "weight",
        params: Params | None = None, local_rows: int = LOCAL_ROWS, exact_edges: bool = False) -> HistogramBooster:
    """Boosting on the prepared feature columns (no nulls) of labelled rows.
    ``local_rows`` only chooses where the sums are formed.  Without rows, or
    with one class, the model scores its base rate."""
    worker_path(prepared.sparkSession)
    p = params or Params()
    rows = prepared.select(F.col(label_col).cast("double").alias("y"), F.col(weight_col).cast("double").alias("w"),
                           *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(names)])
    n = rows.count()
    if not n or not names:
        return HistogramBooster(list(names), [], 0.0)
    edges = bin_edges(rows, [f"f{i}" for i in range(len(names))], p.max_bins, exact_edges)

    def binning(batches):
        for b in batches:
            bins = to_bins(np.stack([np.asarray(c) for c in b.columns[2:]], axis=1), edges)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), byte_column(bins)], names=["y", "w", "bins"])

    binned = rows.mapInArrow(binning, "y double, w double, bins binary")
    if n > local_rows:
        trees, base = fit_distributed(binned, edges, p)
        return HistogramBooster(list(names), trees, base)

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if batches:
            y, w = (np.concatenate([np.asarray(b.column(c)) for b in batches]) for c in (0, 1))
            bins = np.concatenate([byte_rows(b.column(2), len(edges)) for b in batches])
            batches.clear()
            trees, base = fit_bins(bins, y, w, edges, p)
            yield pa.RecordBatch.from_arrays([pa.array([HistogramBooster(list(names), trees, base).to_json()])], names=["model"])

    one = binned.repartition(1).mapInArrow(run, "model string")  # at most local_rows rows
    return HistogramBooster.from_json(one.first()["model"])
