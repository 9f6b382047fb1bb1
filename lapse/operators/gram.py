"""Correlations of wide tables from masked Gram matrices (A13 beyond a few dozen columns).

With x the values (0 where missing) and m the mask of present values, matrix
products of a block of rows give, for every pair of columns over the rows where
both are present, the count, both means, both sums of squared deviations and the
sum of their products: six k x k matrices.  Two blocks' matrices are combined
element by element (Chan's formula), so nothing is lost to a large offset.  A
task combines those of its rows; the tasks' matrices are then combined row by
row in streaming tasks that hold sums only, and r is an expression over them.
Cost: one read, k^2 numbers a task, no expression per pair."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapse.spec import require_numeric

#: Rows per matrix product.
BLOCK = 8192
PARTS = ("n", "mx", "my", "vx", "vy", "c")
SCHEMA = "i int, " + ", ".join(f"{c} array<double>" for c in PARTS)


def _batch(i, matrices) -> pa.RecordBatch:
    """One row per column number in ``i``."""
    k = matrices[0].shape[1]
    offsets = pa.array(np.arange(0, len(i) * k + 1, k, dtype=np.int32)) if k else pa.array([0] * (len(i) + 1), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(m.ravel())) for m in matrices]
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), *lists], names=["i", *PARTS])


def _moments(x: np.ndarray) -> np.ndarray:
    """The six matrices of one block; NaN and infinities are missing."""
    present = np.isfinite(x)
    m = present.astype(float)
    shift = x[present.argmax(axis=0), np.arange(x.shape[1])]  # each column's first value
    shift = np.where(np.isfinite(shift), shift, 0.0)
    x = np.where(present, x - shift, 0.0)
    n, s, q = m.T @ m, x.T @ m, (x * x).T @ m
    some = np.maximum(n, 1)
    v = q - s * s / some
    v[v <= 1e-12 * q] = 0  # constant but for rounding
    mean = s / some
    return np.stack([n, mean + shift[:, None], mean.T + shift, v, v.T, x.T @ x - s * s.T / some])


def _combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The matrices (or rows of them) of two sets of rows together."""
    n = a[0] + b[0]
    share = b[0] / np.maximum(n, 1)
    dx, dy, f = b[1] - a[1], b[2] - a[2], a[0] * share
    return np.stack([n, np.where(a[0] > 0, a[1] + dx * share, b[1]), np.where(a[0] > 0, a[2] + dy * share, b[2]),
                     a[3] + b[3] + dx * dx * f, a[4] + b[4] + dy * dy * f, a[5] + b[5] + dx * dy * f])


def _partial(k: int):
    def run(batches):
        total = np.zeros((len(PARTS), k, k))
        for b in batches:
            lists = b.column(0)
            for at in range(0, len(lists), BLOCK):
                part = lists[at : at + BLOCK]
                x = part.flatten().to_numpy(zero_copy_only=False).astype(float)  # nulls come as NaN
                total = _combine(total, _moments(x.reshape(len(part), k)))
        yield _batch(np.arange(k), total)

    return run


def _added(batches):
    totals: dict[int, np.ndarray] = {}
    for b in batches:
        rows = [b.column(c + 1) for c in range(len(PARTS))]
        for r, i in enumerate(b.column(0).to_pylist()):
            row = np.stack([c[r].values.to_numpy() for c in rows])
            totals[i] = _combine(totals[i], row) if i in totals else row
    if totals:
        yield _batch(list(totals), np.stack(list(totals.values()), axis=1))


def _gram(values: DataFrame, k: int) -> DataFrame:
    """(i, one array over the columns per matrix) from one column of k-element
    arrays of doubles."""
    return values.mapInArrow(_partial(k), SCHEMA).repartition(F.col("i")).mapInArrow(_added, SCHEMA)


def _r() -> Column:
    def varies(v: str, mean: str) -> Column:
        return F.col(f"m.{v}") > F.col("m.n") * F.pow(F.lit(1e-13) * F.col(f"m.{mean}"), 2)

    both = (F.col("m.n") > 0) & varies("vx", "mx") & varies("vy", "my")
    return F.when(both, F.try_divide(F.col("m.c"), F.sqrt("m.vx") * F.sqrt("m.vy")))


def _long(gram: DataFrame, names: list[str], digits: int | None) -> DataFrame:
    label = F.array(*[F.lit(c) for c in names])
    pairs = gram.select("i", F.posexplode(F.arrays_zip(*PARTS)).alias("j", "m"))
    r = _r() if digits is None else F.round(_r(), digits)
    return pairs.select(F.get(label, F.col("i")).alias("col1"), F.get(label, F.col("j")).alias("col2"), r.alias("r"))


def wide_correlations(df: DataFrame, columns: list[str], digits: int | None = 4) -> DataFrame:
    """A13/C9 for many columns: (col1, col2, r) of every ordered pair, over the
    rows where both are present.  Null, NaN and infinite values are missing; r is
    null where a column is constant over them (up to rounding: deviations below
    1e-13 of the mean) or there are none.
    A table without partitions gives no rows, one without rows null r."""
    for c in columns:
        require_numeric(df, c)
    values = df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("v"))
    return _long(_gram(values, len(columns)), list(columns), digits)


def component_correlations(df: DataFrame, vector_col: str, size: int, digits: int | None = 4) -> DataFrame:
    """The same for the components of an array column, named by their position
    from 0.  Rows whose array is null or not of ``size`` elements take no part."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    values = df.where(F.size(vector_col) == size).select(v.alias("v"))
    return _long(_gram(values, size), [str(i) for i in range(size)], digits)
