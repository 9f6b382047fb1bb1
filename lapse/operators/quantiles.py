"""Exact interpolated quantiles with bounded memory per task.

``percentile`` keeps a value -> count map of every distinct value of a
group in one aggregation buffer: fine for money and small integers, a
problem for a continuous column over billions of rows.  Here the exact
answer comes from distributed steps instead:

1. per group, ``percentile_approx`` at p -+ 3/accuracy brackets the two
   ranks the interpolation needs (its rank error is at most n/accuracy;
   groups of at most ``accuracy`` rows are taken whole);
2. while a bracket may hold more than ``ranked`` rows, a round of narrowing
   counts what is below it and inside it, lays a grid of ``CELLS`` steps over
   the values inside, and keeps the few cells around the two ranks;
3. in one aggregate, rows below the bracket are only counted and rows
   inside it are counted per distinct value; a running count over those, per
   group, finds the values at ranks floor(p (n-1)) and ceil(p (n-1)),
   interpolated the way ``percentile`` does.

The result equals ``percentile`` bit for bit, for any number of probabilities
and groups.  It takes two reads of the source up to accuracy * ranked / 6 rows
a group and one more for each further factor of about 13, and no task ranks
more than ``ranked`` distinct values, however many rows there are.  Missing
group keys are a group of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapse.staging import staged

DEFAULT_ACCURACY = 100000
#: Most distinct values that one task ranks.
MAX_RANKED = 1 << 20
#: Grid steps of a round, and the accuracy of their edges (an error of 1/64 step).
CELLS, EDGE_ACCURACY = 64, 4096
#: Cells that a round keeps: those of the two ranks, one more on each side, and the errors of the edges.
KEPT_CELLS = 5


def _bracketed(base: DataFrame, state: DataFrame, g: list[str]) -> DataFrame:
    """``base`` with n and the brackets _b of its group."""
    if not g:
        row = state.first()
        bracket = F.array(*map(F.lit, row["_b"])) if row["_b"] else F.lit(None).cast("array<double>")
        return base.select("*", F.lit(row["n"]).alias("n"), bracket.alias("_b"))
    # broadcast if it is small; beyond that both sides are dealt out by the
    # join itself, so a group holding a third of all rows can be split
    keys = [f"_g{i}" for i in range(len(g))]
    named = state.select(*[F.col(c).alias(k) for c, k in zip(g, keys, strict=True)], "n", "_b")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(g, keys, strict=True)])
    return base.join(named, same).drop(*keys)


def _per_probability(rows: DataFrame, g: list[str], k: int) -> DataFrame:
    """One row per row and probability: (g, n, i, _x, lo, hi)."""
    bounds = [F.struct(F.lit(i).alias("i"), F.col("_b")[2 * i].alias("lo"), F.col("_b")[2 * i + 1].alias("hi")) for i in range(k)]
    return rows.select(*g, "n", "_x", F.inline(F.array(*bounds)))


def _position(probs: list[float]) -> Column:
    """Where, among the n ordered values, the quantile of probability i lies (from 0)."""
    return F.element_at(F.array(*map(F.lit, probs)), F.col("i") + 1) * (F.col("n") - 1)


def _narrowed(base: DataFrame, state: DataFrame, g: list[str], probs: list[float]) -> tuple[DataFrame, int]:
    """The brackets after one round, and the most rows that lay strictly between two bounds before it."""
    rows = _per_probability(_bracketed(base, state, g), g, len(probs))
    below = F.coalesce(F.col("_x") < F.col("lo"), F.lit(False))
    inside = ~below & F.coalesce(F.col("_x") <= F.col("hi"), F.lit(True))
    between = inside & F.coalesce((F.col("_x") > F.col("lo")) & (F.col("_x") < F.col("hi")), F.lit(False))
    grid = [j / CELLS for j in range(CELLS + 1)]
    cells = staged(rows.groupBy(*g, "n", "i", "lo", "hi").agg(
        F.count_if(below).alias("below"), F.count_if(inside).alias("inside"), F.count_if(between).alias("between"),
        F.percentile_approx(F.when(inside, F.col("_x")), grid, EDGE_ACCURACY).alias("edges")), "cells")
    pos = _position(probs)
    first = F.floor((F.floor(pos) - F.col("below")) * CELLS / F.col("inside")).cast("int") - 1
    last = F.ceil((F.ceil(pos) - F.col("below") + 1) * CELLS / F.col("inside")).cast("int") + 1
    lo = F.when(F.col("lo").isNull() | (first < 0), F.col("lo")).otherwise(F.get("edges", first))
    hi = F.when(F.col("hi").isNull() | (last > CELLS), F.col("hi")).otherwise(F.get("edges", last))
    found = F.array_sort(F.collect_list(F.struct("i", lo.alias("lo"), hi.alias("hi"))))  # one entry per probability
    out = cells.groupBy(*g, "n").agg(F.flatten(F.transform(found, lambda s: F.array(s["lo"], s["hi"]))).alias("_b"))
    return staged(out, "brackets"), cells.agg(F.max("between")).first()[0] or 0


def exact_quantiles(df: DataFrame, column: str, probs, group=(), accuracy: int = DEFAULT_ACCURACY,
                    ranked: int = MAX_RANKED) -> DataFrame:
    """One row per group: ``group..., n, q0, q1, ...`` (q_i for probs[i]).

    A group without a value has no row; without groups there is one row always."""
    g = list(group)
    probs = [float(p) for p in probs]
    if ranked < 1024:
        raise ValueError("ranked must be at least 1024: a narrower bracket would be finer than its grid")
    margin = 3.0 / accuracy
    base = df.select(*g, F.col(column).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    qs = [q for p in probs for q in (max(0.0, p - margin), min(1.0, p + margin))]
    # The sketch brackets ranks q*n -+ n/accuracy; the interpolation needs
    # floor/ceil of p*(n-1), up to two ranks away, which the margin covers
    # once n > accuracy.  Smaller groups are ranked whole (<= accuracy rows).
    whole = F.array(*[F.lit(None).cast("double")] * len(qs))
    stats = base.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_x", qs, accuracy).alias("_b"))
    stats = stats.select(*g, "n", F.when(F.col("n") > accuracy, F.col("_b")).otherwise(whole).alias("_b"))
    state = staged(stats, "brackets")  # one small row per group; its size is known from here on
    left = (state.agg(F.max("n")).first()[0] or 0) * 2 * margin
    while left > ranked:
        state, between = _narrowed(base, state, g, probs)
        left = between * KEPT_CELLS / CELLS
    # Every row below a bracket goes to one null value, rows inside keep theirs, rows above go.
    rows = _per_probability(_bracketed(base, state, g), g, len(probs))
    rows = rows.where(F.col("hi").isNull() | (F.col("_x") <= F.col("hi"))).select(
        *g, "n", "i", F.when(F.col("lo").isNull() | (F.col("_x") >= F.col("lo")), F.col("_x")).alias("v"))
    counted = rows.groupBy(*g, "n", "i", "v").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*g, "n", "i").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    places = counted.withColumn("_first", F.coalesce(F.sum("_c").over(w), F.lit(0))).where(F.col("v").isNotNull())

    pos = _position(probs)
    lower, higher = F.floor(pos), F.ceil(pos)

    def value(rank: Column) -> Column:
        return F.min(F.when((F.col("_first") <= rank) & (rank < F.col("_first") + F.col("_c")), F.col("v")))

    # dealt out as the window is; what follows handles one row per group and probability
    picked = places.groupBy(*g, "n", "i").agg(value(lower).alias("_l"), value(higher).alias("_h"))
    q = F.when(lower == higher, F.col("_l")).otherwise((higher - pos) * F.col("_l") + (pos - lower) * F.col("_h"))
    found = F.map_from_entries(F.collect_list(F.struct("i", q.alias("q")))).alias("_q")
    out = [F.col("_q")[i].alias(f"q{i}") for i in range(len(probs))]
    if g:
        return picked.groupBy(*g, "n").agg(found).select(*g, "n", *out)
    # one row even when every value is missing (quantiles NULL)
    return picked.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), found).select("n", *out)


def stacked_quantiles(df: DataFrame, columns, probs, accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """Quantiles of several columns in the same reads: one row per column
    with a value, ``feature, n, q0, q1, ...``."""
    rows = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])))
    return exact_quantiles(rows, "x", probs, ["feature"], accuracy)
