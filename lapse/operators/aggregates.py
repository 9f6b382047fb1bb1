"""Scalar and grouped aggregates.

Every operator is one logical plan: partial aggregation on the map side,
one shuffle on the group key, nothing collected.  Percentages of "all rows"
divide by a scalar subquery (the total, computed once) instead of a global
window (a window without PARTITION BY runs in one task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.functions.exprs import compare, pct, pearson
from lapse.operators.quantiles import DEFAULT_ACCURACY, exact_quantiles
from lapse.spec import Spec, SpecError, is_numeric, require_columns, require_numeric

AGG_FUNCS = ("mean", "median", "sum", "count", "min", "max", "std")


def _quantile(col: str, q, accuracy: int = 10000):
    """Sketch of a quantile (rank error at most n / accuracy)."""
    return F.percentile_approx(F.col(col), q, accuracy)


def get_average(df: DataFrame, column: str) -> DataFrame:
    require_numeric(df, column)
    return df.agg(
        F.lit(column).alias("column"),
        F.round(F.avg(column), 4).alias("mean"),
        F.count(column).alias("n"),
    )


def get_median(df: DataFrame, column: str, exact: bool = True,
               accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """A2: exact, with memory bounded per task (see ``quantiles``), or the sketch."""
    require_numeric(df, column)
    if exact:
        q = exact_quantiles(df, column, [0.5], accuracy=accuracy)
        return q.select(F.lit(column).alias("column"), F.round("q0", 4).alias("median"))
    return df.agg(F.lit(column).alias("column"), F.round(_quantile(column, 0.5), 4).alias("median"))


def describe_numeric(df: DataFrame, column: str, exact: bool = True,
                     accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """A3: count, mean, sample std, min, quartiles, max; the quartiles exact
    with bounded memory per task, or from the sketch."""
    require_numeric(df, column)
    if exact:
        eq = exact_quantiles(df, column, [0.25, 0.5, 0.75], accuracy=accuracy)
        q = F.array(*[eq.select(f"q{i}").scalar() for i in range(3)])
    else:
        q = _quantile(column, [0.25, 0.5, 0.75])
    out = df.agg(
        F.count(column).alias("count"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        F.min(column).cast("double").alias("min"),
        q.alias("q"),
        F.max(column).cast("double").alias("max"),
    )
    return out.select(
        F.lit(column).alias("column"),
        "count",
        *[F.round(c, 4).alias(c) for c in ("mean", "std", "min")],
        F.round(F.col("q")[0], 4).alias("q25"),
        F.round(F.col("q")[1], 4).alias("median"),
        F.round(F.col("q")[2], 4).alias("q75"),
        F.round("max", 4).alias("max"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """A4/A5: count and share of every value, missing kept as a value,
    share of all rows, count descending."""
    require_columns(df, [column])
    counts = df.groupBy(F.col(column).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("count")
    )
    total = df.agg(F.count(F.lit(1))).scalar()
    return (
        counts.select(F.lit(column).alias("column"), "value", "count",
                      pct(F.col("count"), total).alias("pct"))
        .orderBy(F.desc("count"), F.asc_nulls_last("value"))
    )


def get_distribution(df: DataFrame, column: str, exact: bool = True) -> DataFrame:
    if is_numeric(df, column):
        return describe_numeric(df, column, exact)
    return value_counts(df, column)


def group_rate(df: DataFrame, spec: Spec, column: str) -> DataFrame:
    """Outcome rate and row count per value of ``column`` in one
    aggregate.  Missing keys dropped; a missing outcome counts as 'not'."""
    require_columns(df, [column, spec.target_col])
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(
            F.sum(spec.positive_flag()).alias("_pos"),
            F.count(F.lit(1)).alias("count"),
        )
        .select(column, pct(F.col("_pos"), F.col("count")).alias("rate_pct"), "count")
        .orderBy(F.desc("rate_pct"), F.asc(column))
    )


def _agg_expr(func: str, col: str):
    c = F.col(col)
    if func == "mean":
        return F.avg(c)
    if func == "median":
        return _quantile(col, 0.5)
    if func == "sum":
        return F.coalesce(F.sum(c), F.lit(0)).cast("double")  # pandas: sum of nothing is 0
    if func == "count":
        return F.count(c)
    if func == "min":
        return F.min(c).cast("double")
    if func == "max":
        return F.max(c).cast("double")
    if func == "std":
        return F.stddev_samp(c)  # NULL for a one-row group
    raise SpecError(f"no such aggregate; choose from {AGG_FUNCS}")


def group_aggregate(df: DataFrame, group_col: str, agg_col: str, agg_func: str = "mean",
                    filter_col: str | None = None, filter_val=None,
                    require_match: bool = True, exact: bool = True,
                    accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """One aggregate per group, optional equality filter, 4 dp,
    value descending.  Output column ``{agg_func}_{agg_col}``.  A filter
    that matches nothing raises (checked with a one-row probe job)."""
    require_columns(df, [group_col, agg_col, filter_col])
    if agg_func not in AGG_FUNCS:
        raise SpecError(f"no such aggregate; choose from {AGG_FUNCS}")
    if agg_func != "count" and not is_numeric(df, agg_col):
        raise SpecError(f"{agg_func} needs numbers, and {agg_col} has none")
    if filter_col and filter_val is not None:
        df = df.where(compare(df, filter_col, filter_val, "eq"))  # a value of the wrong type is refused here
        if require_match and df.isEmpty():
            raise SpecError(f"{filter_col} is {filter_val!r} in no row")
    name = f"{agg_func}_{agg_col}"
    if agg_func == "median" and exact:
        keyed = df.where(F.col(group_col).isNotNull())
        q = exact_quantiles(keyed.select(group_col, F.col(agg_col).alias("_m")), "_m", [0.5], [group_col],
                            accuracy).select(group_col, F.round("q0", 4).alias(name))
        groups = keyed.select(group_col).distinct()  # all-missing groups keep a NULL median
        return groups.join(q, group_col, "left").orderBy(F.desc_nulls_last(name), F.asc(group_col))
    val = _agg_expr(agg_func, agg_col)
    if agg_func != "count":
        val = F.round(val, 4)
    # grouping by the value column itself is allowed (the reference errors)
    key = F.col(group_col).alias(group_col)
    return (
        df.where(F.col(group_col).isNotNull())
        .groupBy(key)
        .agg(val.alias(name))
        .orderBy(F.desc_nulls_last(name), F.asc(group_col))
    )


def segment_comparison(df: DataFrame, segment_col: str, metric_col: str,
                       metric_func: str = "mean") -> DataFrame:
    return group_aggregate(df, segment_col, metric_col, metric_func)


def average_by_target(df: DataFrame, spec: Spec, column: str) -> DataFrame:
    """Mean of ``column`` per outcome value (missing outcome dropped)."""
    require_numeric(df, column)
    return (
        df.where(F.col(spec.target_col).isNotNull())
        .groupBy(spec.target_col)
        .agg(F.round(F.avg(column), 4).alias(f"mean_{column}"))
    )


def tenure_bucket(spec: Spec, suffix: str = ""):
    """Bucket label and index: [b0, b1], (b1, b2], ...; NULL outside."""
    b = spec.tenure_bounds
    t = F.col(spec.tenure_col)
    label = idx = None
    for i in range(len(b) - 1):
        lo, hi = b[i], b[i + 1]
        cond = (t >= lo) & (t <= hi) if i == 0 else (t > lo) & (t <= hi)
        text = f"{lo if i == 0 else lo + 1}-{hi}{suffix}"
        label = F.when(cond, text) if label is None else label.when(cond, text)
        idx = F.when(cond, i) if idx is None else idx.when(cond, i)
    return label, idx


def tenure_trend(df: DataFrame, spec: Spec, with_charge: bool = True, suffix: str = "") -> DataFrame:
    """A10/C4: count, outcome rate and mean charge per tenure bucket;
    rows outside the bounds are dropped, empty buckets omitted."""
    require_columns(df, [spec.tenure_col, spec.target_col, spec.charge_col if with_charge else None])
    label, idx = tenure_bucket(spec, suffix)
    aggs = [
        F.count(F.lit(1)).alias("count"),
        F.sum(spec.positive_flag()).alias("_pos"),
    ]
    if with_charge:
        aggs.append(F.round(F.avg(spec.charge_col), 2).alias("mean_charge"))
    out = (
        df.select(label.alias("tenure_bucket"), idx.alias("bucket_index"),
                  spec.target_col, *([spec.charge_col] if with_charge else []))
        .where(F.col("bucket_index").isNotNull())
        .groupBy("bucket_index", "tenure_bucket")
        .agg(*aggs)
    )
    cols = ["bucket_index", "tenure_bucket", "count",
            pct(F.col("_pos"), F.col("count")).alias("rate_pct")]
    if with_charge:
        cols.append("mean_charge")
    return out.select(*cols).orderBy("bucket_index")


def filter_and_count(df: DataFrame, column: str, value, operator: str = "eq",
                     literal: bool = False) -> DataFrame:
    """Rows matching one predicate, all rows, and the share."""
    pred = compare(df, column, value, operator, literal)
    return df.agg(
        F.count_if(pred).alias("count"), F.count(F.lit(1)).alias("total")
    ).select(
        F.lit(column).alias("column"),
        F.lit(str(value)).alias("value"),
        F.lit(operator).alias("operator"),
        "count",
        "total",
        pct(F.col("count"), F.col("total")).alias("pct"),
    )


def correlation_pair(df: DataFrame, col1: str, col2: str, digits: int | None = 4) -> DataFrame:
    """Pearson r of two numeric columns, pairwise complete."""
    require_numeric(df, col1)
    require_numeric(df, col2)
    r = pearson(col1, col2)
    if digits is not None:
        r = F.round(r, digits)
    return df.agg(F.lit(col1).alias("col1"), F.lit(col2).alias("col2"), r.alias("pearson_r"))


def correlation_matrix(df: DataFrame, columns=None, spec: Spec | None = None,
                       digits: int | None = 4) -> DataFrame:
    """Every ordered pair of numeric columns in one pass (k(k+1)/2
    aggregate expressions), returned long-form (col1, col2, r)."""
    if spec is not None:
        df = spec.with_label(df)
    if columns is None:
        columns = [c for c in (list(spec.numeric) + [spec.label_col]) if c in df.columns] if spec else []
        if not columns:
            columns = [f.name for f in df.schema.fields if is_numeric(df, f.name)]
    for c in columns:
        require_numeric(df, c)
    aggs, pairs = [], []
    for i, a in enumerate(columns):
        for b in columns[i:]:
            name = f"_r{len(aggs)}"
            aggs.append(pearson(a, b).alias(name))
            pairs.append((a, b, name))
    wide = df.agg(*aggs)
    rows = []
    for a, b, name in pairs:
        val = F.col(name) if digits is None else F.round(F.col(name), digits)
        rows.append(F.struct(F.lit(a).alias("col1"), F.lit(b).alias("col2"), val.alias("r")))
        if a != b:
            rows.append(F.struct(F.lit(b).alias("col1"), F.lit(a).alias("col2"), val.alias("r")))
    return wide.select(F.inline(F.array(*rows)))


def correlation_with_target(df: DataFrame, spec: Spec, digits: int = 4) -> DataFrame:
    """R of every numeric feature with the binary outcome, r desc."""
    m = correlation_matrix(df, spec=spec, digits=digits)
    return (
        m.where((F.col("col1") == spec.label_col) & (F.col("col2") != spec.label_col))
        .select(F.col("col2").alias("feature"), F.col("r"))
        .orderBy(F.desc_nulls_last("r"), "feature")
    )


def class_imbalance(df: DataFrame, spec: Spec) -> DataFrame:
    """n_negative / n_positive."""
    out = df.agg(
        F.sum(F.when(spec.positive_flag() == 0, 1).otherwise(0)).alias("n_negative"),
        F.sum(spec.positive_flag()).alias("n_positive"),
    )
    return out.select(
        F.coalesce("n_negative", F.lit(0)).cast("long").alias("n_negative"),
        F.coalesce("n_positive", F.lit(0)).cast("long").alias("n_positive"),
        F.round(F.try_divide(F.col("n_negative").cast("double"), F.col("n_positive")), 4).alias("imbalance_ratio"),
    )


def zero_tenure(df: DataFrame, spec: Spec, extra=()) -> DataFrame:
    """Rows with tenure 0 (where blank totals were imputed)."""
    cols = [spec.id_col, spec.tenure_col, *extra, spec.target_col]
    require_columns(df, cols)
    return df.where(F.col(spec.tenure_col) == 0).select(*cols)
