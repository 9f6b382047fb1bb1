"""Chart-ready aggregates (C1-C11).  Rendering is left to the caller; each
function returns the small table a chart is drawn from.

Histograms take min/max as scalar subqueries (one aggregate, used as
literals), then count per (group, bin): partial aggregation keeps the
shuffle at (#groups x #bins) rows per task, whatever the input size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapse.functions.exprs import risk_level
from lapse.operators.aggregates import correlation_matrix, group_rate, tenure_trend
from lapse.operators.quantiles import DEFAULT_ACCURACY, exact_quantiles
from lapse.operators.ranking import top_n_records
from lapse.staging import staged
from lapse.spec import Spec, require_numeric


def outcome_distribution(df: DataFrame, spec: Spec) -> DataFrame:
    """Rows per outcome value (missing dropped)."""
    return (
        df.where(F.col(spec.target_col).isNotNull())
        .groupBy(spec.target_col)
        .agg(F.count(F.lit(1)).alias("count"))
    )


def histogram(df: DataFrame, column: str, group: Column | str | None = None,
              bins: int = 30, digits: int = 4, density: bool = False) -> DataFrame:
    """``bins`` equal-width bins between min and max (the last
    bin is closed), counted per group.  ``density`` divides by
    (rows in the group x bin width)."""
    require_numeric(df, column)
    g = F.col(group) if isinstance(group, str) else group
    x = F.col(column)
    base = df.select(x.cast("double").alias("_x"), *([g.alias("group")] if g is not None else []))
    base = base.where(F.col("_x").isNotNull())
    # range as scalar subqueries (merged into one aggregate by Catalyst)
    lo, hi = base.agg(F.min("_x")).scalar(), base.agg(F.max("_x")).scalar()
    width = (hi - lo) / F.lit(float(bins))
    b = F.least(
        F.coalesce(F.floor(F.try_divide(F.col("_x") - lo, width)), F.lit(0)),
        F.lit(bins - 1),
    ).cast("int")
    keys = (["group"] if g is not None else []) + ["bin"]
    counted = (
        base.select(*(["group"] if g is not None else []), b.alias("bin"),
                    lo.alias("_lo"), hi.alias("_hi"))
        .groupBy(*keys, "_lo", "_hi")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    w = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    cols = [*keys,
            F.round(F.col("_lo") + F.col("bin") * w, digits).alias("bin_start"),
            F.round(F.col("_lo") + (F.col("bin") + 1) * w, digits).alias("bin_end"),
            "count"]
    out = counted.select(*cols, w.alias("_w"))
    if density:
        if g is not None:
            totals = counted.groupBy("group").agg(F.sum("count").alias("_n"))
            out = out.join(totals, "group")  # both sides have at most groups x bins rows
        else:
            out = out.withColumn("_n", counted.agg(F.sum("count")).scalar())
        out = out.withColumn(
            "density", F.round(F.try_divide(F.col("count").cast("double"), F.col("_n") * F.col("_w")), 8)
        ).drop("_n")
    return out.drop("_w")


def distribution_by_outcome(df: DataFrame, spec: Spec, column: str, bins: int = 30) -> DataFrame:
    """Numeric column -> histogram per outcome; otherwise C2."""
    from lapse.spec import is_numeric

    if not is_numeric(df, column):
        return group_rate(df, spec, column)
    d = df.where(F.col(spec.target_col).isNotNull())
    return histogram(d, column, spec.target_col, bins)


def tenure_chart(df: DataFrame, spec: Spec) -> DataFrame:
    """C4: bucket counts and rates, labels with an 'm' suffix."""
    return tenure_trend(df, spec, with_charge=False, suffix="m")


def risk_distribution(scores: DataFrame, score_col: str = "risk_score", bins: int = 30) -> DataFrame:
    """Score histogram per risk tier."""
    return histogram(scores, score_col, risk_level(F.col(score_col)), bins)


def box_stats(df: DataFrame, spec: Spec, column: str, accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """Quartiles, 1.5 IQR fences, whiskers (the most extreme values
    inside the fences) and outlier count per outcome value.  The per-class
    stats are staged, so their join with the rows knows their size."""
    require_numeric(df, column)
    d = df.where(F.col(spec.target_col).isNotNull() & F.col(column).isNotNull()).select(
        spec.target_col, F.col(column).cast("double").alias("_x"))
    names = ("min", "q1", "median", "q3", "max")
    five = exact_quantiles(d, "_x", [0.0, 0.25, 0.5, 0.75, 1.0], [spec.target_col], accuracy)
    q = staged(five.select(spec.target_col, "n", *[F.col(f"q{i}").alias(c) for i, c in enumerate(names)])
               .withColumn("iqr", F.col("q3") - F.col("q1"))
               .withColumn("lower_fence", F.col("q1") - F.lit(1.5) * F.col("iqr"))
               .withColumn("upper_fence", F.col("q3") + F.lit(1.5) * F.col("iqr")), "box")
    inside = (F.col("_x") >= F.col("lower_fence")) & (F.col("_x") <= F.col("upper_fence"))
    wh = d.join(q.select(spec.target_col, "lower_fence", "upper_fence"), spec.target_col).groupBy(
        spec.target_col).agg(
        F.min(F.when(inside, F.col("_x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_x"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    )
    out = q.join(wh, spec.target_col)
    r = [F.round(c, 4).alias(c) for c in ("min", "q1", "median", "q3", "max", "iqr", "lower_fence",
                                            "upper_fence", "whisker_low", "whisker_high")]
    return out.select(spec.target_col, "n", *r, "n_outliers")


def top_risk_chart(scores: DataFrame, spec: Spec, n: int = 15, score_col: str = "risk_score") -> DataFrame:
    """Top n scores (default 15, not capped)."""
    return top_n_records(scores, score_col, n, columns=[spec.id_col, score_col], tie_break=spec.id_col)


def feature_importance_chart(importance: DataFrame, n: int = 15) -> DataFrame:
    """The n largest importances."""
    return top_n_records(importance, "importance", n, tie_break="feature")


def correlation_heatmap(df: DataFrame, spec: Spec, digits: int | None = None) -> DataFrame:
    """The correlation matrix, unrounded unless ``digits`` is given."""
    return correlation_matrix(df, spec=spec, digits=digits)


def risk_gauge(scores: DataFrame, spec: Spec, score_col: str = "risk_score") -> DataFrame:
    """Score in percent and the colour band (0.4 / 0.7 cut points)."""
    s = F.col(score_col)
    band = F.when(s >= 0.7, "red").when(s >= 0.4, "amber").otherwise("green")
    return scores.select(spec.id_col, F.round(s * 100, 2).alias("gauge_value"), band.alias("band"))


def density_by_outcome(df: DataFrame, spec: Spec, column: str, bins: int = 25) -> DataFrame:
    """C11: per-class density histogram (shared bin edges)."""
    d = df.where(F.col(spec.target_col).isNotNull())
    return histogram(d, column, spec.target_col, bins, density=True)


