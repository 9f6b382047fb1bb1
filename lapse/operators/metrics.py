"""Classifier metrics (M15-M21) computed exactly, at scale, from a table of
(label, score) rows.

All curve metrics start from the *per-score* table: one row per distinct
score with its positive and negative counts (a partial aggregate).  The
cumulative counts are then taken in two levels so that no window ever sees
an unbounded number of rows in one task:

1. distinct scores are cut into ``buckets`` equal-frequency ranges; the
   bucket totals (at most ``buckets`` rows) get a running sum in one small
   window;
2. inside each bucket, distinct scores get a running sum in a window
   partitioned by the bucket (spread evenly over all tasks).

ROC-AUC (ties count half), average precision (step sum), the ROC and PR
curves and the Youden threshold are exact sums over that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapse.staging import staged

#: None: sized from the number of distinct scores.
DEFAULT_BUCKETS = None


def _label(label: str | Column) -> Column:
    c = F.col(label) if isinstance(label, str) else label
    return F.when(c.cast("int") == 1, 1).otherwise(0)


def _bucket_splits(per: DataFrame, buckets: int | None) -> list[float]:
    """Equal-frequency bucket edges over the distinct scores (bounded list:
    at most ``buckets`` + 1 values reach the driver)."""
    if buckets is None:
        # about 100k distinct scores per bucket, 1k..1M buckets
        n = per.count()
        buckets = int(min(1_000_000, max(1000, n // 100_000)))
    qs = [i / buckets for i in range(1, buckets)]
    row = per.agg(F.percentile_approx("score", qs, max(10000, 10 * buckets)).alias("b")).first()
    inner = sorted(set(row["b"] or []))
    return [float("-inf"), *inner, float("inf")]


def score_table(df: DataFrame, label: str | Column = "label", score: str | Column = "score",
                buckets: int | None = DEFAULT_BUCKETS, group=()) -> DataFrame:
    """One row per distinct score: ``score, pos, neg, tp_above, fp_above,
    tp, fp, n_pos, n_neg`` where ``tp_above``/``fp_above`` count rows with a
    strictly higher score and ``tp``/``fp`` include this score.  ``group``
    evaluates many models or folds in one job (the per-group constants are
    one row per group).

    Buckets are equal-frequency over the distinct scores (edges from
    ``percentile_approx``, assigned by binary search in ``Bucketizer``), so a
    bunched score distribution still spreads over all buckets;
    ``buckets=None`` sizes them from the number of distinct scores.  Missing
    scores are left out; a NaN score is an error."""
    from pyspark.ml.feature import Bucketizer

    g = list(group)
    s = (F.col(score) if isinstance(score, str) else score).cast("double")
    s = F.when(F.isnan(s), F.raise_error(F.lit("a score is NaN"))).otherwise(s)
    # the only read of the scores; everything below comes from the staged table
    per = staged(
        df.select(*g, s.alias("score"), _label(label).alias("y"))
        .where(F.col("score").isNotNull())
        .groupBy(*g, "score")
        .agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")), "scores")
    splits = _bucket_splits(per, buckets)
    per = Bucketizer(splits=splits, inputCol="score", outputCol="_bk").transform(per).withColumn(
        "bucket", F.col("_bk").cast("int")).drop("_bk")
    totals = {"n_pos": F.sum("pos"), "n_neg": F.sum("neg")}
    if g:
        per = per.join(staged(per.groupBy(*g).agg(*[e.alias(n) for n, e in totals.items()]), "totals"), g)
    else:
        # scalar subqueries, merged into one aggregate by the optimizer
        per = per.select("*", *[per.agg(e).scalar().alias(n) for n, e in totals.items()])
    tot = per.groupBy(*g, "bucket").agg(F.sum("pos").alias("_bpos"), F.sum("neg").alias("_bneg"))
    # at most len(splits) rows per group: a bounded window, highest bucket first
    wb = Window.partitionBy(*g).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(
        *g, "bucket",
        F.coalesce(F.sum("_bpos").over(wb), F.lit(0)).alias("_pos_before"),
        F.coalesce(F.sum("_bneg").over(wb), F.lit(0)).alias("_neg_before"),
    )
    wi = Window.partitionBy(*g, "bucket").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    out = per.select(
        *g, "score", "pos", "neg", "bucket", "n_pos", "n_neg",
        F.coalesce(F.sum("pos").over(wi), F.lit(0)).alias("_pos_in"),
        F.coalesce(F.sum("neg").over(wi), F.lit(0)).alias("_neg_in"),
    ).join(tot, [*g, "bucket"])
    return out.select(
        *g, "score", "pos", "neg",
        (F.col("_pos_before") + F.col("_pos_in")).cast("long").alias("tp_above"),
        (F.col("_neg_before") + F.col("_neg_in")).cast("long").alias("fp_above"),
        (F.col("_pos_before") + F.col("_pos_in") + F.col("pos")).cast("long").alias("tp"),
        (F.col("_neg_before") + F.col("_neg_in") + F.col("neg")).cast("long").alias("fp"),
        F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg"),
    )


def roc_auc(df: DataFrame, label="label", score="score", digits: int | None = 6,
            buckets: int | None = DEFAULT_BUCKETS, group=()) -> DataFrame:
    """P(score_pos > score_neg) + P(tie) / 2.  NULL for a one-class set."""
    return auc_from_table(score_table(df, label, score, buckets, group), digits, group)


def auc_from_table(st: DataFrame, digits: int | None = 6, group=()) -> DataFrame:
    """M15 from a ``score_table`` (reuse one table for several metrics)."""
    auc = F.try_divide(
        F.sum(F.col("neg") * (F.col("tp_above") + F.lit(0.5) * F.col("pos"))),
        F.first("n_pos").cast("double") * F.first("n_neg"),
    )
    return st.groupBy(*group).agg((F.round(auc, digits) if digits is not None else auc).alias("roc_auc"))


def average_precision(df: DataFrame, label="label", score="score", digits: int | None = 6,
                      buckets: int | None = DEFAULT_BUCKETS, group=()) -> DataFrame:
    """Sum over thresholds of (recall step) x precision."""
    return ap_from_table(score_table(df, label, score, buckets, group), digits, group)


def ap_from_table(st: DataFrame, digits: int | None = 6, group=()) -> DataFrame:
    """M16 from a ``score_table``."""
    ap = F.sum(F.try_divide(F.col("pos").cast("double"), F.col("n_pos"))
               * F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")))
    return st.groupBy(*group).agg(
        (F.round(ap, digits) if digits is not None else ap).alias("average_precision"))


def roc_curve(df: DataFrame, label="label", score="score", digits: int = 6,
              buckets: int | None = DEFAULT_BUCKETS) -> DataFrame:
    """One point per distinct score: threshold, fpr, tpr, youden_j."""
    st = score_table(df, label, score, buckets)
    tpr = F.try_divide(F.col("tp").cast("double"), F.col("n_pos"))
    fpr = F.try_divide(F.col("fp").cast("double"), F.col("n_neg"))
    return st.select(
        F.col("score").alias("threshold"), F.round(fpr, digits).alias("fpr"),
        F.round(tpr, digits).alias("tpr"), F.round(tpr - fpr, digits).alias("youden_j"),
    )


def pr_curve(df: DataFrame, label="label", score="score", digits: int = 6,
             buckets: int | None = DEFAULT_BUCKETS) -> DataFrame:
    """Threshold, precision, recall per distinct score."""
    st = score_table(df, label, score, buckets)
    return st.select(
        F.col("score").alias("threshold"),
        F.round(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), digits).alias("precision"),
        F.round(F.try_divide(F.col("tp").cast("double"), F.col("n_pos")), digits).alias("recall"),
    )


def youden_threshold(df: DataFrame, label="label", score="score",
                     buckets: int | None = DEFAULT_BUCKETS) -> DataFrame:
    """The threshold maximising tpr - fpr; the highest one on ties.
    Ties are decided exactly on tp * n_neg - fp * n_pos (decimal, no
    floating-point noise).  Top-1 by TakeOrderedAndProject."""
    return youden_from_table(score_table(df, label, score, buckets))


def youden_from_table(st: DataFrame) -> DataFrame:
    """M19 from a ``score_table``."""
    j = (F.try_divide(F.col("tp").cast("double"), F.col("n_pos"))
         - F.try_divide(F.col("fp").cast("double"), F.col("n_neg")))
    d = "decimal(38,0)"
    exact = F.col("tp").cast(d) * F.col("n_neg").cast(d) - F.col("fp").cast(d) * F.col("n_pos").cast(d)
    return (st.select(F.col("score").alias("threshold"), j.alias("youden_j"), exact.alias("_j"))
            .orderBy(F.desc_nulls_last("_j"), F.desc("threshold")).limit(1).drop("_j"))


def threshold_metrics(df: DataFrame, label="label", score="score", threshold: float | Column = 0.5,
                      digits: int | None = 6, group=()) -> DataFrame:
    """Confusion counts at ``score >= threshold`` and precision,
    recall, F1 (0 where the denominator is 0)."""
    s = F.col(score) if isinstance(score, str) else score
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    y = _label(label)
    pred = F.coalesce(s >= t, F.lit(False))
    c = df.groupBy(*group).agg(
        F.count_if((y == 0) & ~pred).alias("tn"), F.count_if((y == 0) & pred).alias("fp"),
        F.count_if((y == 1) & ~pred).alias("fn"), F.count_if((y == 1) & pred).alias("tp"),
    )
    p = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(F.lit(2.0) * F.col("tp"), F.lit(2) * F.col("tp") + F.col("fp") + F.col("fn")),
                    F.lit(0.0))
    rd = (lambda e: F.round(e, digits)) if digits is not None else (lambda e: e)
    return c.select(*group, "tn", "fp", "fn", "tp", rd(p).alias("precision"), rd(r).alias("recall"),
                    rd(f1).alias("f1"))


def confusion_matrix(df: DataFrame, label="label", score="score", threshold: float = 0.5) -> DataFrame:
    """M18 long form: actual, predicted, count (all four cells)."""
    m = threshold_metrics(df, label, score, threshold)
    cells = [F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(n).alias("count"))
             for a, p, n in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))]
    return m.select(F.inline(F.array(*cells)))


def split_distribution(df: DataFrame, split_col: str = "split", label: str = "label") -> DataFrame:
    """Rows per (split, class)."""
    return df.groupBy(split_col, label).agg(F.count(F.lit(1)).alias("count"))
