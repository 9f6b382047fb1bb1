"""Registered queries: feature preparation (M1-M9) and metrics.

Metrics run on whole tables with a score column taken from the data:
lineitem (label: returned, score: discount -- eleven distinct values, so
ties everywhere) and orders (label: status F, score: scaled total price).
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lapse.operators import features as M
from lapse.operators import metrics as X
from lapse.plans.registry import query
from lapse.plans.sqlframes import with_frames
from lapse.sources.frames import PROFILE_SPEC, customer_profile
from lapse.sources.tables import read_table

PS = PROFILE_SPEC


def _li_scored(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return li.select(F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
                     F.col("l_discount").alias("score"))


def _orders_scored(spark, sf):
    o = read_table(spark, sf, "orders")
    return o.select(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"),
                    (F.col("o_totalprice") / 600000.0).alias("score"))


_LI = "li AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_discount AS score FROM lineitem)"
_OR = ("li AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, "
       "o_totalprice / 600000.0 AS score FROM orders)")

_PER = """per AS (SELECT score, sum(label) AS pos, count(*) - sum(label) AS neg FROM li
        WHERE score IS NOT NULL GROUP BY score),
cum AS (SELECT *, coalesce(sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                  AS tp_above,
               sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
               sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
               sum(pos) OVER () AS n_pos, sum(neg) OVER () AS n_neg FROM per)"""


def _auc_sql(src):
    return with_frames("""
SELECT round(sum(neg * (tp_above + 0.5 * pos)) / (CAST(max(n_pos) AS DOUBLE) * max(n_neg)), 6) AS roc_auc
FROM cum""", src + ",\n" + _PER)


@query("roc_auc_lineitem_ties", "M15", sql=_auc_sql(_LI))
def roc_auc_lineitem(spark, sf):
    return X.roc_auc(_li_scored(spark, sf))


@query("roc_auc_orders", "M15", sql=_auc_sql(_OR))
def roc_auc_orders(spark, sf):
    return X.roc_auc(_orders_scored(spark, sf))


@query("average_precision_lineitem", "M16", sql=with_frames("""
SELECT round(sum((CAST(pos AS DOUBLE) / n_pos) * (CAST(tp AS DOUBLE) / (tp + fp))), 6) AS average_precision
FROM cum""", _LI + ",\n" + _PER))
def average_precision_lineitem(spark, sf):
    return X.average_precision(_li_scored(spark, sf))


@query("threshold_metrics_lineitem", "M17 M18", sql="""
WITH li AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_discount AS score FROM lineitem),
c AS (SELECT CAST(count_if(label = 0 AND NOT coalesce(score >= 0.05, false)) AS BIGINT) AS tn,
             CAST(count_if(label = 0 AND coalesce(score >= 0.05, false)) AS BIGINT) AS fp,
             CAST(count_if(label = 1 AND NOT coalesce(score >= 0.05, false)) AS BIGINT) AS fn,
             CAST(count_if(label = 1 AND coalesce(score >= 0.05, false)) AS BIGINT) AS tp FROM li)
SELECT tn, fp, fn, tp,
       round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0), 6) AS precision,
       round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0), 6) AS recall,
       round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1
FROM c""")
def threshold_metrics_lineitem(spark, sf):
    return X.threshold_metrics(_li_scored(spark, sf), threshold=0.05)


@query("confusion_matrix_orders", "M18", sql="""
WITH li AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
                   o_totalprice / 600000.0 AS score FROM orders),
c AS (SELECT CAST(count_if(label = 0 AND NOT coalesce(score >= 0.25, false)) AS BIGINT) AS tn,
             CAST(count_if(label = 0 AND coalesce(score >= 0.25, false)) AS BIGINT) AS fp,
             CAST(count_if(label = 1 AND NOT coalesce(score >= 0.25, false)) AS BIGINT) AS fn,
             CAST(count_if(label = 1 AND coalesce(score >= 0.25, false)) AS BIGINT) AS tp FROM li)
SELECT 0 AS actual, 0 AS predicted, tn AS count FROM c UNION ALL SELECT 0, 1, fp FROM c
UNION ALL SELECT 1, 0, fn FROM c UNION ALL SELECT 1, 1, tp FROM c""")
def confusion_matrix_orders(spark, sf):
    return X.confusion_matrix(_orders_scored(spark, sf), threshold=0.25)


@query("roc_curve_lineitem", "M19", sql=with_frames("""
SELECT score AS threshold, round(CAST(fp AS DOUBLE) / n_neg, 6) AS fpr, round(CAST(tp AS DOUBLE) / n_pos, 6) AS tpr,
       round(CAST(tp AS DOUBLE) / n_pos - CAST(fp AS DOUBLE) / n_neg, 6) AS youden_j FROM cum""", _LI + ",\n" + _PER))
def roc_curve_lineitem(spark, sf):
    return X.roc_curve(_li_scored(spark, sf))


@query("youden_threshold_orders", "M19", sql=with_frames("""
SELECT score AS threshold, CAST(tp AS DOUBLE) / n_pos - CAST(fp AS DOUBLE) / n_neg AS youden_j FROM cum
ORDER BY CAST(tp AS HUGEINT) * n_neg - CAST(fp AS HUGEINT) * n_pos DESC, score DESC LIMIT 1""", _OR + ",\n" + _PER))
def youden_threshold_orders(spark, sf):
    return X.youden_threshold(_orders_scored(spark, sf)).select(
        "threshold", "youden_j")


@query("pr_curve_lineitem", "M20", sql=with_frames("""
SELECT score AS threshold, round(CAST(tp AS DOUBLE) / (tp + fp), 6) AS precision,
       round(CAST(tp AS DOUBLE) / n_pos, 6) AS recall FROM cum""", _LI + ",\n" + _PER))
def pr_curve_lineitem(spark, sf):
    return X.pr_curve(_li_scored(spark, sf))


# ---------------------------------------------------------------- features

@query("split_class_distribution", "M7 M8 M21", sql=with_frames("""
SELECT 'test' AS split, label, NULL::INTEGER AS fold, k AS count FROM k WHERE k > 0
UNION ALL
SELECT 'train', label, CAST(r % 5 AS INTEGER), count(*) FROM r GROUP BY label, r % 5""",
    """c AS (SELECT CASE WHEN churn = 'Yes' THEN 1 ELSE 0 END AS label, count(*) AS n
           FROM customer_profile GROUP BY 1),
k AS (SELECT label, n, CAST(round(n * 0.2) AS BIGINT) AS k FROM c),
r AS (SELECT label, unnest(range(0, n - k)) AS r FROM k)"""))
def split_class_distribution(spark, sf):
    s = M.assign_split(customer_profile(spark, sf), PS)
    return s.groupBy("split", "label", "fold").agg(F.count(F.lit(1)).alias("count"))


@query("class_weights", "M9", sql=with_frames("""
SELECT CASE WHEN churn = 'Yes' THEN 1 ELSE 0 END AS label, count(*) AS n_rows,
       round((SELECT count(*) FROM customer_profile) / (2.0 * count(*)), 8) AS weight
FROM customer_profile GROUP BY 1"""))
def class_weights(spark, sf):
    w = M.class_weights(customer_profile(spark, sf), PS)
    return w.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.first("weight"), 8).alias("weight"))


def _prepared_sql():
    num = list(PS.numeric)
    cat = list(PS.categorical)
    med = ", ".join(f"coalesce(quantile_cont({c}, 0.5), 0.0) AS med_{c}" for c in num)
    stats = ", ".join(
        f"avg(coalesce(CAST({c} AS DOUBLE), med_{c})) AS mean_{c}, "
        f"coalesce(nullif(stddev_pop(coalesce(CAST({c} AS DOUBLE), med_{c})), 0), 1.0) AS std_{c}"
        for c in num)
    cats = "\nUNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM customer_profile "
        f"WHERE {c} IS NOT NULL GROUP BY 2" for c in cat)
    ctes = f"""med AS (SELECT {med} FROM customer_profile),
st AS (SELECT {stats} FROM customer_profile, med),
cc AS ({cats}),
idx AS (SELECT feature, value, CAST(dense_rank() OVER (PARTITION BY feature ORDER BY value) - 1 AS DOUBLE) AS i
        FROM cc),
mode AS (SELECT feature, value FROM cc QUALIFY row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) = 1)"""
    sel = [f"round((coalesce(CAST(p.{c} AS DOUBLE), med_{c}) - mean_{c}) / std_{c}, 6) AS {c}" for c in num]
    joins = []
    for j, c in enumerate(cat):
        sel.append(f"coalesce(i{j}.i, -1.0) AS {c}")
        joins.append(
            f"LEFT JOIN idx i{j} ON i{j}.feature = '{c}' AND i{j}.value = "
            f"coalesce(CAST(p.{c} AS VARCHAR), (SELECT value FROM mode WHERE feature = '{c}'))")
    body = (f"SELECT p.customer_id, {', '.join(sel)}\nFROM customer_profile p CROSS JOIN med CROSS JOIN st\n"
            + "\n".join(joins))
    return with_frames(body, ctes)


@query("prepared_features", "M1 M2 M3 M4 M5 M6", sql=_prepared_sql())
def prepared_features(spark, sf):
    cp = customer_profile(spark, sf)
    model = M.fit_features(cp, PS)
    x = M.transform_features(M.project_features(cp, PS), model, keep=[PS.id_col], digits=6).select(
        PS.id_col, vector_to_array("features").alias("x"))
    return x.select(PS.id_col, *[F.col("x")[i].alias(c) for i, c in enumerate(model.names)])


@query("feature_defaults", "R6", sql=with_frames("""
SELECT feature, numeric_default, categorical_default FROM (
  SELECT 'tenure' AS feature, CAST(quantile_cont(tenure, 0.5) AS DOUBLE) AS numeric_default,
         NULL::VARCHAR AS categorical_default FROM customer_profile
  UNION ALL SELECT 'monthly_charges', quantile_cont(monthly_charges, 0.5), NULL FROM customer_profile
  UNION ALL SELECT 'total_charges', quantile_cont(total_charges, 0.5), NULL FROM customer_profile
  UNION ALL SELECT 'acctbal', quantile_cont(acctbal, 0.5), NULL FROM customer_profile
  UNION ALL SELECT feature, NULL, value FROM cc
            QUALIFY row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) = 1)""",
    "cc AS (" + "\nUNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM customer_profile "
        f"WHERE {c} IS NOT NULL GROUP BY 2" for c in PS.categorical) + ")"))
def feature_defaults(spark, sf):
    return M.feature_defaults(customer_profile(spark, sf), PS)
