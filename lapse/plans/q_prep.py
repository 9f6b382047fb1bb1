"""Registered queries: cleaning (S) and chart data (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapse.operators import chartdata as C
from lapse.operators import cleaning as S
from lapse.plans.q_analytics import pearson_sql
from lapse.plans.registry import REGISTRY, query
from lapse.plans.sqlframes import risk_level_sql, with_frames
from lapse.sources.frames import ORDER_SPEC, PROFILE_SPEC, customer_profile, order_facts, recency_scores
from lapse.sources.tables import read_table

PS = PROFILE_SPEC

RAW_SPEC = PROFILE_SPEC
CLEAN_PLAN = S.CleanPlan(measure="total_raw", tenure_col="tenure", int_cols=("flag",))


def raw_customers(spark, sf):
    """A CSV-like raw copy of the profile: ids and segments padded, the total
    as text (blank at tenure 0, and also where the balance is negative; the
    text NaN for one segment of ASIA), tabs and line ends around some values,
    outcome missing for one priority class, and the EUROPE automobile
    customers appended a second time as exact duplicate rows."""
    cp = customer_profile(spark, sf)
    raw = cp.select(
        F.when(F.col("region") == "ASIA", F.concat(F.lit("  "), F.col("customer_id").cast("string")))
        .when(F.col("region") == "AMERICA", F.concat(F.lit("\t"), F.col("customer_id").cast("string"), F.lit("\n")))
        .otherwise(F.col("customer_id").cast("string")).alias("customer_key"),
        F.when(F.col("has_open") == 1, F.concat(F.lit(" "), F.col("segment"), F.lit(" ")))
        .otherwise(F.col("segment")).alias("segment"),
        F.col("region"),
        F.col("tenure"),
        F.when((F.col("tenure") == 0) | (F.col("acctbal") < 0), F.lit(" "))
        .when((F.col("region") == "ASIA") & (F.col("segment") == "MACHINERY"), F.lit("NaN"))
        .otherwise(F.col("total_charges").cast("string")).alias("total_raw"),
        F.col("has_open").cast("long").alias("flag"),
        F.when((F.col("top_priority") == "5-LOW") & (F.col("has_open") == 0), None)
        .otherwise(F.col("churn")).alias("churn"),
    )
    dup = raw.where((F.col("region") == "EUROPE") & (F.trim("segment") == "AUTOMOBILE"))
    return raw.unionByName(dup)


RAW_SQL = """
raw_customers AS (
  WITH r AS (
    SELECT CASE WHEN region = 'ASIA' THEN '  ' || CAST(customer_id AS VARCHAR)
                WHEN region = 'AMERICA' THEN chr(9) || CAST(customer_id AS VARCHAR) || chr(10) ELSE CAST(customer_id AS VARCHAR) END
             AS customer_key,
           CASE WHEN has_open = 1 THEN ' ' || segment || ' ' ELSE segment END AS segment,
           region, tenure,
           CASE WHEN tenure = 0 OR acctbal < 0 THEN ' ' WHEN region = 'ASIA' AND segment = 'MACHINERY' THEN 'NaN' ELSE CAST(total_charges AS VARCHAR) END AS total_raw,
           CAST(has_open AS BIGINT) AS flag,
           CASE WHEN top_priority = '5-LOW' AND has_open = 0 THEN NULL ELSE churn END AS churn
    FROM customer_profile)
  SELECT * FROM r UNION ALL SELECT * FROM r WHERE region = 'EUROPE' AND trim(segment) = 'AUTOMOBILE'
)"""

_STRIP = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_TOTAL = f"nullif(TRY_CAST({_STRIP.format(c='total_raw')} AS DOUBLE), 'NaN'::DOUBLE)"
CLEAN_SQL = f"""
staged AS (
  SELECT {_STRIP.format(c='customer_key')} AS customer_key, {_STRIP.format(c='segment')} AS segment,
         {_STRIP.format(c='region')} AS region, tenure,
         CASE WHEN tenure = 0 AND {_TOTAL} IS NULL THEN 0.0 ELSE {_TOTAL} END AS total_raw,
         tenure = 0 AND {_TOTAL} IS NULL AS imputed,
         flag, {_STRIP.format(c='churn')} AS churn
  FROM raw_customers)"""


@query("clean_customers", "S2 S3 S4 S5 S6 S7 S8", sql=with_frames("""
SELECT DISTINCT customer_key, segment, region, tenure, total_raw, CAST(flag AS INTEGER) AS flag, churn,
       CASE WHEN churn = 'Yes' THEN 1 ELSE 0 END AS label
FROM staged WHERE total_raw IS NOT NULL""", RAW_SQL + "," + CLEAN_SQL))
def clean_customers(spark, sf):
    return S.clean(raw_customers(spark, sf), RAW_SPEC, CLEAN_PLAN)


@query("clean_report", "S9", sql=with_frames("""
SELECT (SELECT count(*) FROM staged) AS n_input,
       (SELECT CAST(count_if(imputed) AS BIGINT) FROM staged) AS n_imputed,
       (SELECT CAST(count_if(total_raw IS NULL) AS BIGINT) FROM staged) AS n_dropped,
       (SELECT count(*) FROM staged WHERE total_raw IS NOT NULL)
         - (SELECT count(*) FROM (SELECT DISTINCT customer_key, segment, region, tenure, total_raw, flag, churn
                                  FROM staged WHERE total_raw IS NOT NULL)) AS n_duplicates,
       (SELECT count(*) FROM (SELECT DISTINCT customer_key, segment, region, tenure, total_raw, flag, churn
                              FROM staged WHERE total_raw IS NOT NULL)) AS n_output""", RAW_SQL + "," + CLEAN_SQL))
def clean_report(spark, sf):
    return S.clean_report(raw_customers(spark, sf), RAW_SPEC, CLEAN_PLAN)


@query("clean_report_observed", "S9", sql=REGISTRY["clean_report"].sql)
def clean_report_observed(spark, sf):
    """The counters of one read, taken while the cleaned rows are written."""
    from lapse.staging import drop_staged, staged

    rows, seen = S.clean_observed(raw_customers(spark, sf), RAW_SPEC, CLEAN_PLAN)
    drop_staged(staged(rows, "cleaned"))
    counters = seen.get
    return spark.range(1).select(*[F.lit(counters[c]).cast("long").alias(c) for c in
                                   ("n_input", "n_imputed", "n_dropped", "n_duplicates", "n_output")])


@query("clean_customers_observed", "S2 S3 S4 S5 S6 S7 S8", sql=REGISTRY["clean_customers"].sql)
def clean_customers_observed(spark, sf):
    """The rows that are written beside those counters."""
    return S.clean_observed(raw_customers(spark, sf), RAW_SPEC, CLEAN_PLAN)[0]


# ---------------------------------------------------------------- charts

@query("chart_outcome_distribution", "C1", sql=with_frames("""
SELECT churn, count(*) AS count FROM customer_profile WHERE churn IS NOT NULL GROUP BY churn"""))
def chart_outcome_distribution(spark, sf):
    return C.outcome_distribution(customer_profile(spark, sf), PS)


def _hist_sql(frame, column, group_expr, bins, where="TRUE", density=False):
    g = f"{group_expr} AS \"group\", " if group_expr else ""
    gk = '"group", ' if group_expr else ""
    dens = ""
    if density:
        dens = (f", round(count(*) / (sum(count(*)) OVER (PARTITION BY {gk[:-2] if gk else '1'}) "
                f"* ((hi - lo) / {float(bins)})), 8) AS density")
    return f"""
SELECT {gk}bin, round(lo + bin * ((hi - lo) / {float(bins)}), 4) AS bin_start,
       round(lo + (bin + 1) * ((hi - lo) / {float(bins)}), 4) AS bin_end, count(*) AS count{dens}
FROM (
  SELECT {g}CAST(least(coalesce(floor((x - lo) / nullif((hi - lo) / {float(bins)}, 0)), 0), {bins - 1}) AS INTEGER)
           AS bin, lo, hi
  FROM (SELECT *, CAST({column} AS DOUBLE) AS x FROM {frame} WHERE {where} AND {column} IS NOT NULL) d,
       (SELECT min(CAST({column} AS DOUBLE)) AS lo, max(CAST({column} AS DOUBLE)) AS hi
        FROM {frame} WHERE {where} AND {column} IS NOT NULL) m
) GROUP BY {gk}bin, lo, hi"""


@query("chart_histogram_total_price_by_status", "C3", sql=with_frames(
    _hist_sql("order_facts", "total_price", "status", 30, "status IS NOT NULL")))
def chart_histogram(spark, sf):
    return C.distribution_by_outcome(order_facts(spark, sf, ["status", "total_price"]), ORDER_SPEC, "total_price", 30)


@query("chart_tenure_trend", "C4", sql=with_frames("""
SELECT bucket_index, tenure_bucket, count(*) AS count,
       round(100.0 * sum(CASE WHEN status = 'F' THEN 1 ELSE 0 END) / count(*), 2) AS rate_pct
FROM (SELECT *,
        CASE WHEN tenure >= 0 AND tenure <= 12 THEN 0 WHEN tenure > 12 AND tenure <= 24 THEN 1
             WHEN tenure > 24 AND tenure <= 36 THEN 2 WHEN tenure > 36 AND tenure <= 48 THEN 3
             WHEN tenure > 48 AND tenure <= 60 THEN 4 WHEN tenure > 60 AND tenure <= 72 THEN 5 END AS bucket_index,
        CASE WHEN tenure >= 0 AND tenure <= 12 THEN '0-12m' WHEN tenure > 12 AND tenure <= 24 THEN '13-24m'
             WHEN tenure > 24 AND tenure <= 36 THEN '25-36m' WHEN tenure > 36 AND tenure <= 48 THEN '37-48m'
             WHEN tenure > 48 AND tenure <= 60 THEN '49-60m' WHEN tenure > 60 AND tenure <= 72 THEN '61-72m'
        END AS tenure_bucket
      FROM order_facts)
WHERE bucket_index IS NOT NULL GROUP BY bucket_index, tenure_bucket"""))
def chart_tenure_trend(spark, sf):
    return C.tenure_chart(order_facts(spark, sf, ["status", "tenure", "total_price"]), ORDER_SPEC)


@query("chart_risk_distribution", "C5", sql=with_frames(
    _hist_sql("recency_scores", "risk_score", risk_level_sql("risk_score"), 30)))
def chart_risk_distribution(spark, sf):
    return C.risk_distribution(recency_scores(customer_profile(spark, sf)))


_BOX_CTES = """d AS (SELECT status, CAST(total_price AS DOUBLE) AS x FROM order_facts
           WHERE status IS NOT NULL AND total_price IS NOT NULL),
q AS (SELECT status, count(*) AS n, min(x) AS mn, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med,
             quantile_cont(x, 0.75) AS q3, max(x) AS mx FROM d GROUP BY status),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lf, q3 + 1.5 * (q3 - q1) AS uf FROM q)"""


@query("chart_box_total_price", "C6", sql=with_frames("""
SELECT f.status, f.n, round(mn, 4) AS min, round(q1, 4) AS q1, round(med, 4) AS median, round(q3, 4) AS q3,
       round(mx, 4) AS max, round(iqr, 4) AS iqr, round(lf, 4) AS lower_fence, round(uf, 4) AS upper_fence,
       round(min(CASE WHEN x >= lf AND x <= uf THEN x END), 4) AS whisker_low,
       round(max(CASE WHEN x >= lf AND x <= uf THEN x END), 4) AS whisker_high,
       CAST(count_if(NOT (x >= lf AND x <= uf)) AS BIGINT) AS n_outliers
FROM f JOIN d ON f.status = d.status
GROUP BY f.status, f.n, mn, q1, med, q3, mx, iqr, lf, uf""", _BOX_CTES))
def chart_box(spark, sf):
    return C.box_stats(order_facts(spark, sf, ["status", "total_price"]), ORDER_SPEC, "total_price")


@query("chart_top_risk", "C7", sql=with_frames("""
SELECT customer_id, risk_score FROM recency_scores ORDER BY risk_score DESC, customer_id LIMIT 15"""))
def chart_top_risk(spark, sf):
    return C.top_risk_chart(recency_scores(customer_profile(spark, sf)), PS, 15)


def _heatmap_sql():
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    sel, rows = [], []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            sel.append(f"{pearson_sql(a, b, 8)} AS r_{a}__{b}")
            rows.append(f"SELECT '{a}' AS col1, '{b}' AS col2, r_{a}__{b} AS r FROM w")
            if a != b:
                rows.append(f"SELECT '{b}' AS col1, '{a}' AS col2, r_{a}__{b} AS r FROM w")
    return f"WITH w AS (SELECT {', '.join(sel)} FROM lineitem)\n" + "\nUNION ALL ".join(rows)


@query("chart_correlation_heatmap_lineitem", "C9", sql=_heatmap_sql())
def chart_heatmap(spark, sf):
    from lapse.operators.aggregates import correlation_matrix

    li = read_table(spark, sf, "lineitem")
    return correlation_matrix(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], digits=8)


@query("chart_risk_gauge", "C10", sql=with_frames("""
SELECT customer_id, round(risk_score * 100, 2) AS gauge_value,
       CASE WHEN risk_score >= 0.7 THEN 'red' WHEN risk_score >= 0.4 THEN 'amber' ELSE 'green' END AS band
FROM recency_scores"""))
def chart_risk_gauge(spark, sf):
    return C.risk_gauge(recency_scores(customer_profile(spark, sf)), PS)


@query("chart_tenure_density", "C11", sql=with_frames(
    _hist_sql("order_facts", "tenure", "status", 25, "status IS NOT NULL", density=True)))
def chart_tenure_density(spark, sf):
    return C.density_by_outcome(order_facts(spark, sf, ["status", "tenure"]), ORDER_SPEC, "tenure", 25)
