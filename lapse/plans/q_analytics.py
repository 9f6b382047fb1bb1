"""Registered queries: profiling, aggregates, ranking (P, A, T, X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapse.operators import aggregates as A
from lapse.operators import gram as GR
from lapse.operators import profiling as P
from lapse.operators import ranking as T
from lapse.plans.registry import REGISTRY, query
from lapse.plans.sqlframes import risk_level_sql, with_frames
from lapse.sources.frames import ORDER_SPEC, PROFILE_SPEC, customer_profile, order_facts, recency_scores
from lapse.sources.tables import read_table
from lapse.staging import drop_path, shared_path, staged

PS = PROFILE_SPEC
OS = ORDER_SPEC

# ---------------------------------------------------------------- A6 flagship


@query("rate_by_segment", "A6 C2", sql=with_frames("""
SELECT segment, round(100.0 * sum(CASE WHEN churn = 'Yes' THEN 1 ELSE 0 END) / count(*), 2) AS rate_pct,
       count(*) AS count
FROM customer_profile WHERE segment IS NOT NULL GROUP BY segment"""))
def rate_by_segment(spark, sf):
    return A.group_rate(customer_profile(spark, sf), PS, "segment")


@query("rate_by_priority_orders", "A6", sql=with_frames("""
SELECT priority, round(100.0 * sum(CASE WHEN status = 'F' THEN 1 ELSE 0 END) / count(*), 2) AS rate_pct,
       count(*) AS count
FROM order_facts WHERE priority IS NOT NULL GROUP BY priority"""))
def rate_by_priority_orders(spark, sf):
    return A.group_rate(order_facts(spark, sf, ["status", "priority"]), OS, "priority")


# ---------------------------------------------------------------- profiling

@query("shape_lineitem", "P1", sql="SELECT count(*) AS rows, 11 AS columns FROM lineitem")
def shape_lineitem(spark, sf):
    return P.get_shape(read_table(spark, sf, "lineitem"))


_PROFILE_TYPES = [
    ("customer_id", "bigint", "numeric"), ("segment", "string", "categorical"),
    ("nation", "string", "categorical"), ("region", "string", "categorical"),
    ("top_priority", "string", "categorical"), ("has_open", "int", "numeric"),
    ("tenure", "int", "numeric"), ("monthly_charges", "double", "numeric"),
    ("total_charges", "double", "numeric"), ("acctbal", "double", "numeric"),
    ("n_orders", "bigint", "numeric"), ("recency_days", "int", "numeric"),
    ("churn", "string", "categorical"),
]


def _columns_sql():
    parts = [
        f"SELECT '{n}' AS name, '{t}' AS dtype, '{k}' AS kind, count(DISTINCT {n}) AS n_unique, "
        f"count(*) - count({n}) AS n_missing FROM customer_profile"
        for n, t, k in _PROFILE_TYPES
    ]
    return with_frames("\nUNION ALL ".join(parts))


@query("columns_profile", "P2 P7", sql=_columns_sql())
def columns_profile(spark, sf):
    return P.get_columns(customer_profile(spark, sf))


def dirty_profile(spark, sf):
    """customer_profile with gaps: churn missing for customers without an
    open order whose favourite priority is 5-LOW; total missing when the
    account balance is negative."""
    cp = customer_profile(spark, sf)
    return cp.select(
        "customer_id", "segment", "tenure",
        F.when(F.col("acctbal") >= 0, F.col("total_charges")).alias("total_charges"),
        F.when((F.col("top_priority") == "5-LOW") & (F.col("has_open") == 0), None)
        .otherwise(F.col("churn")).alias("churn"),
    )


_DIRTY_PROFILE_SQL = """
dirty_profile AS (
  SELECT customer_id, segment, tenure,
         CASE WHEN acctbal >= 0 THEN total_charges END AS total_charges,
         CASE WHEN top_priority = '5-LOW' AND has_open = 0 THEN NULL ELSE churn END AS churn
  FROM customer_profile
)"""


@query("missing_values", "P3", sql=with_frames("""
SELECT * FROM (
  SELECT 'customer_id' AS column, count(*) - count(customer_id) AS n_missing FROM dirty_profile
  UNION ALL SELECT 'segment', count(*) - count(segment) FROM dirty_profile
  UNION ALL SELECT 'tenure', count(*) - count(tenure) FROM dirty_profile
  UNION ALL SELECT 'total_charges', count(*) - count(total_charges) FROM dirty_profile
  UNION ALL SELECT 'churn', count(*) - count(churn) FROM dirty_profile
) WHERE n_missing > 0""", _DIRTY_PROFILE_SQL))
def missing_values(spark, sf):
    return P.get_missing_values(dirty_profile(spark, sf))


@query("churn_rate", "P4", sql=with_frames("""
SELECT count(*) AS total, CAST(count_if(churn = 'Yes') AS BIGINT) AS positive, CAST(count_if(churn = 'No') AS BIGINT) AS negative,
       coalesce(round(100.0 * CAST(count_if(churn = 'Yes') AS BIGINT) / nullif(count(*), 0), 2), 0.0) AS rate_pct
FROM dirty_profile""", _DIRTY_PROFILE_SQL))
def churn_rate(spark, sf):
    return P.get_rate(dirty_profile(spark, sf), PS)


@query("dataset_info", "P5", sql=with_frames("""
SELECT count(*) AS n_rows, 6 AS n_cols, CAST(count_if(churn = 'Yes') AS BIGINT) AS n_positive,
       CAST(count_if(churn = 'No') AS BIGINT) AS n_negative,
       round(100.0 * CAST(count_if(churn = 'Yes') AS BIGINT) / count(*), 2) AS rate_pct,
       (count(*) - count(total_charges)) + (count(*) - count(churn)) AS n_missing_total,
       concat_ws(',', CASE WHEN count(*) > count(churn) THEN 'churn=' || CAST(count(*) - count(churn) AS VARCHAR) END,
                 CASE WHEN count(*) > count(total_charges)
                      THEN 'total_charges=' || CAST(count(*) - count(total_charges) AS VARCHAR) END) AS missing_columns,
       'customer_id,tenure,total_charges,label' AS numeric_columns, 'segment,churn' AS categorical_columns,
       count(DISTINCT customer_id) = count(*) AS id_unique,
       (SELECT count(*) FROM dirty_profile) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_profile))
         AS n_duplicate_rows
FROM dirty_profile""", _DIRTY_PROFILE_SQL))
def dataset_info(spark, sf):
    out = P.dataset_info(dirty_profile(spark, sf), PS)
    entries = F.transform(F.map_entries("missing_columns"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return out.withColumns({"missing_columns": F.array_join(F.array_sort(entries), ","),
                            "numeric_columns": F.array_join("numeric_columns", ","),
                            "categorical_columns": F.array_join("categorical_columns", ",")})


@query("kpi_row", "P6", sql=with_frames("""
SELECT count(*) AS customers, round(100.0 * CAST(count_if(churn = 'Yes') AS BIGINT) / count(*), 2) AS rate_pct,
       round(100.0 - round(100.0 * CAST(count_if(churn = 'Yes') AS BIGINT) / count(*), 2), 2) AS retention_pct,
       CAST(count_if(churn = 'Yes') AS BIGINT) AS churned, CAST(count_if(churn = 'No') AS BIGINT) AS retained
FROM customer_profile"""))
def kpi_row(spark, sf):
    return P.kpi_row(customer_profile(spark, sf), PS)


# ---------------------------------------------------------------- scalar aggregates

@query("average_monthly_charges", "A1", sql=with_frames("""
SELECT 'monthly_charges' AS column, round(avg(monthly_charges), 4) AS mean, count(monthly_charges) AS n
FROM customer_profile"""))
def average_monthly_charges(spark, sf):
    return A.get_average(customer_profile(spark, sf), "monthly_charges")


@query("median_extendedprice", "A2", sql="""
SELECT 'l_extendedprice' AS column, round(quantile_cont(l_extendedprice, 0.5), 4) AS median FROM lineitem""")
def median_extendedprice(spark, sf):
    return A.get_median(read_table(spark, sf, "lineitem"), "l_extendedprice")


@query("describe_extendedprice", "A3", sql="""
SELECT 'l_extendedprice' AS column, count(l_extendedprice) AS count,
       round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std,
       round(min(l_extendedprice), 4) AS min,
       round(quantile_cont(l_extendedprice, 0.25), 4) AS q25,
       round(quantile_cont(l_extendedprice, 0.5), 4) AS median,
       round(quantile_cont(l_extendedprice, 0.75), 4) AS q75,
       round(max(l_extendedprice), 4) AS max
FROM lineitem""")
def describe_extendedprice(spark, sf):
    return A.get_distribution(read_table(spark, sf, "lineitem"), "l_extendedprice")


@query("median_extendedprice_bracketed", "A2", sql="""
SELECT 'l_extendedprice' AS column, round(quantile_cont(l_extendedprice, 0.5), 4) AS median FROM lineitem""")
def median_extendedprice_bracketed(spark, sf):
    return A.get_median(read_table(spark, sf, "lineitem"), "l_extendedprice", accuracy=1000)


@query("describe_extendedprice_bracketed", "A3", sql="""
SELECT 'l_extendedprice' AS column, count(l_extendedprice) AS count,
       round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std,
       round(min(l_extendedprice), 4) AS min,
       round(quantile_cont(l_extendedprice, 0.25), 4) AS q25,
       round(quantile_cont(l_extendedprice, 0.5), 4) AS median,
       round(quantile_cont(l_extendedprice, 0.75), 4) AS q75,
       round(max(l_extendedprice), 4) AS max
FROM lineitem""")
def describe_extendedprice_bracketed(spark, sf):
    return A.describe_numeric(read_table(spark, sf, "lineitem"), "l_extendedprice", accuracy=1000)


@query("distribution_top_priority", "A4", sql=with_frames("""
SELECT 'top_priority' AS column, CAST(top_priority AS VARCHAR) AS value, count(*) AS count,
       round(100.0 * count(*) / (SELECT count(*) FROM customer_profile), 2) AS pct
FROM customer_profile GROUP BY top_priority"""))
def distribution_top_priority(spark, sf):
    return A.get_distribution(customer_profile(spark, sf), "top_priority")


@query("count_by_has_open_dirty_churn", "A5 X5", sql=with_frames("""
SELECT 'churn' AS column, CAST(churn AS VARCHAR) AS value, count(*) AS count,
       round(100.0 * count(*) / (SELECT count(*) FROM dirty_profile), 2) AS pct
FROM dirty_profile GROUP BY churn""", _DIRTY_PROFILE_SQL))
def count_by_dirty_churn(spark, sf):
    return A.value_counts(dirty_profile(spark, sf), "churn")


@query("count_by_linenumber", "A5", sql="""
SELECT 'l_linenumber' AS column, CAST(l_linenumber AS VARCHAR) AS value, count(*) AS count,
       round(100.0 * count(*) / (SELECT count(*) FROM lineitem), 2) AS pct
FROM lineitem GROUP BY l_linenumber""")
def count_by_linenumber(spark, sf):
    return A.value_counts(read_table(spark, sf, "lineitem"), "l_linenumber")


# group_aggregate: every function, on lineitem (the largest table)
_GA_SQL = {
    "mean": "round(avg(l_extendedprice), 4)",
    "median": "round(quantile_cont(l_extendedprice, 0.5), 4)",
    "sum": "round(coalesce(sum(l_extendedprice), 0), 4)",
    "count": "count(l_extendedprice)",
    "min": "round(min(l_extendedprice), 4)",
    "max": "round(max(l_extendedprice), 4)",
    "std": "round(stddev_samp(l_extendedprice), 4)",
}


def _ga_builder(func):
    def build(spark, sf):
        li = read_table(spark, sf, "lineitem")
        return A.group_aggregate(li, "l_returnflag", "l_extendedprice", func,
                                 filter_col="l_linestatus", filter_val="F")
    return build


for _f, _expr in _GA_SQL.items():
    query(f"group_{_f}_price_by_flag", "A7", sql=f"""
SELECT l_returnflag, {_expr} AS {_f}_l_extendedprice
FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag IS NOT NULL GROUP BY l_returnflag""")(_ga_builder(_f))


@query("group_median_price_by_flag_bracketed", "A7", sql="""
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS median_l_extendedprice
FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag IS NOT NULL GROUP BY l_returnflag""")
def group_median_price_by_flag_bracketed(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return A.group_aggregate(li, "l_returnflag", "l_extendedprice", "median",
                             filter_col="l_linestatus", filter_val="F", accuracy=1000)


@query("group_std_one_row_groups", "A7 X9", sql="""
SELECT l_orderkey, round(stddev_samp(l_quantity), 4) AS std_l_quantity
FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY l_orderkey""")
def group_std_one_row_groups(spark, sf):
    return A.group_aggregate(read_table(spark, sf, "lineitem"), "l_orderkey", "l_quantity", "std")


@query("group_sum_all_missing", "A7 X9", sql=with_frames("""
SELECT segment, round(coalesce(sum(total_charges), 0), 4) AS sum_total_charges
FROM (SELECT segment, CASE WHEN segment <> 'BUILDING' THEN total_charges END AS total_charges
      FROM customer_profile) WHERE segment IS NOT NULL GROUP BY segment"""))
def group_sum_all_missing(spark, sf):
    cp = customer_profile(spark, sf).select(
        "segment", F.when(F.col("segment") != "BUILDING", F.col("total_charges")).alias("total_charges"))
    return A.group_aggregate(cp, "segment", "total_charges", "sum")


@query("segment_mean_acctbal_by_region", "A8", sql=with_frames("""
SELECT region, round(avg(acctbal), 4) AS mean_acctbal FROM customer_profile
WHERE region IS NOT NULL GROUP BY region"""))
def segment_mean_acctbal(spark, sf):
    return A.segment_comparison(customer_profile(spark, sf), "region", "acctbal", "mean")


@query("average_charges_by_churn", "A9", sql=with_frames("""
SELECT churn, round(avg(monthly_charges), 4) AS mean_monthly_charges FROM customer_profile
WHERE churn IS NOT NULL GROUP BY churn"""))
def average_charges_by_churn(spark, sf):
    return A.average_by_target(customer_profile(spark, sf), PS, "monthly_charges")


def _trend_sql(frame, target, positive, charge, suffix=""):
    return with_frames(f"""
SELECT bucket_index, tenure_bucket, count(*) AS count,
       round(100.0 * sum(CASE WHEN {target} = '{positive}' THEN 1 ELSE 0 END) / count(*), 2) AS rate_pct
       {', round(avg(' + charge + '), 2) AS mean_charge' if charge else ''}
FROM (SELECT *,
        CASE WHEN tenure >= 0 AND tenure <= 12 THEN 0 WHEN tenure > 12 AND tenure <= 24 THEN 1
             WHEN tenure > 24 AND tenure <= 36 THEN 2 WHEN tenure > 36 AND tenure <= 48 THEN 3
             WHEN tenure > 48 AND tenure <= 60 THEN 4 WHEN tenure > 60 AND tenure <= 72 THEN 5 END AS bucket_index,
        CASE WHEN tenure >= 0 AND tenure <= 12 THEN '0-12{suffix}' WHEN tenure > 12 AND tenure <= 24 THEN '13-24{suffix}'
             WHEN tenure > 24 AND tenure <= 36 THEN '25-36{suffix}' WHEN tenure > 36 AND tenure <= 48 THEN '37-48{suffix}'
             WHEN tenure > 48 AND tenure <= 60 THEN '49-60{suffix}' WHEN tenure > 60 AND tenure <= 72 THEN '61-72{suffix}'
        END AS tenure_bucket
      FROM {frame})
WHERE bucket_index IS NOT NULL GROUP BY bucket_index, tenure_bucket""")


@query("tenure_trend_orders", "A10", sql=_trend_sql("order_facts", "status", "F", "total_price"))
def tenure_trend_orders(spark, sf):
    return A.tenure_trend(order_facts(spark, sf, ["status", "tenure", "total_price"]), OS)


@query("tenure_trend_customers", "A10", sql=_trend_sql("customer_profile", "churn", "Yes", "monthly_charges"))
def tenure_trend_customers(spark, sf):
    return A.tenure_trend(customer_profile(spark, sf), PS)


def _fc_sql(pred, column, value, op, frame="lineitem"):
    return f"""
SELECT '{column}' AS column, '{value}' AS value, '{op}' AS operator, CAST(count_if({pred}) AS BIGINT) AS count,
       count(*) AS total, round(100.0 * CAST(count_if({pred}) AS BIGINT) / count(*), 2) AS pct FROM {frame}"""


@query("filter_count_eq", "A11 X1", sql=_fc_sql("coalesce(l_returnflag = 'R', false)", "l_returnflag", "R", "eq"))
def filter_count_eq(spark, sf):
    return A.filter_and_count(read_table(spark, sf, "lineitem"), "l_returnflag", "R", "eq")


@query("filter_count_ne_with_missing", "A11 X2", sql=with_frames(
    _fc_sql("churn IS DISTINCT FROM 'Yes'", "churn", "Yes", "ne", "dirty_profile"), _DIRTY_PROFILE_SQL))
def filter_count_ne(spark, sf):
    return A.filter_and_count(dirty_profile(spark, sf), "churn", "Yes", "ne")


@query("filter_count_gte", "A11 X3", sql=_fc_sql("coalesce(l_quantity >= 25, false)", "l_quantity", 25, "gte"))
def filter_count_gte(spark, sf):
    return A.filter_and_count(read_table(spark, sf, "lineitem"), "l_quantity", 25, "gte")


@query("filter_count_lt_missing", "A11 X3", sql=with_frames(
    _fc_sql("coalesce(total_charges < 100000, false)", "total_charges", 100000, "lt", "dirty_profile"),
    _DIRTY_PROFILE_SQL))
def filter_count_lt(spark, sf):
    return A.filter_and_count(dirty_profile(spark, sf), "total_charges", 100000, "lt")


@query("filter_count_contains_regex", "A11 X4", sql=_fc_sql(
    "coalesce(regexp_matches(CAST(o_orderpriority AS VARCHAR), '(?i)ur.ent|^5-'), false)",
    "o_orderpriority", "ur.ent|^5-", "contains", "orders"))
def filter_count_contains(spark, sf):
    return A.filter_and_count(read_table(spark, sf, "orders"), "o_orderpriority", "ur.ent|^5-", "contains")


_PEARSON_SQL = """covar_pop({x}, {y}) / nullif(
  stddev_pop(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {x} END)
  * stddev_pop(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {y} END), 0)"""


def pearson_sql(x, y, digits=4):
    e = _PEARSON_SQL.format(x=x, y=y)
    return f"round({e}, {digits})" if digits is not None else e


@query("correlation_pair", "A12", sql=f"""
SELECT 'l_quantity' AS col1, 'l_extendedprice' AS col2,
       {pearson_sql('l_quantity', 'l_extendedprice')} AS pearson_r FROM lineitem""")
def correlation_pair(spark, sf):
    return A.correlation_pair(read_table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@query("correlation_pair_pairwise_missing", "A12 X9", sql=with_frames(f"""
SELECT 'tenure' AS col1, 'total_charges' AS col2, {pearson_sql('tenure', 'total_charges')} AS pearson_r
FROM dirty_profile""", _DIRTY_PROFILE_SQL))
def correlation_pair_missing(spark, sf):
    return A.correlation_pair(dirty_profile(spark, sf), "tenure", "total_charges")


_MATRIX_COLS = ["tenure", "monthly_charges", "total_charges", "acctbal", "label"]


def _matrix_parts(digits=4, frame="customer_profile"):
    cols = _MATRIX_COLS
    sel, rows = [], []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            sel.append(f"{pearson_sql(a, b, digits)} AS r_{a}__{b}")
            rows.append(f"SELECT '{a}' AS col1, '{b}' AS col2, r_{a}__{b} AS r FROM w")
            if a != b:
                rows.append(f"SELECT '{b}' AS col1, '{a}' AS col2, r_{a}__{b} AS r FROM w")
    cte = (f"w AS (SELECT {', '.join(sel)} FROM "
           f"(SELECT *, CASE WHEN churn = 'Yes' THEN 1 ELSE 0 END AS label FROM {frame}))")
    return cte, "\nUNION ALL ".join(rows)


def _matrix_sql(digits=4, frame="customer_profile"):
    cte, body = _matrix_parts(digits, frame)
    return with_frames(body, cte)


@query("correlation_matrix", "A13", sql=_matrix_sql())
def correlation_matrix(spark, sf):
    return A.correlation_matrix(customer_profile(spark, sf), spec=PS)


_COMPONENTS_SQL = f"""
WITH x AS (SELECT vec_id, unnest(range(len(embedding))) AS i,
                  CAST(unnest(embedding) AS DOUBLE) AS raw FROM embeddings WHERE len(embedding) = 64),
     v AS (SELECT vec_id, i, CASE WHEN isfinite(raw) AND (vec_id + i) % 7 <> 0 THEN raw END AS x FROM x),
     m AS (SELECT a.i AS i, b.i AS j, {pearson_sql('a.x', 'b.x', 6)} AS r
           FROM v a JOIN v b ON a.vec_id = b.vec_id GROUP BY 1, 2)
SELECT CAST(i AS VARCHAR) AS col1, CAST(j AS VARCHAR) AS col2, r FROM m"""


@query("correlation_wide_components", "A13 C9", sql=_COMPONENTS_SQL)
def correlation_wide_components(spark, sf):
    """All components of the embeddings as a wide table, with gaps (one
    component in seven of each row is taken as missing)."""
    e = read_table(spark, sf, "embeddings")
    gaps = F.transform("embedding", lambda x, i: F.when((F.col("vec_id") + i) % 7 != 0, x.cast("double")))
    return GR.component_correlations(e.select(gaps.alias("v")), "v", 64, digits=6)


@query("correlation_wide_lineitem", "A13", sql=f"""
WITH m AS ({" UNION ALL ".join(
    f"SELECT '{a}' AS col1, '{b}' AS col2, {pearson_sql(a, b, 6)} AS r FROM lineitem"
    for a in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    for b in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))})
SELECT * FROM m""")
def correlation_wide_lineitem(spark, sf):
    return GR.wide_correlations(read_table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 6)


def _with_target_sql():
    cte, body = _matrix_parts()
    return with_frames("SELECT col2 AS feature, r FROM m WHERE col1 = 'label' AND col2 <> 'label'",
                       cte + ",\nm AS (" + body + ")")


@query("correlation_with_target", "A14", sql=_with_target_sql())
def correlation_with_target(spark, sf):
    return A.correlation_with_target(customer_profile(spark, sf), PS)


@query("class_imbalance", "A15", sql=with_frames("""
SELECT CAST(count_if(churn IS DISTINCT FROM 'Yes') AS BIGINT) AS n_negative,
       CAST(count_if(churn = 'Yes') AS BIGINT) AS n_positive,
       round(CAST(count_if(churn IS DISTINCT FROM 'Yes') AS BIGINT) / nullif(CAST(count_if(churn = 'Yes') AS BIGINT), 0), 4) AS imbalance_ratio
FROM dirty_profile""", _DIRTY_PROFILE_SQL))
def class_imbalance(spark, sf):
    return A.class_imbalance(dirty_profile(spark, sf), PS)


@query("zero_tenure", "A16", sql=with_frames("""
SELECT customer_id, tenure, total_charges, churn FROM customer_profile WHERE tenure = 0"""))
def zero_tenure(spark, sf):
    return A.zero_tenure(customer_profile(spark, sf), PS, extra=("total_charges",))


# ---------------------------------------------------------------- ranking

@query("top_orders_by_price", "T1", sql="""
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20""")
def top_orders_by_price(spark, sf):
    return T.top_n_records(read_table(spark, sf, "orders"), "o_totalprice", 20,
                           columns=["o_orderkey", "o_custkey", "o_totalprice"], tie_break="o_orderkey")


@query("bottom_total_charges_missing_last", "T1 X5", sql=with_frames("""
SELECT customer_id, total_charges FROM dirty_profile
ORDER BY total_charges ASC NULLS LAST, customer_id LIMIT 25""", _DIRTY_PROFILE_SQL))
def bottom_total_charges(spark, sf):
    return T.top_n_records(dirty_profile(spark, sf), "total_charges", 25, ascending=True,
                           columns=["customer_id", "total_charges"], tie_break="customer_id")


@query("lookup_urgent_big_order_customers", "T2", sql=with_frames("""
SELECT customer_id, segment, churn FROM customer_profile
WHERE customer_id IN (SELECT o_custkey FROM orders
                      WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000)"""))
def lookup_customers(spark, sf):
    o = read_table(spark, sf, "orders")
    # requests arrive padded with any white space, as text: the lookup strips and upper-cases them
    req = o.where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 300000)).select(
        F.concat(F.lit(" \t"), F.col("o_custkey").cast("string"), F.lit("\r\n ")).alias("requested"))
    cp = customer_profile(spark, sf).select("customer_id", "segment", "churn")
    return T.lookup_ids(cp, PS, req)


@query("lookup_store_customers", "T2 R3 R4", sql=REGISTRY["lookup_urgent_big_order_customers"].sql)
def lookup_store_customers(spark, sf):
    """The same requests against a bucketed, sorted store of the customers."""
    o = read_table(spark, sf, "orders")
    req = o.where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 300000)).select(
        F.concat(F.lit(" \t"), F.col("o_custkey").cast("string"), F.lit("\r\n ")).alias("requested"))
    cp = customer_profile(spark, sf).select("customer_id", "segment", "churn")
    path = shared_path(spark, "lookup")
    table = "lapse_" + path.rsplit("-", 1)[1]
    T.write_lookup_store(cp, PS, table, buckets=int(spark.conf.get("spark.sql.shuffle.partitions")), path=path)
    found = staged(T.lookup_store(spark, table, req), "found")
    spark.sql(f"DROP TABLE {table}")
    drop_path(spark, path)
    return found


@query("risk_tier_counts", "T4 R2", sql=with_frames(f"""
SELECT {risk_level_sql('risk_score')} AS risk_level, count(*) AS count
FROM recency_scores GROUP BY 1"""))
def risk_tier_counts(spark, sf):
    return T.tier_counts(recency_scores(customer_profile(spark, sf)))


@query("top_risk_enriched", "T3", sql=with_frames(f"""
SELECT t.customer_id, t.risk_score, {risk_level_sql('t.risk_score')} AS risk_level,
       c.segment, c.monthly_charges, c.tenure, c.region
FROM (SELECT * FROM recency_scores ORDER BY risk_score DESC NULLS LAST, customer_id LIMIT 10) t
LEFT JOIN customer_profile c ON t.customer_id = c.customer_id"""))
def top_risk_enriched(spark, sf):
    cp = customer_profile(spark, sf)
    return T.top_risk(recency_scores(cp), cp, PS, n=10,
                      enrich=("segment", "monthly_charges", "tenure", "region"))


@query("risk_ledger_filtered", "T5", sql=with_frames(f"""
SELECT customer_id, risk_score, {risk_level_sql('risk_score')} AS risk_level FROM recency_scores
WHERE {risk_level_sql('risk_score')} IN ('High', 'Medium')
  AND regexp_matches(CAST(customer_id AS VARCHAR), '(?i)7$|^1')"""))
def risk_ledger_filtered(spark, sf):
    return T.ledger(recency_scores(customer_profile(spark, sf)), PS, tiers=("High", "Medium"),
                    search="7$|^1")
