"""Customer-like frames derived from the driver's TPC-H-ish tables.

``customer_profile``: one row per customer, outcome = no order in the last
300 days before the newest order date.  ``order_facts``: one row per order,
outcome = order status 'F'.  Both are built with joins and aggregates only;
the per-customer aggregate is a partial (map-side) aggregate, so a customer
holding a third of all orders does not land whole in one task.

Each frame has a DuckDB twin in ``lapse.plans.sqlframes`` for the correctness
gate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapse.sources.tables import read_table
from lapse.spec import Spec
from lapse.staging import staged

CHURN_GAP_DAYS = 300

PROFILE_SPEC = Spec(
    id_col="customer_id",
    target_col="churn",
    positive="Yes",
    negative="No",
    numeric=("tenure", "monthly_charges", "total_charges", "acctbal"),
    categorical=("segment", "region", "top_priority", "has_open"),
    tenure_col="tenure",
    charge_col="monthly_charges",
)

ORDER_SPEC = Spec(
    id_col="order_id",
    target_col="status",
    positive="F",
    numeric=("tenure", "total_price", "acctbal"),
    categorical=("priority", "segment"),
    tenure_col="tenure",
    charge_col="total_price",
)


def _dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation x region: 25 x 5 rows by the TPC-H definition, so a
    broadcast of it has a fixed size bound."""
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)


def customer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority", "o_orderstatus"
    )
    customer = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"
    )
    # newest order date: a scalar subquery (computed once, used as a literal)
    asof = orders.agg(F.max("o_orderdate").cast("date").alias("asof")).scalar()
    per_cust = orders.groupBy("o_custkey").agg(
        F.min("o_orderdate").cast("date").alias("first_order"),
        F.max("o_orderdate").cast("date").alias("last_order"),
        F.sum("o_totalprice").alias("sum_price"),
        F.count(F.lit(1)).alias("n_orders"),
        F.mode("o_orderpriority", deterministic=True).alias("top_priority"),
        F.max(F.when(F.col("o_orderstatus") == "O", 1).otherwise(0)).alias("has_open"),
    )
    base = (
        customer.join(F.broadcast(_dims(spark, sf_dir)), customer.c_nationkey == F.col("n_nationkey"))
        .join(per_cust, customer.c_custkey == per_cust.o_custkey, "left")
    )
    tenure = F.floor(F.datediff(asof, F.col("first_order")) / 30).cast("int")
    total = F.round("sum_price", 2)
    recency = F.datediff(asof, F.col("last_order"))
    return base.select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_mktsegment").alias("segment"),
        F.col("n_name").alias("nation"),
        F.col("r_name").alias("region"),
        "top_priority",
        F.col("has_open").cast("int").alias("has_open"),
        tenure.alias("tenure"),
        F.round(total / F.greatest(tenure, F.lit(1)), 2).alias("monthly_charges"),
        total.alias("total_charges"),
        F.col("c_acctbal").alias("acctbal"),
        F.coalesce(F.col("n_orders"), F.lit(0)).alias("n_orders"),
        recency.alias("recency_days"),
        F.when(recency.isNull(), F.lit(None).cast("string"))
        .when(recency > CHURN_GAP_DAYS, "Yes")
        .otherwise("No")
        .alias("churn"),
    )


#: Columns of ``order_facts`` that need another table than orders.
_ORDER_JOINS = {"tenure": "first", "segment": "customer", "acctbal": "customer"}


def order_facts(spark: SparkSession, sf_dir: str, columns=None) -> DataFrame:
    """``columns``: the ones wanted (all by default); joins that none of them
    needs are not made.  What is joined to the orders is staged, so a customer
    with very many orders can be split, or the other side is broadcast if its
    size allows."""
    wanted = list(columns or ("order_id", "customer_id", "status", "priority", "segment", "tenure", "total_price", "acctbal"))
    joins = {_ORDER_JOINS[c] for c in wanted if c in _ORDER_JOINS}
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"
    )
    j = orders
    if "first" in joins:
        first = staged(orders.groupBy(F.col("o_custkey").alias("f_custkey")).agg(
            F.min("o_orderdate").cast("date").alias("first_order")), "first-orders")
        j = j.join(first, F.col("o_custkey") == F.col("f_custkey"))
    if "customer" in joins:
        customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
        j = j.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    made = {
        "order_id": F.col("o_orderkey"), "customer_id": F.col("o_custkey"), "status": F.col("o_orderstatus"),
        "priority": F.col("o_orderpriority"), "total_price": F.col("o_totalprice"),
    }
    if "first" in joins:
        made["tenure"] = F.floor(F.datediff(F.col("o_orderdate").cast("date"), "first_order") / 30).cast("int")
    if "customer" in joins:
        made |= {"segment": F.col("c_mktsegment"), "acctbal": F.col("c_acctbal")}
    return j.select(*[made[c].alias(c) for c in wanted])


def recency_scores(profile: DataFrame, spec: Spec = PROFILE_SPEC) -> DataFrame:
    """Rule-based baseline scorer: logistic in the days since the last order,
    0.5 at the churn gap.  Gives SQL-checkable score tables for the ranking,
    tiering and chart operators; a fitted model's scores (R1) have the same
    shape."""
    z = (F.col("recency_days") - F.lit(CHURN_GAP_DAYS)) / F.lit(90.0)
    return profile.select(
        spec.id_col,
        F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 4).alias("risk_score"),
    ).where(F.col("risk_score").isNotNull())
