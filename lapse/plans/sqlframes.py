"""DuckDB twins of ``lapse.sources.frames`` for the oracle SQL.

``with_frames("SELECT ... FROM customer_profile")`` prefixes the CTEs a
statement uses.
"""

from __future__ import annotations

CUSTOMER_PROFILE = """
customer_profile AS (
  WITH snap AS (SELECT CAST(max(o_orderdate) AS DATE) AS snap_date FROM orders),
  pri AS (SELECT o_custkey, o_orderpriority, count(*) AS c FROM orders GROUP BY o_custkey, o_orderpriority),
  top AS (SELECT o_custkey, o_orderpriority AS top_priority FROM pri
          QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY c DESC, o_orderpriority) = 1),
  pc AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS first_order,
                CAST(max(o_orderdate) AS DATE) AS last_order, sum(o_totalprice) AS sum_price,
                count(*) AS n_orders, max(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS has_open
         FROM orders GROUP BY o_custkey),
  b AS (SELECT c.c_custkey, c.c_mktsegment, c.c_acctbal, n.n_name, r.r_name, top.top_priority,
               pc.n_orders, pc.has_open,
               CAST(floor(date_diff('day', pc.first_order, snap.snap_date) / 30) AS INTEGER) AS tenure,
               round(pc.sum_price, 2) AS total,
               CAST(date_diff('day', pc.last_order, snap.snap_date) AS INTEGER) AS recency
        FROM customer c
        JOIN nation n ON c.c_nationkey = n.n_nationkey
        JOIN region r ON n.n_regionkey = r.r_regionkey
        LEFT JOIN pc ON c.c_custkey = pc.o_custkey
        LEFT JOIN top ON c.c_custkey = top.o_custkey
        CROSS JOIN snap)
  SELECT c_custkey AS customer_id, c_mktsegment AS segment, n_name AS nation, r_name AS region,
         top_priority, CAST(has_open AS INTEGER) AS has_open, tenure,
         round(total / greatest(tenure, 1), 2) AS monthly_charges, total AS total_charges,
         c_acctbal AS acctbal, coalesce(n_orders, 0) AS n_orders, recency AS recency_days,
         CASE WHEN recency IS NULL THEN NULL WHEN recency > 300 THEN 'Yes' ELSE 'No' END AS churn
  FROM b
)"""

ORDER_FACTS = """
order_facts AS (
  WITH f AS (SELECT o_custkey AS f_custkey, CAST(min(o_orderdate) AS DATE) AS first_order
             FROM orders GROUP BY o_custkey)
  SELECT o.o_orderkey AS order_id, o.o_custkey AS customer_id, o.o_orderstatus AS status,
         o.o_orderpriority AS priority, c.c_mktsegment AS segment,
         CAST(floor(date_diff('day', f.first_order, CAST(o.o_orderdate AS DATE)) / 30) AS INTEGER) AS tenure,
         o.o_totalprice AS total_price, c.c_acctbal AS acctbal
  FROM orders o JOIN f ON o.o_custkey = f.f_custkey JOIN customer c ON o.o_custkey = c.c_custkey
)"""

RECENCY_SCORES = """
recency_scores AS (
  SELECT customer_id, round(1.0 / (1.0 + exp(-((recency_days - 300) / 90.0))), 4) AS risk_score
  FROM customer_profile WHERE recency_days IS NOT NULL
)"""

RISK_LEVEL = """CASE WHEN {s} >= 0.70 AND {s} < 1.01 THEN 'High'
  WHEN {s} >= 0.40 AND {s} < 0.70 THEN 'Medium'
  WHEN {s} >= 0.0 AND {s} < 0.40 THEN 'Low' ELSE 'High' END"""

_ORDER = [("customer_profile", CUSTOMER_PROFILE), ("order_facts", ORDER_FACTS),
          ("recency_scores", RECENCY_SCORES)]
_DEPS = {"recency_scores": ["customer_profile"]}


def with_frames(body: str, extra_ctes: str = "") -> str:
    """Prefix the frame CTEs that ``body`` (and ``extra_ctes``) mention."""
    text = body + extra_ctes
    need = {name for name, _ in _ORDER if name in text}
    for name in list(need):
        need.update(_DEPS.get(name, []))
    ctes = [sql.strip() for name, sql in _ORDER if name in need]
    if extra_ctes.strip():
        ctes.append(extra_ctes.strip())
    if not ctes:
        return body
    return "WITH " + ",\n".join(ctes) + "\n" + body


def risk_level_sql(col: str) -> str:
    return RISK_LEVEL.format(s=col)
