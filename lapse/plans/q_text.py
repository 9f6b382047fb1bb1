"""Registered queries: result checks and text jobs (Q1-Q11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapse.functions import text as TX
from lapse.functions.exprs import prediction_label, risk_level
from lapse.operators import quality as QC
from lapse.operators import textjobs as TJ
from lapse.plans.registry import query
from lapse.plans.sqlframes import risk_level_sql, with_frames
from lapse.sources.frames import customer_profile, recency_scores
from lapse.sources.tables import read_table


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any_sql(col: str, words, fn: str = "contains") -> str:
    return "(" + " OR ".join(f"{fn}({col}, {_sql_str(w)})" for w in words) + ")"


# ---------------------------------------------------------------- Q1-Q3

def _checked_scores(spark, sf):
    cp = customer_profile(spark, sf)
    rs = recency_scores(cp)
    j = cp.join(rs, "customer_id", "left")
    score = F.when(F.col("segment") == "HOUSEHOLD", F.col("total_charges") / 1e6).otherwise(F.col("risk_score"))
    return j.select(
        "customer_id", score.alias("risk_score"),
        F.when(F.col("region") != "AFRICA", risk_level(score)).alias("risk_level"),
        prediction_label(score, 0.5).alias("prediction"),
    )


_CHECKED_SQL = f"""
cs AS (
  SELECT c.customer_id,
         CASE WHEN c.segment = 'HOUSEHOLD' THEN c.total_charges / 1e6 ELSE r.risk_score END AS risk_score,
         c.region
  FROM customer_profile c LEFT JOIN recency_scores r ON c.customer_id = r.customer_id),
s AS (
  SELECT customer_id, risk_score,
         CASE WHEN region <> 'AFRICA' THEN {risk_level_sql('risk_score')} END AS risk_level,
         CASE WHEN risk_score >= 0.5 THEN 'Likely to churn' ELSE 'Unlikely to churn' END AS prediction
  FROM cs)"""


@query("prediction_checks", "Q1 Q3", sql=with_frames("""
SELECT 'empty_result' AS rule, 'warning' AS severity, CAST(CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS BIGINT)
       AS violations, true AS passed FROM s
UNION ALL SELECT 'missing_risk_score', 'error', CAST(count_if(risk_score IS NULL) AS BIGINT), CAST(count_if(risk_score IS NULL) AS BIGINT) = 0 FROM s
UNION ALL SELECT 'missing_risk_level', 'error', CAST(count_if(risk_level IS NULL) AS BIGINT), CAST(count_if(risk_level IS NULL) AS BIGINT) = 0 FROM s
UNION ALL SELECT 'missing_prediction', 'error', CAST(count_if(prediction IS NULL) AS BIGINT), CAST(count_if(prediction IS NULL) AS BIGINT) = 0 FROM s
UNION ALL SELECT 'score_out_of_range', 'error', CAST(count_if(risk_score < 0 OR risk_score > 1) AS BIGINT),
                 CAST(count_if(risk_score < 0 OR risk_score > 1) AS BIGINT) = 0 FROM s""", _CHECKED_SQL))
def prediction_checks(spark, sf):
    return QC.prediction_checks(_checked_scores(spark, sf))


@query("numeric_sanity_lineitem", "Q2", sql="""
WITH d AS (SELECT *, pow(l_discount, -1) AS inv_discount FROM lineitem)
SELECT *, violations = 0 AS passed FROM (
SELECT 'nan_or_inf_l_quantity' AS rule, 'error' AS severity,
       CAST(count_if(isnan(l_quantity) OR isinf(l_quantity)) AS BIGINT) AS violations FROM d
UNION ALL SELECT 'nan_or_inf_l_extendedprice', 'error', CAST(count_if(isnan(l_extendedprice) OR isinf(l_extendedprice)) AS BIGINT) FROM d
UNION ALL SELECT 'nan_or_inf_l_discount', 'error', CAST(count_if(isnan(l_discount) OR isinf(l_discount)) AS BIGINT) FROM d
UNION ALL SELECT 'nan_or_inf_l_tax', 'error', CAST(count_if(isnan(l_tax) OR isinf(l_tax)) AS BIGINT) FROM d
UNION ALL SELECT 'nan_or_inf_inv_discount', 'error', CAST(count_if(isnan(inv_discount) OR isinf(inv_discount)) AS BIGINT) FROM d)""")
def numeric_sanity_lineitem(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return QC.numeric_sanity(li.select("*", F.pow(F.col("l_discount"), F.lit(-1.0)).alias("inv_discount")))


@query("numeric_sanity_nested", "Q2", sql="""
WITH l AS (SELECT l_orderkey AS k, pow(l_discount, -1) AS inv, 0.0 * pow(l_tax, -1) AS flat,
                  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_discount, l_tax, l_quantity, l_extendedprice) - 1 AS i FROM lineitem),
o AS (SELECT k, max(inv) AS most, min(inv) AS least, max(CASE WHEN isnan(flat) THEN 1 ELSE 0 END) AS nans FROM l GROUP BY k)
SELECT order_id, path FROM (
  SELECT k AS order_id, '$.most' AS path FROM o WHERE isinf(most)
  UNION ALL SELECT k, '$.detail.least' FROM o WHERE isinf(least)
  UNION ALL SELECT k, '$.detail.deep.product' FROM o WHERE isinf(most)
  UNION ALL SELECT k, '$.lines[' || i || '].inv' FROM l WHERE isinf(inv)
  UNION ALL SELECT k, '$.lines[' || i || '].pair[1]' FROM l WHERE isnan(flat)
  UNION ALL SELECT k, '$.by_name.most' FROM o WHERE isinf(most)
  UNION ALL SELECT k, '$.any.least' FROM o WHERE isinf(least)
  UNION ALL SELECT k, '$.any.list[0]' FROM o WHERE nans = 1)""")
def numeric_sanity_nested(spark, sf):
    """Results with values that are no numbers at every depth: a column, a
    struct in a struct, a list in a struct in a list, a map and a variant."""
    li = read_table(spark, sf, "lineitem").withColumns(
        {"inv": F.pow("l_discount", F.lit(-1.0)), "flat": F.lit(0.0) * F.pow("l_tax", F.lit(-1.0))})
    line = F.struct("l_linenumber", "l_discount", "l_tax", "l_quantity", "l_extendedprice", "inv", F.array(F.lit(1.0), F.col("flat")).alias("pair"))
    o = li.groupBy("l_orderkey").agg(F.max("inv").alias("most"), F.min("inv").alias("least"), F.array_sort(F.collect_list(line)).alias("lines"),
                                     F.max(F.when(F.isnan("flat"), F.col("flat")).otherwise(0.0)).alias("nans"))
    nested = o.select(
        F.col("l_orderkey").alias("order_id"), "most",
        F.struct("least", F.struct((F.lit(0.0) * F.col("most")).alias("product")).alias("deep")).alias("detail"),
        F.transform("lines", lambda x: F.struct(x["inv"].alias("inv"), x["pair"].alias("pair"))).alias("lines"),
        F.create_map(F.lit("most"), F.col("most")).alias("by_name"),
        F.to_variant_object(F.struct("least", F.array("nans").alias("list"))).alias("any"))
    return QC.bad_numbers(nested, keep=["order_id"])


# ---------------------------------------------------------------- Q4

def _answers(spark, sf):
    o = read_table(spark, sf, "orders")
    li = read_table(spark, sf, "lineitem")
    ev = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("s"))
    j = o.join(ev, o.o_orderkey == ev.l_orderkey)
    answer = F.concat(
        F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" of customer "),
        F.col("o_custkey").cast("string"), F.lit(" totals "), F.format_number("o_totalprice", 2),
        F.lit(" over "), F.col("n").cast("string"), F.lit(" lines"),
        F.when(F.col("o_orderpriority") == "1-URGENT",
               F.concat(F.lit(", roughly "), F.floor(F.col("o_totalprice") / 1000).cast("string"),
                        F.lit(" thousand"))).otherwise(F.lit("")))
    evidence = F.concat(
        F.lit("orderkey="), F.col("o_orderkey").cast("string"), F.lit("; lines="), F.col("n").cast("string"),
        F.lit("; extended="), F.format_string("%.2f", F.col("s")),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("; custkey="), F.col("o_custkey").cast("string")))
        .otherwise(F.lit("")),
        F.lit("; total="), F.format_string("%.2f", F.col("o_totalprice")))
    return j.select(F.col("o_orderkey").alias("aid"), answer.alias("answer"), evidence.alias("evidence"))


def _nums_sql(t, floor):
    return (f"list_distinct(list_filter(list_transform(regexp_extract_all(regexp_replace({t}, "
            f"'(\\d+),(\\d+)', '\\1\\2', 'g'), '\\b\\d+\\.?\\d*\\b'), lambda x: round(TRY_CAST(x AS DOUBLE), 2)), "
            f"lambda x: x > {floor}))")


@query("grounding_check", "Q4", sql=f"""
WITH ev AS (SELECT l_orderkey, count(*) AS n, sum(l_extendedprice) AS s FROM lineitem GROUP BY l_orderkey),
a AS (
  SELECT o_orderkey AS aid,
         'Order ' || CAST(o_orderkey AS VARCHAR) || ' of customer ' || CAST(o_custkey AS VARCHAR) || ' totals '
           || format('{{:,.2f}}', o_totalprice) || ' over ' || CAST(n AS VARCHAR) || ' lines'
           || CASE WHEN o_orderpriority = '1-URGENT'
                   THEN ', roughly ' || CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR) || ' thousand'
                   ELSE '' END AS answer,
         'orderkey=' || CAST(o_orderkey AS VARCHAR) || '; lines=' || CAST(n AS VARCHAR)
           || '; extended=' || printf('%.2f', s)
           || CASE WHEN o_orderstatus <> 'P' THEN '; custkey=' || CAST(o_custkey AS VARCHAR) ELSE '' END
           || '; total=' || printf('%.2f', o_totalprice) AS evidence
  FROM orders JOIN ev ON o_orderkey = l_orderkey),
n AS (SELECT aid, {_nums_sql('answer', 10.0)} AS an, {_nums_sql('evidence', -1.0)} AS en FROM a)
SELECT aid, CAST(len(an) AS INTEGER) AS n_numbers,
       CAST(len(list_filter(an, lambda x: NOT list_contains(en, x))) AS INTEGER) AS n_ungrounded,
       len(list_filter(an, lambda x: NOT list_contains(en, x))) = 0 AS grounded
FROM n""")
def grounding_check(spark, sf):
    return QC.grounding(_answers(spark, sf), keep=["aid"])


# ---------------------------------------------------------------- Q5 / Q6

def _scenario_exprs(t="text"):
    """(feature, its new value) in SQL."""
    q = f"lower({t})"
    out = [(f, "CASE " + " ".join(f"WHEN {_any_sql(q, ph)} THEN {_sql_str(v)}" for ph, v in options) + " END") for f, options in TX.SCENARIO_RULES]
    act = _any_sql(q, TX.ACTION_WORDS)
    return out + [(f, f"CASE WHEN {_any_sql(q, ph)} AND {act} THEN 'Yes' END") for f, ph in TX.ADDON_RULES]


def _route_sql(t="text"):
    q = f"replace(lower({t}), '-', ' ')"
    cid = f"nullif(regexp_extract(upper({t}), {_sql_str(TX.ID_PATTERN)}, 1), '')"
    rules = [
        (f"{cid} IS NOT NULL AND {_any_sql(q, TX.WHAT_IF_WORDS)}", "hypothetical", "predict_hypothetical", None),
        (f"{cid} IS NOT NULL", "prediction", "predict_customer_risk", None),
        (_any_sql(q, TX.CORRELATION_WORDS), "eda", "correlation", None),
        (_any_sql(q, TX.MODEL_WORDS), "model_info", "get_model_info", None),
        (f"contains({q}, 'tenure') AND {_any_sql(q, TX.TENURE_TREND_WORDS)}", "eda", "tenure_trend", None),
        (_any_sql(q, TX.TOP_RISK_WORDS), "aggregate", "get_top_risk_customers", None),
        (_any_sql(q, TX.COUNT_WORDS), "dataset_info", "get_dataset_info", None),
    ]
    rules += [(f"contains({q}, {_sql_str(k)})", "eda", "group_by_churn", c) for k, c in TX.SEGMENT_WORDS]
    rules += [
        (_any_sql(q, TX.RATE_WORDS), "eda", "get_churn_rate", None),
        (f"{_any_sql(q, TX.AVERAGE_WORDS)} AND {_any_sql(q, TX.AVERAGE_SPLIT_WORDS)}", "eda", "average_by_churn",
         "MonthlyCharges"),
        (_any_sql(q, TX.AVERAGE_WORDS), "eda", "get_average", "MonthlyCharges"),
    ]

    kinds = ["what_if", "id", "correlation", "model", "tenure_trend", "top_risk", "count", *["segment"] * len(TX.SEGMENT_WORDS),
             "rate", "average_split", "average"]
    rules = [(*r, TX.ROUTE_TARGETS[k][2]) for r, k in zip(rules, kinds, strict=True)]
    fires = "CASE " + " ".join(f"WHEN {r[0]} THEN {i}" for i, r in enumerate(rules)) + " END"
    pairs = [" ".join(f"WHEN contains({q}, {_sql_str(w[0])}) AND contains({q}, {_sql_str(w[1])}) THEN {_sql_str(x[i])}"
                      for w, *x in TX.CORRELATION_PAIRS) for i in (0, 1)]
    one, two = (f"CASE WHEN {fires} = {kinds.index('correlation')} THEN CASE {p} END END" for p in pairs)
    changes = ", ".join(f"{_sql_str(f + '=')} || ({e})" for f, e in _scenario_exprs(t))
    changes = f"CASE WHEN {fires} = 0 THEN array_to_string(list_sort(list_filter([{changes}], lambda x: x IS NOT NULL)), ',') END"

    def case(idx, default):
        parts = [f"WHEN {r[0]} THEN {('NULL' if r[idx] is None else _sql_str(r[idx]))}" for r in rules]
        return "CASE " + " ".join(parts) + f" ELSE {default} END"

    return (f"{case(1, _sql_str('dataset_info'))} AS intent, {case(2, _sql_str('get_dataset_info'))} AS operation, "
            f"CAST({case(3, 'NULL')} AS VARCHAR) AS \"column\", {cid} AS customer_id, "
            f"CAST({case(4, 'NULL')} AS VARCHAR) AS chart, CAST({one} AS VARCHAR) AS col1, CAST({two} AS VARCHAR) AS col2, {changes} AS changes")


@query("route_user_questions", "Q5 Q6", sql=f"""
SELECT conv_id, turn, {_route_sql()} FROM conversations WHERE role = 'user'""")
def route_user_questions(spark, sf):
    c = read_table(spark, sf, "conversations").where(F.col("role") == "user")
    return TJ.route_questions(c, keep=["conv_id", "turn"]).withColumn("changes", _map_text("changes"))


def _scenario_sql(t="text"):
    q = f"lower({t})"
    cols = []
    for feature, options in TX.SCENARIO_RULES:
        whens = " ".join(f"WHEN {_any_sql(q, ph)} THEN {_sql_str(v)}" for ph, v in options)
        cols.append(f"CASE {whens} END AS {feature}")
    act = _any_sql(q, TX.ACTION_WORDS)
    for feature, ph in TX.ADDON_RULES:
        cols.append(f"CASE WHEN {_any_sql(q, ph)} AND {act} THEN 'Yes' END AS {feature}")
    names = [f for f, _ in TX.SCENARIO_RULES] + [f for f, _ in TX.ADDON_RULES]
    n = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END" for c in names)
    return ", ".join(cols), n


_SC_COLS, _SC_N = _scenario_sql()


@query("scenario_extraction", "Q7", sql=f"""
SELECT *, {_SC_N} AS n_changes FROM (
  SELECT conv_id, turn, {_SC_COLS} FROM conversations WHERE role = 'user')""")
def scenario_extraction(spark, sf):
    c = read_table(spark, sf, "conversations").where(F.col("role") == "user")
    return TJ.extract_scenarios(c, keep=["conv_id", "turn"])


# ---------------------------------------------------------------- Q8

@query("recent_context", "Q8", sql="""
WITH pairs AS (
  SELECT conv_id, turn, q, ans FROM (
    SELECT conv_id, turn, role, text AS q, lead(role) OVER w AS next_role, lead(text) OVER w AS ans
    FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role))
  WHERE role = 'user' AND next_role = 'assistant'),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM pairs),
ctx AS (SELECT conv_id, count(*) AS n,
               string_agg('Q: ' || q || chr(10) || 'A: ' || substring(ans, 1, 200) || '...', chr(10) || chr(10)
                          ORDER BY turn) AS c
        FROM r WHERE rn <= 3 GROUP BY conv_id)
SELECT d.conv_id, CAST(coalesce(ctx.n, 0) AS INTEGER) AS n_pairs, coalesce(ctx.c, 'No prior conversation.') AS context
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN ctx ON d.conv_id = ctx.conv_id""")
def recent_context(spark, sf):
    return TJ.recent_context(read_table(spark, sf, "conversations"))


# ---------------------------------------------------------------- Q9

def _strip_sql(x):
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _clean_sql(t="text"):
    ci = lambda p: _sql_str("(?i)" + p)
    x = _strip_sql(f"regexp_replace({t}, {ci(r'<think>[\s\S]*?</think>')}, '', 'g')")
    for p in TX.DISCLAIMER_PATTERNS:
        x = f"regexp_replace({x}, {ci(p)}, '', 'g')"
    steps = [f"t1 AS (SELECT *, {x} AS t FROM src)"]
    fc = TX.FINAL_CHECK_PATTERN
    steps.append(f"t2 AS (SELECT * REPLACE (CASE WHEN regexp_matches(t, {ci(fc)}) "
                 f"THEN {_strip_sql(f'regexp_extract(t, {ci(fc)}, 1)')} ELSE t END AS t) FROM t1)")
    whens = []
    for p in TX.CUTOFF_PATTERNS:
        pre = _strip_sql(f"regexp_extract(t, {ci(r'^([\s\S]*?)' + p)}, 1)")
        whens.append(f"WHEN regexp_matches(t, {ci(p)}) AND length({pre}) > 10 THEN {pre}")
    steps.append(f"t3 AS (SELECT * REPLACE (CASE {' '.join(whens)} ELSE t END AS t) FROM t2)")
    post = _strip_sql(f"regexp_extract(t, {ci(r'^[\s\S]*' + TX.SECTION_MARKER + r'([\s\S]*)$')}, 1)")
    steps.append(f"t4 AS (SELECT * REPLACE (CASE WHEN regexp_matches(t, {ci(TX.SECTION_MARKER)}) "
                 f"AND length({post}) > 20 THEN {post} ELSE t END AS t) FROM t3)")
    s = f"lower({_strip_sql('ln')})"
    drop = " OR ".join(f"starts_with({s}, {_sql_str(w)})" for w in TX.THINKING_STARTERS)
    drop += (f" OR ((starts_with({s}, '- ') OR starts_with({s}, '• ')) AND "
             f"{_any_sql(s, TX.RULE_BULLET_WORDS)}) OR {_any_sql(s, TX.META_PHRASES)}")
    kept = (f"list_transform(list_filter(string_split(t, chr(10)), lambda ln: {s} = '' OR NOT ({drop})), "
            f"lambda ln: CASE WHEN {_strip_sql('ln')} = '' THEN '' ELSE ln END)")
    steps.append(f"t5 AS (SELECT *, {_strip_sql(f'array_to_string({kept}, chr(10))')} AS r FROM t4)")
    quoted = _strip_sql("regexp_extract(r, '^\"([\\s\\S]*)\"$', 1)")
    steps.append(f"t6 AS (SELECT * REPLACE (CASE WHEN starts_with(r, '\"') AND ends_with(r, '\"') "
                 f"THEN {quoted} ELSE r END AS r) FROM t5)")
    return ",\n".join(steps)


@query("clean_assistant_answers", "Q9", sql="WITH src AS (SELECT conv_id, turn, text FROM conversations "
       "WHERE role = 'assistant'),\n" + _clean_sql() +
       "\nSELECT conv_id, turn, CASE WHEN r = '' THEN t ELSE r END AS cleaned FROM t6")
def clean_assistant_answers(spark, sf):
    c = read_table(spark, sf, "conversations").where(F.col("role") == "assistant")
    return TJ.clean_answers(c, keep=["conv_id", "turn"])


# ---------------------------------------------------------------- Q10 / Q11

def _numbered(spark, sf, texts):
    """One text per order, in turn; {n} is the order's number, {id} an id of
    the customer's."""
    o = read_table(spark, sf, "orders")
    text = F.element_at(F.array(*map(F.lit, texts)), (F.col("o_orderkey") % len(texts) + 1).cast("int"))
    cid = F.concat(F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0"), F.lit("-ABCDE"))
    text = F.replace(F.replace(text, F.lit("{n}"), F.col("o_orderkey").cast("string")), F.lit("{id}"), cid)
    return o.select(F.col("o_orderkey").alias("qid"), text.alias("text"))


def _expected(columns: str, rows) -> str:
    """DuckDB rows of the expected results, written out by hand for each text."""
    def lit(v):
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else _sql_str(v)

    values = ", ".join("(" + ", ".join([str(i), *map(lit, r)]) + ")" for i, r in enumerate(rows))
    return f"e(i, {columns}) AS (VALUES {values})"


_N = "CAST(o_orderkey AS VARCHAR)"
_ID = "lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') || '-ABCDE'"

# (plan, parsed, has_intent, has_steps, steps_is_list, n_steps, without tool, without params, empty warning, passed)
PLANS = [
    ('{"intent":"eda","steps":[{"tool":"t","params":{}}]}', True, True, True, True, 1, 0, 0, False, True),
    ('{"intent":"eda","steps":[]}', True, True, True, True, 0, 0, 0, True, True),
    ('{"intent":"unanswerable","steps":[]}', True, True, True, True, 0, 0, 0, False, True),
    ('{"steps":[{"params":{"n":{n}}}]}', True, False, True, True, 1, 1, 0, False, False),
    ('{"intent":"eda","steps":[{"tool":"t"},{"tool":"u","params":{"n":{n}}}]}', True, True, True, True, 2, 0, 1, False, True),
    ('{"intent":"eda","steps":[{}, {"tool":"t"}]}', True, True, True, True, 2, 1, 2, False, False),
    ('{"intent":"eda","steps":{"tool":"t"}}', True, True, True, False, None, None, None, False, False),
    ('{"intent":"eda"}', True, True, False, False, None, None, None, False, False),
    ("no plan {n}", False, False, False, False, None, None, None, False, False),
]


@query("plan_checks", "Q10", sql="WITH " + _expected(
    "parsed, has_intent, has_steps, steps_is_list, n_steps, n_steps_without_tool, n_steps_without_params, "
    "empty_plan_warning, passed", [r[1:] for r in PLANS]) + f"""
SELECT o_orderkey AS qid, e.* EXCLUDE (i) FROM orders JOIN e ON i = o_orderkey % {len(PLANS)}""")
def plan_checks(spark, sf):
    plans = _numbered(spark, sf, [r[0] for r in PLANS]).withColumnRenamed("text", "plan_json")
    return QC.plan_checks(plans, keep=["qid"])


#: Chart of the second step of a plan, by operation.
_CHARTS = {
    "correlation": "correlation_heatmap", "get_model_info": "feature_importance", "tenure_trend": "tenure_trend",
    "get_top_risk_customers": "top_risk_customers", "group_by_churn": "churn_by_column", "get_churn_rate": "churn_distribution",
    "average_by_churn": "monthly_charges_by_churn", "get_average": "monthly_charges_by_churn",
}
_CHART_SQL = f"CASE operation {' '.join(f'WHEN {_sql_str(o)} THEN {_sql_str(c)}' for o, c in _CHARTS.items())} END"


def _without_sql(key):
    return f"len(list_filter(json_extract(plan_json, '$.steps[*]'), lambda x: json_extract(x, '$.{key}') IS NULL))"


@query("plan_checks_documents", "Q10", sql=f"""
WITH routed AS (SELECT conv_id, turn, {_route_sql()} FROM conversations WHERE role = 'user'),
charted AS (SELECT *, {_CHART_SQL} AS chart FROM routed),
s AS (
  SELECT conv_id, turn, intent, chart,
         json_object('tool', operation, 'params', json_object('column', "column", 'customer_id', customer_id)) AS one,
         json_object('tool', 'generate_chart', 'params', json_object('chart_type', chart, 'column', "column")) AS two
  FROM charted),
p AS (
  SELECT 'conv-' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS plan_id,
         CAST(json_object('intent', intent, 'steps', CASE WHEN chart IS NULL THEN json_array(one) ELSE json_array(one, two) END)
              AS VARCHAR) AS plan_json
  FROM s
  UNION ALL SELECT 'event-' || CAST(event_id AS VARCHAR), props FROM events),
c AS (
  SELECT plan_id, coalesce(json_valid(plan_json), false) AS parsed,
         parsed AND json_extract_string(plan_json, '$.intent') IS NOT NULL AS has_intent,
         parsed AND json_extract(plan_json, '$.steps') IS NOT NULL AS has_steps,
         parsed AND coalesce(json_type(plan_json, '$.steps') = 'ARRAY', false) AS steps_is_list,
         json_extract_string(plan_json, '$.intent') AS intent, plan_json
  FROM p)
SELECT plan_id, parsed, has_intent, has_steps, steps_is_list,
       CASE WHEN steps_is_list THEN CAST(json_array_length(plan_json, '$.steps') AS INTEGER) END AS n_steps,
       CASE WHEN steps_is_list THEN CAST({_without_sql('tool')} AS INTEGER) END AS n_steps_without_tool,
       CASE WHEN steps_is_list THEN CAST({_without_sql('params')} AS INTEGER) END AS n_steps_without_params,
       steps_is_list AND json_array_length(plan_json, '$.steps') = 0 AND coalesce(intent, '') <> 'unanswerable'
         AS empty_plan_warning,
       has_intent AND has_steps AND steps_is_list AND coalesce(CASE WHEN steps_is_list THEN {_without_sql('tool')} END, 0) = 0
         AS passed
FROM c""")
def plan_checks_documents(spark, sf):
    """The plan routed from every user turn, and the properties of every event."""
    c = read_table(spark, sf, "conversations").where(F.col("role") == "user")
    c = c.withColumn("plan_id", F.concat(F.lit("conv-"), F.col("conv_id").cast("string"), F.lit("-"),
                                         F.col("turn").cast("string")))
    plans = TJ.plan_json(TJ.route_questions(c, keep=["plan_id"]), keep=["plan_id"])
    ev = read_table(spark, sf, "events").select(
        F.concat(F.lit("event-"), F.col("event_id").cast("string")).alias("plan_id"), F.col("props").alias("plan_json"))
    return QC.plan_checks(plans.unionByName(ev), keep=["plan_id"])


# (question, intent, operation, column, chart, col1, col2, names an id, changes)
QUESTIONS = [
    ("What if {id} changes to a two year contract with tech support?", "hypothetical", "predict_hypothetical", None, None, None,
     None, True, "Contract=Two year,TechSupport=Yes"),
    ("Please switch {id} to mailed check", "hypothetical", "predict_hypothetical", None, None, None, None, True,
     "PaymentMethod=Mailed check"),
    ("Predict the risk of {id}", "prediction", "predict_customer_risk", None, None, None, None, True, None),
    ("Correlation of tenure and monthly charges", "eda", "correlation", None, "correlation_heatmap", "tenure", "MonthlyCharges",
     False, None),
    ("How does tenure relate to total charges?", "eda", "correlation", None, "correlation_heatmap", "tenure", "TotalCharges", False, None),
    ("Heatmap of monthly and total charges", "eda", "correlation", None, "correlation_heatmap", "MonthlyCharges", "TotalCharges",
     False, None),
    ("Is there any association?", "eda", "correlation", None, "correlation_heatmap", None, None, False, None),
    ("Which accuracy did we get?", "model_info", "get_model_info", None, "feature_importance", None, None, False, None),
    ("Tenure trend {n}", "eda", "tenure_trend", None, "tenure_trend", None, None, False, None),
    ("Who is at risk now?", "aggregate", "get_top_risk_customers", None, "top_risk_customers", None, None, False, None),
    ("How many customers are there?", "dataset_info", "get_dataset_info", None, None, None, None, False, None),
    ("count of contract types", "dataset_info", "get_dataset_info", None, None, None, None, False, None),
    ("Split by contract type", "eda", "group_by_churn", "Contract", "churn_by_column", None, None, False, None),
    ("payments by mailed check", "eda", "group_by_churn", "PaymentMethod", "churn_by_column", None, None, False, None),
    ("online-security and partners", "eda", "group_by_churn", "Partner", "churn_by_column", None, None, False, None),
    ("only online-security", "eda", "group_by_churn", "OnlineSecurity", "churn_by_column", None, None, False, None),
    ("internet, gender or senior", "eda", "group_by_churn", "InternetService", "churn_by_column", None, None, False, None),
    ("paperless or dependents", "eda", "group_by_churn", "Dependents", "churn_by_column", None, None, False, None),
    ("What is the churn rate?", "eda", "get_churn_rate", None, "churn_distribution", None, None, False, None),
    ("Average bill, churned against others", "eda", "average_by_churn", "MonthlyCharges", "monthly_charges_by_churn", None, None,
     False, None),
    ("What is the mean bill?", "eda", "get_average", "MonthlyCharges", "monthly_charges_by_churn", None, None, False, None),
    ("Hello there {n}", "dataset_info", "get_dataset_info", None, None, None, None, False, None),
]


@query("route_order_questions", "Q5 Q6", sql="WITH " + _expected(
    "intent, operation, \"column\", chart, col1, col2, has_id, changes", [r[1:] for r in QUESTIONS]) + f"""
SELECT o_orderkey AS qid, intent, operation, "column", CASE WHEN has_id THEN {_ID} END AS customer_id, chart, col1, col2, changes
FROM orders JOIN e ON i = o_orderkey % {len(QUESTIONS)}""")
def route_order_questions(spark, sf):
    """Every routing rule, on questions that name the orders' customers."""
    out = TJ.route_questions(_numbered(spark, sf, [r[0] for r in QUESTIONS]), keep=["qid"])
    return out.withColumn("changes", _map_text("changes"))


def _map_text(name):
    entries = F.transform(F.map_entries(name), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.when(F.col(name).isNotNull(), F.array_join(F.array_sort(entries), ","))


# (question, changes)
SCENARIO_TEXTS = [
    ("switch to a two-year contract paid by credit card with tech support",
     "Contract=Two year,PaymentMethod=Credit card (automatic),TechSupport=Yes"),
    ("one year and fiber", "Contract=One year,InternetService=Fiber optic"),
    ("month to month, mailed check, add online backup and device protection",
     "Contract=Month-to-month,DeviceProtection=Yes,OnlineBackup=Yes,PaymentMethod=Mailed check"),
    ("Electronic check and DSL", "InternetService=DSL,PaymentMethod=Electronic check"),
    ("bank transfer; get online security", "OnlineSecurity=Yes,PaymentMethod=Bank transfer (automatic)"),
    ("tech support only", ""),
    ("2 year or 1 year", "Contract=Two year"),
    ("nothing here {n}", ""),
]


@query("scenario_order_questions", "Q7", sql="WITH " + _expected("changes", [r[1:] for r in SCENARIO_TEXTS]) + f"""
SELECT o_orderkey AS qid, changes FROM orders JOIN e ON i = o_orderkey % {len(SCENARIO_TEXTS)}""")
def scenario_order_questions(spark, sf):
    texts = _numbered(spark, sf, [r[0] for r in SCENARIO_TEXTS])
    return texts.withColumn("changes", TX.scenario_map(F.col("text"))).select("qid", _map_text("changes").alias("changes"))


# (answer, cleaned)
ANSWERS = [
    ("<think>secret plan</think>The churn rate of {n} is 26.54%. (as returned by the model)", "The churn rate of {n} is 26.54%."),
    ("Draft: something short\nFinal Answer: The churn rate is 26.54% across {n} customers.",
     "The churn rate is 26.54% across {n} customers."),
    ("The user wants numbers.\nI need to check.\nChurn is {n}%.\n- 50 customers now", "Churn is {n}%.\n- 50 customers now"),
    ("The user asked.", "The user asked."),
    ('"Quoted answer {n} here"', "Quoted answer {n} here"),
    ("Answer body {n} is long enough\nCheck against rules: fine", "Answer body {n} is long enough"),
    ('Final check of the text: "It is {n}."\nmore', "It is {n}."),
    ("- quote specific numbers\nResult {n}", "Result {n}"),
    ("It is {n}, this follows all rules\nKept line", "Kept line"),
    ("Source: `get_info` result. Total {n}", "Total {n}"),
    ("Value {n}\n\n  \nNext", "Value {n}\n\n\nNext"),
    ("  plain {n}\t", "plain {n}"),
]


@query("clean_order_answers", "Q9", sql="WITH " + _expected("cleaned", [r[1:] for r in ANSWERS]) + f"""
SELECT o_orderkey AS qid, replace(cleaned, '{{n}}', {_N}) AS cleaned FROM orders JOIN e ON i = o_orderkey % {len(ANSWERS)}""")
def clean_order_answers(spark, sf):
    return TJ.clean_answers(_numbered(spark, sf, [r[0] for r in ANSWERS]), keep=["qid"])


# (text, where it was found, document)
JSON_TEXTS = [
    ('  {"k": {n}, "a": 1}\n', "whole", '{"a":1,"k":{n}}'),
    ('Here:\n```json\n{"k": {n}, "steps": [{"tool": "t"}]}\n```', "fence", '{"k":{n},"steps":[{"tool":"t"}]}'),
    ("x ```\n[1, {n}]\n``` y", "fence", "[1,{n}]"),
    ('prefix {"k": {n}} suffix', "braces", '{"k":{n}}'),
    ('```json\n{broken}\n``` or {"k": {n}}', None, None),
    ("{not json {n}", None, None),
    ("no document at all", None, None),
]


@query("json_order_texts", "Q11", sql="WITH " + _expected("source, json", [r[1:] for r in JSON_TEXTS]) + f"""
SELECT o_orderkey AS qid, source, replace(json, '{{n}}', {_N}) AS json FROM orders JOIN e ON i = o_orderkey % {len(JSON_TEXTS)}""")
def json_order_texts(spark, sf):
    return TJ.extract_json_blocks(_numbered(spark, sf, [r[0] for r in JSON_TEXTS]), keep=["qid"])


@query("json_extraction", "Q11", sql="""
WITH src AS (
  SELECT 'event-' || CAST(event_id AS VARCHAR) AS doc_id, props AS text FROM events
  UNION ALL SELECT 'conv-' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), text FROM conversations),
x AS (
  SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS whole,
         nullif(regexp_extract(text, '```(?:json)?\\s*([\\s\\S]+?)\\s*```', 1), '') AS fence,
         nullif(regexp_extract(text, '\\{[\\s\\S]+\\}', 0), '') AS braces
  FROM src)
SELECT doc_id,
       CASE WHEN json_valid(whole) THEN 'whole' WHEN json_valid(fence) THEN 'fence'
            WHEN json_valid(braces) THEN 'braces' END AS source,
       TRY_CAST(json_extract(CASE WHEN json_valid(whole) THEN whole WHEN json_valid(fence) THEN fence
                                  WHEN json_valid(braces) THEN braces END, '$.k') AS BIGINT) AS k
FROM x""")
def json_extraction(spark, sf):
    ev = read_table(spark, sf, "events").select(
        F.concat(F.lit("event-"), F.col("event_id").cast("string")).alias("doc_id"), F.col("props").alias("text"))
    cv = read_table(spark, sf, "conversations").select(
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
        .alias("doc_id"), "text")
    v, source = TX.extract_json(F.col("text"))
    return ev.unionByName(cv).select("doc_id", source.alias("source"),
                                     F.try_variant_get(v, "$.k", "bigint").alias("k"))
