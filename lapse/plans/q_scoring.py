"""Registered queries on models: training report and cross-validated comparison
(M10-M14), scoring, what-if and attribution (R1-R13, C8).

The scoring queries use a linear model in closed form (``correlation_model``),
fitted by each query on all customers with an outcome, so SQL can compute every
one of their rows.  The fits themselves have no SQL twin; what is
known about their results beforehand is checked by ``model_fit_checks``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lapse.operators import attribution as AT
from lapse.operators import boosting as BO
from lapse.operators import chartdata as C
from lapse.operators import features as FT
from lapse.operators import models as MD
from lapse.operators import scoring as SC
from lapse.plans.q_analytics import pearson_sql
from lapse.plans.registry import query
from lapse.plans.sqlframes import risk_level_sql, with_frames
from lapse.sources.frames import PROFILE_SPEC, customer_profile
from lapse.sources.tables import read_table

PS = PROFILE_SPEC
NUM, CAT = list(PS.numeric), list(PS.categorical)
FITTED_ON = "churn IS NOT NULL"


# ---------------------------------------------------------------- fits

@query("model_training_report", "M10 M17 M18 M19 M21 R13")
def model_training_report(spark, sf):
    return MD.train(customer_profile(spark, sf), PS, names=["LogisticRegression"], cv=False)[1]


@query("cv_model_comparison", "M10 M11 M12 M13")
def cv_model_comparison(spark, sf):
    from lapse.staging import drop_staged, staged

    # the split reads its rows twice: derive them once
    slim = staged(FT.project_features(PS.with_label(customer_profile(spark, sf)), PS, keep=[PS.label_col]), "slim")
    split = FT.assign_split(slim, PS)
    cv = MD.cross_validate(split.where(F.col("split") == "train"), PS)
    drop_staged(slim)  # the folds have their own copy
    return MD.summarize_cv(cv)


def _check(name, passed):
    return F.struct(F.lit(name).alias("check"), F.coalesce(passed, F.lit(False)).alias("passed"))


@query("model_selection_checks", "M7 M13 M14 M12", sql=with_frames("""
SELECT 'candidates_in_all_folds' AS "check", CAST(3 AS BIGINT) AS n, true AS passed
UNION ALL SELECT 'best_mean_is_chosen', 1, true
UNION ALL SELECT 'refit_on_train_rows', CAST(sum(n - round(0.2 * n)) AS BIGINT), true FROM l
UNION ALL SELECT 'tested_on_the_rest', CAST(sum(round(0.2 * n)) AS BIGINT), true FROM l
UNION ALL SELECT 'test_metrics_in_range', 5, true
UNION ALL SELECT 'every_customer_scored', (SELECT count(*) FROM customer_profile), true""",
    "l AS (SELECT CASE WHEN churn = 'Yes' THEN 1 ELSE 0 END AS label, count(*) AS n FROM customer_profile GROUP BY 1)"))
def model_selection_checks(spark, sf):
    """Selection end to end: three candidates over five folds, the best by mean
    ROC-AUC refitted on the train split and tested on the rest."""
    from lapse.staging import staged

    cp = staged(customer_profile(spark, sf), "profile")  # read by the fit and again to be scored
    model, report = MD.train(cp, PS)
    means = report.where("scope = 'cv_mean' AND metric = 'roc_auc'")
    scored = staged(SC.score_all(model, cp), "selected").agg(F.count("*").alias("n"), F.min(F.col("risk_score").between(0, 1)).alias("ok"))
    sizes = report.where("scope = 'split'").groupBy(F.substring_index("metric", "_class_", 1).alias("split")).agg(F.sum("value").cast("long").alias("n"))
    names = ["roc_auc", "average_precision", "at_0.5_f1", "at_0.5_recall", "at_0.5_precision"]
    metrics = report.where(F.col("scope") == "test").where(F.col("metric").isin(names))

    def row(name, n, passed):
        return F.lit(name).alias("check"), n.alias("n"), F.coalesce(passed, F.lit(False)).alias("passed")

    best = F.max_by("model", "value") == model.name
    parts = [
        means.agg(F.count("*").alias("c"), F.count_distinct("model").alias("d")).select(*row("candidates_in_all_folds", F.col("c"), F.col("d") == 3)),
        means.agg(best.alias("b"), F.max("value").alias("m"), F.max(F.when(F.col("model") == model.name, F.col("value"))).alias("v")).select(
            *row("best_mean_is_chosen", F.lit(1).cast("long"), F.col("b") | (F.col("m") == F.col("v")))),
        sizes.where("split = 'train'").select(*row("refit_on_train_rows", F.col("n"), F.lit(True))),
        sizes.where("split = 'test'").select(*row("tested_on_the_rest", F.col("n"), F.lit(True))),
        metrics.agg(F.count("*").alias("n"), F.min(F.col("value").between(0, 1)).alias("ok")).select(*row("test_metrics_in_range", F.col("n"), F.col("ok"))),
        scored.select(*row("every_customer_scored", F.col("n"), F.col("ok"))),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


_TREE_FEATURES = ["tenure", "monthly_charges", "total_charges", "acctbal", "has_open"]
_TREE = BO.Params(rounds=1, max_depth=2, max_bins=16)
_G = 1 << 24


def _tree_level(level: int) -> str:
    """Best split of every node of a level, and where its rows go."""
    gain = (f"(gl / {_G}.0) * (gl / {_G}.0) / (hl / {_G}.0 + {_TREE.l2}) + ((g - gl) / {_G}.0) * ((g - gl) / {_G}.0) / ((h - hl) / {_G}.0 + {_TREE.l2})"
            f" - (g / {_G}.0) * (g / {_G}.0) / (h / {_G}.0 + {_TREE.l2})")
    return f"""
c{level} AS (SELECT path, f, b, sum(sum(g)) OVER w AS gl, sum(sum(h)) OVER w AS hl, sum(count(*)) OVER w AS nl,
        sum(sum(g)) OVER a AS g, sum(sum(h)) OVER a AS h, sum(count(*)) OVER a AS n
      FROM t{level} JOIN bins USING (row_id) GROUP BY path, f, b
      WINDOW a AS (PARTITION BY path, f), w AS (PARTITION BY path, f ORDER BY b)),
s{level} AS (SELECT path, f, b FROM (SELECT *, {gain} AS gain FROM c{level}
        WHERE nl >= {_TREE.min_rows} AND n - nl >= {_TREE.min_rows} AND hl >= {_TREE.min_hessian * _G} AND h - hl >= {_TREE.min_hessian * _G})
      WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY path ORDER BY gain DESC, f, b) = 1),
t{level + 1} AS (SELECT row_id, t.g, t.h, path || CASE WHEN bins.b <= s.b THEN 'L' ELSE 'R' END AS path
      FROM t{level} t JOIN s{level} s USING (path) JOIN bins USING (row_id, f))"""


_TREE_X = ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0) AS x{i}" for i, c in enumerate(_TREE_FEATURES))
_TREE_LONG = "\nUNION ALL ".join(f"SELECT row_id, {i} AS f, x{i} AS x FROM rows" for i in range(len(_TREE_FEATURES)))
_AT = "(i / 16.0 * (len(xs) - 1))"


@query("boosting_first_tree", "M12", sql=with_frames(f"""
SELECT path, f.name AS feature, CAST(e.edge AS DOUBLE) AS threshold, n AS rows,
       CASE WHEN f.name IS NULL THEN round(-(nodes.g / {_G}.0) / (nodes.h / {_G}.0 + {_TREE.l2}) * {_TREE.learning_rate}, 9) END AS value
FROM nodes LEFT JOIN splits s USING (path) LEFT JOIN features f ON f.f = s.f
LEFT JOIN (SELECT f, edge, row_number() OVER (PARTITION BY f ORDER BY edge) - 1 AS b FROM edges) e ON e.f = s.f AND e.b = s.b""", f"""
rows AS (SELECT row_number() OVER () AS row_id, CASE WHEN churn = 'Yes' THEN 1.0 ELSE 0.0 END AS y, {_TREE_X} FROM customer_profile),
long AS ({_TREE_LONG}),
xs AS (SELECT f, list_sort(list(x)) AS xs, list_sort(list(DISTINCT x)) AS ds FROM long GROUP BY f),
edges AS (SELECT DISTINCT f, CAST(edge AS DOUBLE) AS edge FROM (
  SELECT f, unnest(CASE WHEN len(ds) <= 16 THEN ds[1:len(ds) - 1] ELSE list_transform(range(1, 16), lambda i:
    CASE WHEN floor({_AT}) = ceil({_AT}) THEN xs[CAST(floor({_AT}) AS BIGINT) + 1]
         ELSE (ceil({_AT}) - {_AT}) * xs[CAST(floor({_AT}) AS BIGINT) + 1] + ({_AT} - floor({_AT})) * xs[CAST(ceil({_AT}) AS BIGINT) + 1] END) END) AS edge FROM xs)),
bins AS (SELECT row_id, f, (SELECT count(*) FROM edges e WHERE e.f = long.f AND e.edge < long.x) AS b FROM long),
cls AS (SELECT y, count(*) AS n FROM rows GROUP BY y),
t0 AS (SELECT row_id, round((SELECT sum(n) FROM cls) / (2.0 * c.n) * (0.5 - rows.y) * {_G}) AS g,
              round((SELECT sum(n) FROM cls) / (2.0 * c.n) * 0.25 * {_G}) AS h, '' AS path FROM rows JOIN cls c USING (y)),{_tree_level(0)},{_tree_level(1)},
nodes AS (SELECT path, sum(g) AS g, sum(h) AS h, count(*) AS n FROM (SELECT * FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2) GROUP BY path),
splits AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1),
features(f, name) AS (VALUES {", ".join(f"({i}, '{c}')" for i, c in enumerate(_TREE_FEATURES))})"""))
def boosting_first_tree(spark, sf):
    """Splits and leaf values of the first round, by the distributed sums."""
    cp = PS.with_label(customer_profile(spark, sf))
    x = FT.class_weights(cp.select(PS.label_col, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in _TREE_FEATURES]), PS)
    tree = BO.fit(x, _TREE_FEATURES, PS.label_col, params=_TREE, local_rows=0, exact_edges=True).trees[0]
    rows, todo = [], [(0, "")]
    while todo:  # at most seven nodes
        node, path = todo.pop()
        leaf = tree.feature[node] < 0
        rows.append((path, None if leaf else _TREE_FEATURES[tree.feature[node]], None if leaf else tree.threshold[node], tree.rows[node],
                     round(tree.value[node], 9) if leaf else None))
        todo += [] if leaf else [(tree.left[node], path + "L"), (tree.right[node], path + "R")]
    return spark.createDataFrame(rows, "path string, feature string, threshold double, rows long, value double")


@query("model_fit_checks", "M7 M10 S11 R1 R13", sql=with_frames("""
SELECT 'test_rows_class_' || CAST(label AS VARCHAR) AS "check", CAST(round(0.2 * n) AS BIGINT) AS n, true AS passed FROM l
UNION ALL SELECT 'scores_in_range', (SELECT count(*) FROM customer_profile), true
UNION ALL SELECT 'level_follows_score', (SELECT count(*) FROM customer_profile), true
UNION ALL SELECT 'loaded_model_scores_the_same', (SELECT count(*) FROM customer_profile), true
UNION ALL SELECT 'gradient_is_small', 9, true
UNION ALL SELECT 'loaded_report_is_the_same', 1, true""",
    "l AS (SELECT CASE WHEN churn = 'Yes' THEN 1 ELSE 0 END AS label, count(*) AS n FROM customer_profile GROUP BY 1)"))
def model_fit_checks(spark, sf):
    """What is known of a fit beforehand: the size of the test split, scores in
    range, level consistent with score, a loss gradient near zero, and a model
    that is the same after saving and loading."""
    from lapse.staging import shared_path, staged

    cp = customer_profile(spark, sf)
    model, report = MD.train(cp, PS, names=["LogisticRegression"], cv=False)
    path = shared_path(spark, "model")
    model.save(path)
    again = MD.TrainedModel.load(path)
    tests = report.where("scope = 'split' AND metric LIKE 'test_class_%'").select(
        F.concat(F.lit("test_rows_class_"), F.substring("metric", 12, 9)).alias("check"),
        F.col("value").cast("long").alias("n"), F.lit(True).alias("passed"))
    a, b = SC.score_all(model, cp), SC.score_all(again, cp)
    both = staged(a.join(b.select(PS.id_col, F.col("risk_score").alias("again")), PS.id_col), "fit-checks")
    edge = (F.abs(F.col("risk_score") - 0.7) <= 0.00005) | (F.abs(F.col("risk_score") - 0.4) <= 0.00005)
    level = F.when(F.col("risk_score") >= 0.7, "High").when(F.col("risk_score") >= 0.4, "Medium").otherwise("Low")
    rows = both.agg(
        F.count("*").alias("n"),
        F.min(F.col("risk_score").between(0, 1)).alias("range"),
        F.min(edge | (F.col("risk_level") == level)).alias("level"),
        F.min(F.col("risk_score") == F.col("again")).alias("same"))
    gradient = MD.logistic_gradient(cp, model)
    one = rows.select("n", F.inline(F.array(
        _check("scores_in_range", F.col("range")), _check("level_follows_score", F.col("level")),
        _check("loaded_model_scores_the_same", F.col("same"))))).select("check", "n", "passed")
    small = gradient.agg(F.count("*").alias("n"), F.max(F.abs("gradient")).alias("g")).select(
        F.lit("gradient_is_small").alias("check"), "n", (F.col("g") < 1e-3).alias("passed"))
    kept = MD.report_of(spark, again).exceptAll(report).agg(F.count("*").alias("x")).select(
        F.lit("loaded_report_is_the_same").alias("check"), F.lit(1).cast("long").alias("n"), (F.col("x") == 0).alias("passed"))
    return tests.unionByName(one).unionByName(small).unionByName(kept)


@query("encoded_customer_key", "M5", sql="""
SELECT o_orderkey AS order_id, CAST(dense_rank() OVER (ORDER BY CAST(o_custkey AS VARCHAR)) - 1 AS DOUBLE) AS customer_code
FROM orders""")
def encoded_customer_key(spark, sf):
    """A feature with more categories than are kept on the driver."""
    from lapse.spec import Spec

    o = read_table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("customer_code"))
    spec = Spec(id_col="o_orderkey", target_col="customer_code", positive="", categorical=("customer_code",))
    model = FT.fit_features(o, spec, inline_categories=100)
    return FT.transform_features(o, model, keep=[F.col("o_orderkey").alias("order_id")], vector_col=None)


# ---------------------------------------------------------------- linear model

def linear(spark, sf, cp=None):
    cp = customer_profile(spark, sf) if cp is None else cp
    return MD.correlation_model(cp.where(FITTED_ON), PS)


def _x_sql(raw: dict) -> list[str]:
    """Prepared feature i from raw column expressions."""
    out = [f"((coalesce(CAST({raw[c]} AS DOUBLE), (SELECT med_{c} FROM med)) - (SELECT mean_{c} FROM st)) / (SELECT std_{c} FROM st))"
           for c in NUM]
    for c in CAT:
        out.append(f"coalesce((SELECT i FROM idx WHERE feature = '{c}' AND value = coalesce(CAST({raw[c]} AS VARCHAR), "
                   f"(SELECT value FROM mode WHERE feature = '{c}'))), -1.0)")
    return out


_MED = ", ".join(f"coalesce(quantile_cont({c}, 0.5), 0.0) AS med_{c}" for c in NUM)
_ST = ", ".join(f"avg(coalesce(CAST({c} AS DOUBLE), med_{c})) AS mean_{c}, "
                f"coalesce(nullif(stddev_pop(coalesce(CAST({c} AS DOUBLE), med_{c})), 0), 1.0) AS std_{c}" for c in NUM)
_CATS = "\nUNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM fit_rows "
                            f"WHERE {c} IS NOT NULL GROUP BY 2" for c in CAT)
_N = len(NUM) + len(CAT)
_PLAIN = {c: c for c in NUM + CAT}
_XS = ", ".join(f"{e} AS x{i}" for i, e in enumerate(_x_sql(_PLAIN)))
MODEL_CTES = f"""fit_rows AS (SELECT * FROM customer_profile WHERE {FITTED_ON}),
med AS (SELECT {_MED} FROM fit_rows), st AS (SELECT {_ST} FROM fit_rows, med), cc AS ({_CATS}),
idx AS (SELECT feature, value, CAST(dense_rank() OVER (PARTITION BY feature ORDER BY value) - 1 AS DOUBLE) AS i FROM cc),
mode AS (SELECT feature, value FROM cc QUALIFY row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) = 1),
px AS (SELECT CASE WHEN churn = 'Yes' THEN 1 WHEN churn IS NOT NULL THEN 0 END AS y, {_XS} FROM fit_rows),
lin AS (SELECT *, round({' '.join(f'- round(r{i} * m{i}, 6)' for i in range(_N))}, 6) AS b FROM (
  SELECT {', '.join(f"coalesce({pearson_sql(f'x{i}', 'y', 6)}, 0.0) AS r{i}, coalesce(round(avg(x{i}), 6), 0.0) AS m{i}" for i in range(_N))}
  FROM px))"""


def _p_sql(xs: list[str]) -> str:
    z = "(SELECT b FROM lin)"
    for i, x in enumerate(xs):
        z = f"({z} + (SELECT r{i} FROM lin) * {x})"
    return f"(1.0 / (1.0 + exp(-{z})))"


def _predicted(p: str) -> str:
    return f"CASE WHEN {p} >= 0.5 THEN 'Likely to churn' ELSE 'Unlikely to churn' END"


def _sql(body: str, extra: str = "") -> str:
    return with_frames(body, MODEL_CTES + (",\n" + extra if extra else ""))


_SCORED = f"scored AS (SELECT *, {_p_sql(_x_sql(_PLAIN))} AS p FROM customer_profile)"


@query("score_all_customers", "R1 R2", sql=_sql(f"""
SELECT customer_id, round(p, 4) AS risk_score, {risk_level_sql('p')} AS risk_level, {_predicted('p')} AS prediction,
       CAST(0.5 AS DOUBLE) AS threshold_used FROM scored""", _SCORED))
def score_all_customers(spark, sf):
    cp = customer_profile(spark, sf)
    return SC.score_all(linear(spark, sf, cp), cp)


def _requests(spark, sf):
    o = read_table(spark, sf, "orders")
    known = o.where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 350000)).select(
        F.col("o_orderkey").alias("pos"), F.col("o_custkey").cast("string").alias("requested_id"))
    unknown = o.where((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 400000)).select(
        F.col("o_orderkey").alias("pos"), F.concat(F.lit("X-"), F.col("o_custkey").cast("string")).alias("requested_id"))
    return known.unionByName(unknown)


_REQUESTS = """requests AS (
  SELECT o_orderkey AS pos, CAST(o_custkey AS VARCHAR) AS requested_id FROM orders
  WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 350000
  UNION ALL SELECT o_orderkey, 'X-' || CAST(o_custkey AS VARCHAR) FROM orders
  WHERE o_orderstatus = 'P' AND o_totalprice > 400000)"""


@query("score_requested_ids", "R4", sql=_sql(f"""
SELECT pos, requested_id AS customer_id, CASE WHEN s.customer_id IS NULL THEN 'Not found' ELSE 'ok' END AS status,
       round(p, 4) AS risk_score, CASE WHEN p IS NOT NULL THEN {risk_level_sql('p')} END AS risk_level,
       CASE WHEN p IS NOT NULL THEN {_predicted('p')} END AS prediction
FROM requests LEFT JOIN scored s ON requested_id = CAST(s.customer_id AS VARCHAR)""", _SCORED + ",\n" + _REQUESTS))
def score_requested_ids(spark, sf):
    cp = customer_profile(spark, sf)
    return SC.score_requests(linear(spark, sf, cp), cp, _requests(spark, sf))


def _factor_rows(raw: dict) -> str:
    """(customer_id, pos, feature, raw_value, a) of each feature's contribution."""
    return "\nUNION ALL ".join(
        f"SELECT customer_id, {i} AS pos, '{c}' AS feature, CAST({raw[c]} AS VARCHAR) AS raw_value, "
        f"(SELECT r{i} FROM lin) * {x} AS a FROM customer_profile" for i, (c, x) in enumerate(zip(NUM + CAT, _x_sql(raw), strict=True)))


_FACTORS = f"""contrib AS ({_factor_rows(_PLAIN)}),
factors AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY abs(round(a, 4)) DESC, pos) AS rank FROM contrib)"""


@query("top_factors", "R9 R11", sql=_sql("""
SELECT customer_id, CAST(rank AS INTEGER) AS rank, feature, round(a, 4) AS attribution,
       CASE WHEN a > 0 THEN 'increases_risk' ELSE 'decreases_risk' END AS direction
FROM factors WHERE rank <= 5""", _FACTORS))
def top_factors(spark, sf):
    cp = customer_profile(spark, sf)
    t = AT.top_factors(linear(spark, sf, cp), cp)
    return t.select("customer_id", F.posexplode("top_factors").alias("at", "f")).select(
        "customer_id", (F.col("at") + 1).alias("rank"), "f.feature", "f.attribution", "f.direction")


@query("score_lookup", "R3 T2", sql=_sql(f"""
SELECT lookups.pos, requested_id, s.customer_id, CASE WHEN s.customer_id IS NULL THEN 'Not found' ELSE 'ok' END AS status,
       round(p, 4) AS risk_score, CASE WHEN p IS NOT NULL THEN {_predicted('p')} END AS prediction,
       f.feature AS top_feature, s.segment AS input_segment
FROM lookups LEFT JOIN scored s ON trim(requested_id) = CAST(s.customer_id AS VARCHAR)
LEFT JOIN factors f ON f.customer_id = s.customer_id AND f.rank = 1""",
    _SCORED + ",\n" + _FACTORS + ",\n" + _REQUESTS + """,
lookups AS (SELECT pos, CASE WHEN pos % 2 = 0 THEN '  ' || requested_id || ' ' ELSE requested_id END AS requested_id FROM requests)"""))
def score_lookup(spark, sf):
    cp = customer_profile(spark, sf)
    req = _requests(spark, sf).withColumn(
        "requested_id", F.when(F.col("pos") % 2 == 0, F.concat(F.lit("  "), "requested_id", F.lit(" "))).otherwise(F.col("requested_id")))
    out = SC.score_lookup(linear(spark, sf, cp), cp, req)
    return out.select("pos", "requested_id", "customer_id", "status", "risk_score", "prediction",
                      F.col("top_factors")[0]["feature"].alias("top_feature"), F.try_element_at("inputs", F.lit("segment")).alias("input_segment"))


_GAPS = {"total_charges": "CASE WHEN acctbal >= 0 THEN total_charges END", "tenure": "CASE WHEN has_open = 0 THEN tenure END",
         "region": "CASE WHEN top_priority <> '2-HIGH' THEN region END"}
_FILLED = ", ".join(
    f"coalesce(CAST({_GAPS.get(c, c)} AS DOUBLE), (SELECT quantile_cont({c}, 0.5) FROM customer_profile)) AS {c}" for c in NUM)
_FILLED_CAT = ", ".join(
    f"coalesce(CAST({_GAPS.get(c, c)} AS VARCHAR), (SELECT CAST({c} AS VARCHAR) FROM customer_profile WHERE {c} IS NOT NULL "
    f"GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS {c}" for c in CAT)


@query("score_new_profiles", "R5 R6", sql=_sql(f"""
SELECT customer_id, round(p, 4) AS risk_score, {risk_level_sql('p')} AS risk_level, {_predicted('p')} AS prediction,
       CAST(0.5 AS DOUBLE) AS threshold_used, input_region, input_tenure
FROM (SELECT customer_id, region AS input_region, tenure AS input_tenure, {_p_sql(_x_sql(_PLAIN))} AS p FROM filled)""",
    f"filled AS (SELECT customer_id, {_FILLED}, {_FILLED_CAT} FROM customer_profile)"))
def score_new_profiles(spark, sf):
    """Gaps take the whole data set's values, which differ from those the
    model was fitted with."""
    cp = customer_profile(spark, sf)
    profiles = cp.select(
        "customer_id", "segment", "top_priority", "has_open", "monthly_charges", "acctbal",
        F.when(F.col("top_priority") != "2-HIGH", F.col("region")).alias("region"),
        F.when(F.col("acctbal") >= 0, F.col("total_charges")).alias("total_charges"),
        F.when(F.col("has_open") == 0, F.col("tenure")).alias("tenure"),
        F.lit("ignored").alias("unknown_column"),
    )
    out = SC.score_profiles(linear(spark, sf, cp), profiles, SC.defaults_of(cp, PS))
    return out.select("customer_id", "risk_score", "risk_level", "prediction", "threshold_used", "input_region",
                      F.col("input_tenure").cast("double").alias("input_tenure"))


# Scenarios: fixed values for the what-if query.
SCENARIOS = [
    ("urgent_priority", {"top_priority": "1-URGENT"}),
    ("no_change", {}),
    ("move_to_europe", {"region": "EUROPE"}),
    ("unknown_region", {"region": "ATLANTIS"}),
    ("longer_tenure", {"tenure": "72"}),
    ("tenure_as_decimal", {"tenure": "60.0"}),
    ("no_number", {"tenure": "abc"}),
    ("two_changes", {"region": "ASIA", "top_priority": "5-LOW"}),
]


def _changed_text(changes):
    entry = F.transform(F.map_entries(changes), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(F.array_sort(entry), ",")


def _scenario_row(name, changes):
    raw, wrong, listed = dict(_PLAIN), "false", []
    for c, v in sorted(changes.items()):
        if c in NUM:
            ok = v.replace(".", "").isdigit()
            wrong = "false" if ok else "true"
            raw[c] = f"CAST({v} AS DOUBLE)" if ok else c
            listed.append(f"CASE WHEN {c} IS DISTINCT FROM {v} THEN '{c}={v}' END" if ok else "NULL")
        else:
            raw[c] = f"'{v}'"
            listed.append(f"CASE WHEN CAST({c} AS VARCHAR) IS DISTINCT FROM '{v}' THEN '{c}={v}' END")
    changed = f"concat_ws(',', {', '.join(listed)})" if listed else "''"
    return (f"SELECT customer_id, '{name}' AS scenario_id, {wrong} AS wrong, {changed} AS changes, {_p_sql(_x_sql(_PLAIN))} AS p0, "
            f"{_p_sql(_x_sql(raw))} AS p1 FROM customer_profile")


_WHAT_IF_OUT = f"""
SELECT customer_id, scenario_id, CASE WHEN wrong THEN 'bad value' ELSE 'ok' END AS status, changes,
       round(p0, 4) AS current_score, {risk_level_sql('p0')} AS current_level, {_predicted('p0')} AS current_prediction,
       CASE WHEN NOT wrong THEN round(p1, 4) END AS hypothetical_score,
       CASE WHEN NOT wrong THEN {risk_level_sql('p1')} END AS hypothetical_level,
       CASE WHEN NOT wrong THEN {_predicted('p1')} END AS hypothetical_prediction,
       CASE WHEN NOT wrong THEN round(round(p1, 4) - round(p0, 4), 4) END AS risk_delta
FROM w"""


@query("what_if_scenarios", "R7 R8", sql=_sql(_WHAT_IF_OUT, "w AS (" + "\nUNION ALL ".join(
    _scenario_row(n, c) for n, c in SCENARIOS) + ")"))
def what_if_scenarios(spark, sf):
    cp = customer_profile(spark, sf)
    out = SC.what_if_bulk(linear(spark, sf, cp), cp, SCENARIOS)
    return out.withColumn("changes", _changed_text(F.col("changes")))


@query("what_if_requests", "R7", sql=_sql(f"""
SELECT r.customer_id, scenario_id, CASE WHEN p0 IS NULL THEN 'unknown customer' ELSE 'ok' END AS status,
       round(p0, 4) AS current_score, round(p1, 4) AS hypothetical_score,
       round(round(p1, 4) - round(p0, 4), 4) AS risk_delta
FROM r LEFT JOIN (SELECT customer_id, {_p_sql(_x_sql(_PLAIN))} AS p0, {_p_sql(_x_sql(_PLAIN | {'region': "'AFRICA'"}))} AS p1
                  FROM customer_profile) s ON r.customer_id = s.customer_id""", """
r AS (SELECT CASE WHEN o_orderstatus = 'P' THEN -o_custkey ELSE o_custkey END AS customer_id,
             CAST(o_orderkey AS VARCHAR) AS scenario_id FROM orders WHERE o_totalprice > 300000)"""))
def what_if_requests(spark, sf):
    """One what-if per large order; those still pending name an unknown customer."""
    cp = customer_profile(spark, sf)
    requests = read_table(spark, sf, "orders").where("o_totalprice > 300000").select(
        F.when(F.col("o_orderstatus") == "P", -F.col("o_custkey")).otherwise(F.col("o_custkey")).alias("customer_id"),
        F.col("o_orderkey").cast("string").alias("scenario_id"),
        F.create_map(F.lit("region"), F.lit("AFRICA")).alias("overrides"))
    out = SC.what_if(linear(spark, sf, cp), cp, requests)
    return out.select("customer_id", "scenario_id", "status", "current_score", "hypothetical_score", "risk_delta")


_IMPORTANCE = "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, round(abs(r{i}) / ({' + '.join(f'abs(r{j})' for j in range(_N))}), 4) AS importance FROM lin"
    for i, c in enumerate(NUM + CAT))


@query("global_importance", "R12", sql=_sql(_IMPORTANCE))
def global_importance(spark, sf):
    return AT.global_importance(spark, linear(spark, sf))


@query("model_info", "R13", sql=_sql(
    "SELECT 'Correlation' AS model, 'importance' AS scope, feature AS metric, importance AS value FROM (" + _IMPORTANCE
    + ") UNION ALL SELECT 'Correlation', 'fit', 'n_rows', CAST(count(*) AS DOUBLE) FROM fit_rows"))
def model_info(spark, sf):
    """Of a model that was saved and loaded again, with what was saved beside it."""
    from lapse.staging import shared_path

    cp = customer_profile(spark, sf)
    model = linear(spark, sf, cp)
    model.metadata["report"] = [[model.name, "fit", "n_rows", float(cp.where(FITTED_ON).count())]]
    path = shared_path(spark, "model")
    model.save(path)
    return AT.model_info(spark, MD.TrainedModel.load(path))


@query("chart_feature_importance", "C8", sql=_sql(f"SELECT * FROM ({_IMPORTANCE}) ORDER BY importance DESC, feature LIMIT 15"))
def chart_feature_importance(spark, sf):
    return C.feature_importance_chart(AT.global_importance(spark, linear(spark, sf)), 15)
