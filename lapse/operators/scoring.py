"""Scoring, lookups by id, new profiles and what-if scenarios.

Scoring is one ``transform`` over any number of rows (batch or stream).
What-if takes (customer, scenario, overrides) requests, joins them to the
customers on the id and scores both sides in the same pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from lapse.functions.exprs import prediction_label, risk_level
from lapse.operators import features as FT
from lapse.functions.text import strip_ws
from lapse.operators.models import TrainedModel, add_score
from lapse.spec import SpecError

#: Scenarios of a list that are written into the plan; a longer list is a
#: table that every customer is joined with.
INLINE_SCENARIOS = 256


def _probability(model: TrainedModel, df: DataFrame, keep, out: str = "score") -> DataFrame:
    x = FT.transform_features(df, model.features, keep=keep, vector_col=None)
    return add_score(x, model.classifier, model.features.names, out).select(*keep, out)


def score_all(model: TrainedModel, df: DataFrame, keep=()) -> DataFrame:
    """risk_score rounded to 4 dp; level and prediction from the
    unrounded probability (one rule for single and bulk scoring)."""
    spec = model.spec
    keep = [spec.id_col, *[k for k in keep if k != spec.id_col]]
    p = _probability(model, df, keep)
    return p.select(
        *keep,
        F.round("score", 4).alias("risk_score"),
        risk_level(F.col("score")).alias("risk_level"),
        prediction_label(F.col("score"), model.threshold).alias("prediction"),
        F.lit(round(model.threshold, 4)).alias("threshold_used"),
    )


def _normal(c: Column) -> Column:
    return F.upper(strip_ws(c.cast("string")))


def score_lookup(model: TrainedModel, df: DataFrame, requests: DataFrame, pos_col: str = "pos",
                 req_col: str = "requested_id", n_top: int = 5) -> DataFrame:
    """Each requested id (stripped, any case) with score, level,
    prediction, top factors and inputs in one row; 'Not found' otherwise.
    Only the requested customers are scored."""
    from lapse.operators.attribution import top_factors

    spec = model.spec
    wanted = requests.select(_normal(F.col(req_col)).alias("_key")).distinct()
    rows = df.withColumn("_norm", _normal(F.col(spec.id_col))).join(wanted, F.col("_norm") == F.col("_key"), "left_semi")
    inputs = F.create_map(*[x for c in spec.features for x in (F.lit(c), F.col(c).cast("string"))])
    rows = rows.withColumn("inputs", inputs)
    scored = score_all(model, rows, keep=["_norm", "inputs"])
    factors = top_factors(model, rows, n_top).withColumnRenamed(spec.id_col, "_fid")
    found = scored.join(factors, F.col(spec.id_col) == F.col("_fid"))
    out = requests.join(found, _normal(F.col(req_col)) == F.col("_norm"), "left")
    return out.select(
        pos_col, req_col, spec.id_col, F.when(F.col("_norm").isNull(), "Not found").otherwise("ok").alias("status"),
        "risk_score", "risk_level", "prediction", "top_factors", "inputs")


def what_if_bulk(model: TrainedModel, customers: DataFrame, scenarios, changed_only: bool = True,
                 inline_scenarios: int = INLINE_SCENARIOS) -> DataFrame:
    """R7/R8 for every customer under a list of scenarios: one scan, in which
    the features travel with each expanded request."""
    _check_names(model.spec, {k for _, changes in scenarios for k in changes})
    req = scenario_requests(customers, model.spec.id_col, scenarios, keep=model.spec.features,
                            inline_scenarios=inline_scenarios)
    return what_if(model, customers, req, changed_only=changed_only, checked=True)


def score_requests(model: TrainedModel, df: DataFrame, requests: DataFrame,
                   pos_col: str = "pos", req_col: str = "requested_id") -> DataFrame:
    """Score a list of ids, keeping request order and duplicates; an
    unknown id gives a 'Not found' row.  Exact-case id match as in the
    reference's batch path; ``score_lookup`` does the normalised form.  Only
    the requested rows are scored."""
    spec = model.spec
    wanted = requests.select(F.col(req_col).cast("string").alias("_id")).distinct()
    scores = score_all(model, df.join(wanted, F.col(spec.id_col).cast("string") == F.col("_id"), "left_semi"))
    key = F.col(spec.id_col).cast("string")
    s = scores.select(key.alias("_key"), "risk_score", "risk_level", "prediction")
    out = requests.join(s, requests[req_col].cast("string") == F.col("_key"), "left")
    return out.select(
        pos_col, F.col(req_col).alias("customer_id"),
        F.when(F.col("_key").isNull(), "Not found").otherwise("ok").alias("status"),
        "risk_score", "risk_level", "prediction",
    ).orderBy(pos_col)  # request order (a range-partitioned sort)


def _defaults_row(model: TrainedModel) -> dict:
    return {**model.features.medians, **model.features.modes}


def fill_defaults(profiles: DataFrame, model: TrainedModel, defaults: dict | None = None) -> DataFrame:
    """Missing features take ``defaults``; unknown columns are ignored
    (projected away).  Give the whole data set's medians and most frequent
    values (``defaults_of``); without any, the training rows' serve."""
    spec = model.spec
    d = defaults or _defaults_row(model)
    cols = []
    for c in spec.features:
        if c in profiles.columns:
            cols.append(F.coalesce(F.col(c), F.lit(d.get(c))).alias(c))
        else:
            cols.append(F.lit(d.get(c)).alias(c))
    idc = [spec.id_col] if spec.id_col in profiles.columns else []
    return profiles.select(*idc, *cols)


def defaults_of(df: DataFrame, spec) -> dict:
    """R6 as a dict: one value per feature over all rows of ``df``."""
    rows = FT.feature_defaults(df, spec).collect()
    return {r["feature"]: r["numeric_default"] if r["numeric_default"] is not None else r["categorical_default"] for r in rows}


def score_profiles(model: TrainedModel, profiles: DataFrame, defaults: dict | None = None) -> DataFrame:
    filled = fill_defaults(profiles, model, defaults)
    if model.spec.id_col not in filled.columns:
        # deterministic surrogate id (recomputation after a lost executor gives the same ids)
        filled = filled.withColumn(model.spec.id_col, F.xxhash64(*[F.col(c) for c in model.spec.features]))
    # the filled inputs travel along as input_<feature>
    feats = model.spec.features
    filled = filled.select("*", *[F.col(c).alias(f"input_{c}") for c in feats])
    return score_all(model, filled, keep=[f"input_{c}" for c in feats])


def _check_names(spec, names) -> None:
    unknown = sorted(set(names) - set(spec.features))
    if unknown:
        raise SpecError(f"no such features to change: {unknown}")


def _scenario_map(changes: dict) -> Column:
    m = F.create_map(*[x for k, v in changes.items() for x in (F.lit(k), F.lit(None if v is None else str(v)))])
    return m.cast("map<string,string>")


def scenario_requests(customers: DataFrame, id_col: str, scenarios, keep=(),
                      inline_scenarios: int = INLINE_SCENARIOS) -> DataFrame:
    """Every customer under each scenario of a list
    ``[(scenario_id, {feature: value}), ...]``: one scan of the customers,
    each row expanded into its requests.  The customers' side of a list beyond
    ``inline_scenarios`` is expanded block by block."""
    if not scenarios:
        raise SpecError("there is no scenario")
    out = None
    for at in range(0, len(scenarios), inline_scenarios):
        block = F.array(*[F.struct(F.lit(sid).alias("scenario_id"), _scenario_map(changes).alias("overrides"))
                          for sid, changes in scenarios[at : at + inline_scenarios]])
        part = customers.select(id_col, *keep, F.inline(block))
        out = part if out is None else out.unionByName(part)
    return out


def what_if(model: TrainedModel, customers: DataFrame, requests: DataFrame,
            overrides_col: str = "overrides", changed_only: bool = True, checked: bool = False) -> DataFrame:
    """Score each request (customer id, scenario_id, overrides) as
    it is and with ``overrides`` (map<string,string> feature -> value)
    applied.  Every request comes back with a status:

    * ``ok``;
    * ``unknown customer``: no such id; no scores;
    * ``bad value``: a number was asked for and the text is none; the
      hypothetical side is null, the current one is given.

    Unknown feature names are an error (``checked``: the caller has looked).
    An unknown category encodes to -1 like any unseen one.  ``changes`` lists
    the overrides that differ from the current value, compared in the column's
    own type.  The delta is hypothetical minus current of the rounded scores,
    4 dp.  Requests meet customers in an equi-join on the id, unless they
    bring the features along; both scores come out of the same pass."""
    spec = model.spec
    feats = spec.features
    if not checked:
        names = F.array(*map(F.lit, feats))
        bad = requests.select(F.array_except(F.map_keys(overrides_col), names).alias("bad")).where(F.size("bad") > 0)
        row = bad.first()
        if row:
            _check_names(spec, row["bad"])
    if all(c in requests.columns for c in feats):
        pairs = requests.select(spec.id_col, "scenario_id", overrides_col, *feats).withColumn("_known", F.lit(True))
    else:
        base = customers.select(spec.id_col, *feats).withColumn("_known", F.lit(True))
        pairs = requests.select(spec.id_col, "scenario_id", overrides_col).join(base, spec.id_col, "left")
    new, changed, wrong = [], [], F.lit(False)
    for c in feats:
        kind = customers.schema[c].dataType
        text = F.try_element_at(F.col(overrides_col), F.lit(c))
        value = text.try_cast(kind)
        if isinstance(kind, NumericType):
            value = F.coalesce(value, text.try_cast("double").cast(kind))  # 72.0 for an integer
            wrong = wrong | (text.isNotNull() & value.isNull())
        new.append(F.coalesce(value, F.col(c)).alias(f"_h_{c}"))
        changed.append(F.when(value.isNotNull() & ~value.eqNullSafe(F.col(c)), F.lit(c)))
    pairs = pairs.select("*", *new, F.array_compact(F.array(*changed)).alias("_changed"), wrong.alias("_wrong"))
    keep = [spec.id_col, "scenario_id", overrides_col, "_known", "_changed", "_wrong"]
    cur = _probability(model, pairs, [*keep, *[f"_h_{c}" for c in feats]], "_p0")
    cur = cur.select(*keep, "_p0", *[F.col(f"_h_{c}").alias(c) for c in feats])
    hyp = _probability(model, cur, [*keep, "_p0"], "_p1")
    p0 = F.when(F.col("_known"), F.col("_p0"))
    p1 = F.when(F.col("_known") & ~F.col("_wrong"), F.col("_p1"))
    changes = F.map_filter(F.col(overrides_col), lambda k, v: F.array_contains(F.col("_changed"), k))

    def sided(p, name):
        return [F.round(p, 4).alias(f"{name}_score"), F.when(p.isNotNull(), risk_level(p)).alias(f"{name}_level"),
                F.when(p.isNotNull(), prediction_label(p, model.threshold)).alias(f"{name}_prediction")]

    return hyp.select(
        spec.id_col, "scenario_id",
        F.when(F.col("_known").isNull(), "unknown customer").when(F.col("_wrong"), "bad value").otherwise("ok").alias("status"),
        (changes if changed_only else F.col(overrides_col)).alias("changes"),
        *sided(p0, "current"), *sided(p1, "hypothetical"),
        F.round(F.round(p1, 4) - F.round(p0, 4), 4).alias("risk_delta"),
    )
