"""Hand-made rows for what a green query on clean tables would not show."""

import pytest
from pyspark.sql import functions as F

from lapse.operators import aggregates as A
from lapse.operators import attribution as AT
from lapse.operators import cleaning as S
from lapse.operators import features as FT
from lapse.operators import metrics as MX
from lapse.operators import models as MD
from lapse.operators import ranking as R
from lapse.operators import scoring as SC
from lapse.operators import textjobs as TJ
from lapse.spec import Spec, SpecError

SPEC = Spec(id_col="id", target_col="churn", positive="Yes", negative="No", numeric=("n",), categorical=("c",))


def model(threshold=0.5, coefficients=(1.0, 0.5), intercept=0.0):
    fm = FT.FeatureModel(["n"], ["c"], {"n": 2.0}, {"n": 0.0}, {"n": 1.0}, {"c": "a"}, {"c": ["a", "b"]})
    return MD.TrainedModel(SPEC, "Correlation", fm, MD.LinearClassifier(coefficients, intercept), threshold)


@pytest.fixture
def customers(spark):
    return spark.createDataFrame([(1, "Yes", 1, "a"), (2, "No", 5, "b"), (3, None, None, None)], "id long, churn string, n int, c string")


def test_cleaning_strips_all_white_space_and_knows_nan(spark):
    rows = [("\tA1\n", 0, "NaN", 1, "Yes "), ("B2", 3, " NaN ", 1, "No"), ("C3", 3, "\t7.5\r\n", 0, "No")]
    raw = spark.createDataFrame(rows, "id string, tenure int, total string, flag int, churn string")
    plan = S.CleanPlan("total", "tenure", ("flag",))
    out = {r.id: r.total for r in S.clean(raw, SPEC, plan).collect()}
    assert out == {"A1": 0.0, "C3": 7.5}
    assert S.clean_report(raw, SPEC, plan).first().asDict() == {
        "n_input": 3, "n_imputed": 1, "n_dropped": 1, "n_duplicates": 0, "n_output": 2}
    assert S.nan_to_null(spark.createDataFrame([(float("nan"), 1.0)], "x double, y double")).first() == (None, 1.0)


def test_a_missing_flag_is_an_error(spark):
    raw = spark.createDataFrame([("A", 1, "5", None, "No")], "id string, tenure int, total string, flag int, churn string")
    with pytest.raises(Exception, match="flag is missing"):
        S.clean(raw, SPEC, S.CleanPlan("total", "tenure", ("flag",))).collect()


def test_what_if_statuses(spark, customers):
    req = spark.createDataFrame(
        [(1, "same", {"n": "1.0"}), (1, "new", {"n": "4", "c": "b"}), (2, "bad", {"n": "abc"}), (99, "who", {"n": "4"})],
        "id long, scenario_id string, overrides map<string,string>")
    out = {r.scenario_id: r for r in SC.what_if(model(), customers, req).collect()}
    assert out["same"].changes == {} and out["same"].risk_delta == 0.0 and out["same"].status == "ok"
    assert out["new"].changes == {"n": "4", "c": "b"} and out["new"].current_level and out["new"].hypothetical_prediction
    assert out["bad"].status == "bad value" and out["bad"].hypothetical_score is None and out["bad"].current_score is not None
    assert out["bad"].changes == {}
    assert out["who"].status == "unknown customer" and out["who"].current_score is None and out["who"].risk_delta is None


def test_many_scenarios(customers):
    scenarios = [(f"s{i}", {"n": str(i)}) for i in range(23)]
    out = SC.what_if_bulk(model(), customers, scenarios, inline_scenarios=5)
    assert out.count() == 23 * 3 and out.select("scenario_id").distinct().count() == 23
    with pytest.raises(SpecError):
        SC.what_if_bulk(model(), customers, [("x", {"unknown": "1"})])


def test_new_profiles_take_the_given_defaults(spark, customers):
    defaults = SC.defaults_of(customers, SPEC)
    assert defaults == {"n": 3.0, "c": "a"}
    gaps = customers.select("id", F.lit(None).cast("int").alias("n"))
    a = SC.score_profiles(model(), gaps, defaults).first().risk_score
    assert a != SC.score_profiles(model(), gaps).first().risk_score


def test_direction_follows_the_unrounded_value(customers):
    tiny = model(coefficients=(0.00001, 0.5))
    rows = {r.id: {f.feature: f for f in r.top_factors} for r in AT.top_factors(tiny, customers).collect()}
    assert rows[2]["n"].attribution == 0.0001 and rows[1]["n"].attribution == 0.0
    assert rows[1]["n"].direction == "increases_risk"


def test_lookup_of_one_customer(spark, customers):
    req = spark.createDataFrame([(0, " 2 "), (1, "nobody"), (2, "2")], "pos int, requested_id string")
    out = {r.pos: r for r in SC.score_lookup(model(), customers, req).collect()}
    assert out[0].status == "ok" and out[0].risk_score == out[2].risk_score and out[0].inputs == {"n": "5", "c": "b"}
    assert len(out[0].top_factors) == 2 and out[1].status == "Not found" and out[1].risk_score is None


def test_rows_without_a_label_are_kept(spark):
    df = spark.createDataFrame([(i, "Yes", 1, "a", None if i % 3 == 0 else i % 2) for i in range(60)],
                               "id long, churn string, n int, c string, label int")
    split = FT.assign_split(df, SPEC)
    assert split.count() == 60 and split.where("label is null").groupBy("split").count().count() == 2
    weights = FT.class_weights(df, SPEC)
    assert weights.count() == 60 and weights.where("label is null and weight is null").count() == 20


def test_join_encoder_equals_the_literal_map(spark):
    rows = [(i, "Yes", i, None if i % 10 == 0 else f"v{i % 37}") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, churn string, n int, c string")
    few, many = FT.fit_features(df, SPEC), FT.fit_features(df, SPEC, inline_categories=5)
    assert many.tables and not few.tables and many.modes == few.modes
    more = df.unionByName(spark.createDataFrame([(999, "No", 1, "unseen")], df.schema))
    a, b = ({tuple(r) for r in FT.transform_features(more, m, keep=["id"], vector_col=None).collect()} for m in (few, many))
    assert a == b and (999, -1.0) in {(r[0], r[2]) for r in a}


def test_saved_model_keeps_its_encoder_and_report(spark, tmp_dir):
    df = spark.createDataFrame([(i, "Yes" if i % 2 else "No", i, f"v{i % 37}") for i in range(200)], "id long, churn string, n int, c string")
    fm = FT.fit_features(df, SPEC, inline_categories=5)
    m = MD.TrainedModel(SPEC, "Correlation", fm, MD.LinearClassifier((0.01, 0.02)), 0.4, {"report": [["m", "test", "auc", 0.5]]})
    m.save(tmp_dir + "/m")
    again = MD.TrainedModel.load(tmp_dir + "/m")
    assert again.features.tables != fm.tables
    assert sorted(SC.score_all(m, df).collect()) == sorted(SC.score_all(again, df).collect())
    assert {r.metric for r in AT.model_info(spark, again).collect()} == {"auc", "n", "c"}


def test_selection_uses_unrounded_means(spark):
    cv = spark.createDataFrame([("RandomForest", 0, "roc_auc", 0.70001), ("LogisticRegression", 0, "roc_auc", 0.70000)],
                               "model string, fold int, metric string, value double")
    assert MD.select_best(MD.summarize_cv(cv, digits=None)) == "RandomForest"


def test_nan_scores_and_mistyped_filters_are_refused(spark):
    scored = spark.createDataFrame([(1, 0.5), (0, float("nan"))], "label int, score double")
    with pytest.raises(Exception, match="NaN"):
        MX.roc_auc(scored).collect()
    df = spark.createDataFrame([("a", 1.0, "x")], "g string, v double, f string")
    with pytest.raises(SpecError):
        A.group_aggregate(df, "g", "v", "mean", filter_col="f", filter_val=3)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, customers):
    """No unbounded percentile buffer; the base table of T3 is not shuffled."""
    for df in (A.get_median(customers, "n"), A.describe_numeric(customers, "n"), A.group_aggregate(customers, "c", "n", "median")):
        assert "percentile(" not in plan_of(df)
    scores = customers.select("id", (F.col("n") / 10).alias("risk_score"))
    top = R.top_risk(scores, customers, SPEC, 2, enrich=["c"])
    assert any("BroadcastHashJoin" in line and "LeftSemi" in line for line in plan_of(top).splitlines())
    assert [r.id for r in top.orderBy(F.desc("risk_score")).collect()] == [2, 1]
    assert R.top_risk(scores, customers, SPEC, 500, max_n=None).count() == 3


def test_answers_behind_other_turns(spark):
    turns = [(1, 0, "user", "q0"), (1, 1, "system", "s"), (1, 2, "assistant", "a0"), (1, 3, "user", "q1"), (1, 4, "user", "q2"),
             (1, 5, "assistant", "a2"), (2, 999, "user", "late"), (2, 5000, "assistant", "answer")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r.answer for r in TJ.pair_turns(df).collect()}
    assert got == {(1, 0): "a0", (1, 3): None, (1, 4): "a2", (2, 999): "answer"}
    assert TJ.recent_context(df).where("conv_id = 1").first().n_pairs == 2
