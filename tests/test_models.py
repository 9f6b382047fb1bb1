"""Model fit, scoring, what-if, attribution, persistence and streaming on
the sf0.001 customer profile."""

import os

import pytest
from pyspark.sql import functions as F

from lapse.operators import attribution as AT
from lapse.operators import models as MD
from lapse.operators import scoring as SC
from lapse.sources.frames import PROFILE_SPEC as PS
from lapse.sources.frames import customer_profile
from lapse.spec import SpecError
from lapse.streaming import scoring as ST
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def trained(spark):
    cp = customer_profile(spark, SF_SMALL)
    model, report = MD.train(cp, PS, names=["LogisticRegression"], cv=False)
    return cp, model, report


def test_report_has_test_metrics(trained):
    _, model, report = trained
    metrics = {r["metric"]: r["value"] for r in report.where("scope = 'test'").collect()}
    assert 0.0 <= metrics["roc_auc"] <= 1.0
    assert 0.0 <= metrics["optimal_threshold"] <= 1.0
    assert model.threshold == pytest.approx(metrics["optimal_threshold"])


def test_scores_in_range_and_level_consistent(trained):
    cp, model, _ = trained
    s = SC.score_all(model, cp)
    assert s.count() == cp.count()
    bad = s.where((F.col("risk_score") < 0) | (F.col("risk_score") > 1)).count()
    assert bad == 0
    # the level comes from the unrounded probability: only a rounded score
    # sitting on a tier edge may disagree with it
    near_edge = (F.abs(F.col("risk_score") - 0.70) <= 0.00005) | (F.abs(F.col("risk_score") - 0.40) <= 0.00005)
    lv = s.where((((F.col("risk_score") >= 0.70) & (F.col("risk_level") != "High"))
                  | ((F.col("risk_score") < 0.40) & (F.col("risk_level") != "Low"))) & ~near_edge).count()
    assert lv == 0


def test_what_if_no_change_and_unknown(trained):
    cp, model, _ = trained
    req = SC.scenario_requests(cp, PS.id_col, [("none", {}), ("same", {"segment": None}),
                                               ("odd", {"region": "ATLANTIS"})])
    out = SC.what_if(model, cp, req)
    none = out.where("scenario_id = 'none'")
    assert none.where("risk_delta <> 0").count() == 0
    assert none.where("size(changes) > 0").count() == 0
    assert out.where("scenario_id = 'odd'").count() == cp.count()
    bad = SC.scenario_requests(cp, PS.id_col, [("x", {"not_a_feature": "1"})])
    with pytest.raises(SpecError):
        SC.what_if(model, cp, bad)


def test_batch_requests_keep_order_and_unknown(spark, trained):
    cp, model, _ = trained
    ids = [r[0] for r in cp.select("customer_id").limit(2).collect()]
    req = spark.createDataFrame([(0, str(ids[0])), (1, "NON-EXISTENT-ID"), (2, str(ids[0])), (3, str(ids[1]))],
                                "pos int, requested_id string")
    out = SC.score_requests(model, cp, req).orderBy("pos").collect()
    assert [r["status"] for r in out] == ["ok", "Not found", "ok", "ok"]
    assert out[0]["risk_score"] == out[2]["risk_score"]


def test_top_factors_shape(trained):
    cp, model, _ = trained
    tf = AT.top_factors(model, cp).first()["top_factors"]
    assert len(tf) == 5
    mags = [abs(f["attribution"]) for f in tf]
    assert mags == sorted(mags, reverse=True)
    assert {f["direction"] for f in tf} <= {"increases_risk", "decreases_risk"}


def test_global_importance_sums_to_one(spark, trained):
    _, model, _ = trained
    imp = [r["importance"] for r in AT.global_importance(spark, model).collect()]
    assert sum(imp) == pytest.approx(1.0, abs=1e-3)


def test_tree_models_fit(spark):
    cp = customer_profile(spark, SF_SMALL)
    for name, ov in (("RandomForest", {"numTrees": 10, "maxDepth": 5}),
                     ("GradientBoosting", {"rounds": 5})):
        fm, clf = MD.fit_one(cp.withColumn("label", PS.positive_flag()), PS, name, **ov)
        model = MD.TrainedModel(PS, name, fm, clf)
        assert SC.score_all(model, cp).count() == cp.count()
        tf = AT.top_factors(model, cp).first()["top_factors"]
        assert tf[0]["direction"] == "model-derived"


def test_cross_validate_two_models(spark):
    from lapse.operators import features as FT

    cp = customer_profile(spark, SF_SMALL)
    split = FT.assign_split(cp, PS).where("split = 'train'")
    cv = MD.cross_validate(split, PS, ["LogisticRegression", "GradientBoosting"], folds=3,
                           overrides={"GradientBoosting": {"rounds": 3}})
    summary = MD.summarize_cv(cv)
    assert summary.where("metric = 'roc_auc'").count() == 2
    assert MD.select_best(summary) in {"LogisticRegression", "GradientBoosting"}


def test_a_fold_is_prepared_once_for_all_candidates(spark, monkeypatch):
    from lapse.operators import features as FT

    fitted, fit = [], FT.fit_features
    monkeypatch.setattr(FT, "fit_features", lambda *a, **k: (fitted.append(1), fit(*a, **k))[1])
    split = FT.assign_split(customer_profile(spark, SF_SMALL), PS).where("split = 'train'")
    cv = MD.cross_validate(split, PS, folds=2, overrides={"GradientBoosting": {"rounds": 2}, "RandomForest": {"numTrees": 3}})
    assert cv.select("model", "fold").distinct().count() == 6 and len(fitted) == 2


def test_save_load_roundtrip(spark, trained, tmp_dir):
    cp, model, _ = trained
    path = os.path.join(tmp_dir, "model")
    model.save(path)
    again = MD.TrainedModel.load(path)
    a = SC.score_all(model, cp).orderBy("customer_id").select("risk_score").collect()
    b = SC.score_all(again, cp).orderBy("customer_id").select("risk_score").collect()
    assert a == b


def test_ledger_export_csv_json(spark, trained, tmp_dir):
    from lapse.operators.ranking import ledger
    from lapse.sources.tables import read_csv, write_ledger

    cp, model, _ = trained
    led = ledger(SC.score_all(model, cp), PS, tiers=("High", "Medium", "Low"))
    write_ledger(led, os.path.join(tmp_dir, "csv"), "csv")
    write_ledger(led, os.path.join(tmp_dir, "json"), "json")
    back = read_csv(spark, os.path.join(tmp_dir, "csv"),
                    "customer_id long, risk_score double, risk_level string, prediction string, "
                    "threshold_used double")
    assert back.count() == cp.count()
    assert spark.read.json(os.path.join(tmp_dir, "json")).count() == cp.count()


def test_stream_scoring_available_now(spark, trained, tmp_dir):
    cp, model, _ = trained
    src = os.path.join(tmp_dir, "in")
    cp.repartition(3).write.parquet(src)
    q = ST.score_stream(model, ST.read_profiles(spark, src, cp.schema), os.path.join(tmp_dir, "out"),
                        os.path.join(tmp_dir, "ckpt"))
    q.awaitTermination(300)
    out = spark.read.parquet(os.path.join(tmp_dir, "out"))
    assert out.count() == cp.count()
    # a second run with no new files adds nothing (exactly once per file)
    q2 = ST.score_stream(model, ST.read_profiles(spark, src, cp.schema), os.path.join(tmp_dir, "out"),
                         os.path.join(tmp_dir, "ckpt"))
    q2.awaitTermination(300)
    assert spark.read.parquet(os.path.join(tmp_dir, "out")).count() == cp.count()


def test_stream_tier_counts(spark, trained, tmp_dir):
    cp, model, _ = trained
    src = os.path.join(tmp_dir, "in2")
    cp.repartition(2).write.parquet(src)
    scored = SC.score_all(model, ST.read_profiles(spark, src, cp.schema))
    q = ST.tier_counts_stream(scored, os.path.join(tmp_dir, "tiers"), os.path.join(tmp_dir, "ckpt2"))
    q.awaitTermination(300)
    tiers = ST.latest_tier_counts(spark, os.path.join(tmp_dir, "tiers"))
    assert sum(r["count"] for r in tiers.collect()) == cp.count()


def test_training_derives_its_rows_once(spark):
    """The split used to derive them twice, once for its counts."""
    from lapse.spec import Spec

    made = spark.sparkContext.accumulator(0)

    def seen(x: int) -> str:
        made.add(1)
        return "No" if x % 3 else "Yes"

    df = spark.range(60).select("id", (F.col("id") * 7 % 11).cast("double").alias("a"), F.udf(seen, "string")("id").alias("churn"))
    _, report = MD.train(df, Spec("id", "churn", "Yes", numeric=("a",)), names=["LogisticRegression"], cv=False)
    assert made.value == 60 and report.where("scope = 'test'").count() > 0


def test_a_fold_is_boosted_beside_its_other_fits(spark, monkeypatch):
    """All boosting used to come first, a core for each fit and the others idle."""
    from lapse.operators import features as FT

    begun, fit = [], MD.fit_classifier
    monkeypatch.setattr(MD, "fit_classifier", lambda rows, fm, spec, name, *a, **k: (begun.append(name), fit(rows, fm, spec, name, *a, **k))[1])
    split = FT.assign_split(customer_profile(spark, SF_SMALL), PS).where("split = 'train'")
    MD.cross_validate(split, PS, ["LogisticRegression", "GradientBoosting"], folds=2, parallelism=1, overrides={"GradientBoosting": {"rounds": 2}})
    assert begun == ["GradientBoosting", "LogisticRegression"] * 2
