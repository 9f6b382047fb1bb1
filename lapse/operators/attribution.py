"""Score explanations.

Local attribution of a linear model is coefficient x transformed value;
the top factors per row are picked with ``array_sort`` inside the row (no
shuffle, no explode).  Tree models fall back to their global importances.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapse.operators import features as FT
from lapse.operators.models import TrainedModel, linear_terms, report_of


def _coefficients(model: TrainedModel):
    linear = linear_terms(model.classifier)
    return linear[0] if linear else None


def _importances(model: TrainedModel):
    clf = model.classifier
    if hasattr(clf, "featureImportances"):
        return [float(x) for x in clf.featureImportances.toArray()], False
    coefs = _coefficients(model)
    return [abs(c) for c in coefs], True


def global_importance(spark: SparkSession, model: TrainedModel) -> DataFrame:
    """Feature importances, or |coef| normalised to sum 1, 4 dp, desc."""
    imp, from_coef = _importances(model)
    if from_coef:
        total = sum(imp) or 1.0
        imp = [v / total for v in imp]
    rows = [(n, round(v, 4)) for n, v in zip(model.features.names, imp)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature")


def top_factors(model: TrainedModel, df: DataFrame, n_top: int = 5, keep=()) -> DataFrame:
    """Per row, the ``n_top`` features with the largest absolute
    rounded attribution (ties keep feature order); direction is
    increases_risk when the unrounded attribution is > 0.  ``raw_value`` is the input
    value as text.  For tree models, the global importances stand in and the
    direction is 'model-derived'."""
    spec = model.spec
    names = model.features.names
    keep = [spec.id_col, *[k for k in keep if k != spec.id_col]]
    raw = F.array(*[F.col(c).cast("string") for c in names])
    x = FT.transform_features(df.select(*keep, *names, raw.alias("_raw")), model.features,
                              keep=keep + ["_raw"], vector_col=None)
    coefs = _coefficients(model)
    if coefs is not None:
        exact = F.array(*[F.lit(c) * F.col(n) for c, n in zip(coefs, names, strict=True)])
        direction = lambda a: F.when(a > 0, "increases_risk").otherwise("decreases_risk")
    else:
        imp, _ = _importances(model)
        exact = F.array(*[F.lit(v) for v in imp])
        direction = lambda a: F.lit("model-derived")
    items = F.transform(
        F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"), F.col("_raw").alias("raw_value"),
                     exact.alias("exact"), F.sequence(F.lit(0), F.lit(len(names) - 1)).alias("pos")),
        lambda s: F.struct(s["feature"].alias("feature"), s["raw_value"].alias("raw_value"),
                           F.round(s["exact"], 4).alias("attribution"), direction(s["exact"]).alias("direction"),
                           s["pos"].alias("pos")),
    )
    ordered = F.array_sort(items, lambda a, b: F.when(F.abs(a["attribution"]) > F.abs(b["attribution"]), -1)
                           .when(F.abs(a["attribution"]) < F.abs(b["attribution"]), 1)
                           .otherwise(a["pos"] - b["pos"]))
    top = F.transform(F.slice(ordered, 1, n_top),
                      lambda s: F.struct(s["feature"].alias("feature"), s["raw_value"].alias("raw_value"),
                                         s["attribution"].alias("attribution"), s["direction"].alias("direction")))
    return x.select(*keep, top.alias("top_factors"))


def model_info(spark: SparkSession, model: TrainedModel, report: DataFrame | None = None, top: int = 10) -> DataFrame:
    """The metrics table (of a loaded model: as saved with it) plus the
    top global importances, long form (model, scope, metric, value)."""
    report = report if report is not None else report_of(spark, model)
    imp = global_importance(spark, model).limit(top)
    imp_long = imp.select(F.lit(model.name).alias("model"), F.lit("importance").alias("scope"),
                          F.col("feature").alias("metric"), F.col("importance").alias("value"))
    return report.unionByName(imp_long)
