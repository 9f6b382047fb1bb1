"""Model fitting, cross-validated comparison and selection.

Logistic regression is ``pyspark.ml``'s, trees are ``boosting`` and ``forest``.  The feature transform is
the column-expression model of ``features``; it is refit inside every fold
so no fold sees statistics of its own validation rows.  All folds' scores
are unioned and evaluated in one grouped metrics job.
"""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.ml.classification import (
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassificationModel,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapse.functions.exprs import DEFAULT_THRESHOLD, pearson
from lapse.operators import boosting as BO
from lapse.operators import features as FT
from lapse.operators import forest as FO
from lapse.operators import metrics as MX
from lapse.session import ensure_checkpoint_dir, worker_path
from lapse.sources import versions
from lapse.spec import Spec, SpecError
from lapse.staging import drop_staged, staged


@dataclass(frozen=True)
class LinearClassifier:
    """Coefficients over the prepared features, in their order."""
    coefficients: tuple[float, ...]
    intercept: float = 0.0


def linear_terms(clf):
    """(coefficients, intercept) of a linear model, else None."""
    if not hasattr(clf, "coefficients"):
        return None
    c = clf.coefficients
    return [float(x) for x in (c.toArray() if hasattr(c, "toArray") else c)], float(clf.intercept)


def add_score(df: DataFrame, clf, names, out: str = "score") -> DataFrame:
    """Probability of the positive class from the prepared feature columns
    ``names``.  A linear model is a column expression (dot product and
    sigmoid), trees run in Arrow batches, others score the assembled vector."""
    linear = linear_terms(clf)
    if isinstance(clf, BO.HistogramBooster | FO.Forest):
        worker_path(df.sparkSession)
        return df.withColumn(out, clf.probability(F.array(*[F.col(c).cast("double") for c in names])))
    if linear is None:
        x = VectorAssembler(inputCols=list(names), outputCol="features").transform(df)
        scored = clf.transform(x)
        return scored.withColumn(out, vector_to_array(F.col("probability"))[1]).select(*df.columns, out)
    coefficients, intercept = linear
    z = F.lit(intercept)
    for c, name in zip(coefficients, names, strict=True):
        z = z + F.lit(c) * F.col(name)
    return df.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))


# Candidate hyper-parameters.  Fixed values: logistic regression with L2,
# C = 1, at most 1000 iterations, balanced class weights; random forest with
# 200 trees; gradient boosting over histograms with 300 rounds, learning rate
# 0.05, depth 6, L2 0.1 (see ``boosting.Params``).
# A forest is sent to all workers, so its size must not grow with the rows: a
# leaf holds at least MIN_LEAF_SHARE of them.
MIN_LEAF_SHARE = 1e-5
CANDIDATES = {
    "LogisticRegression": {"maxIter": 1000},
    "RandomForest": {"numTrees": 200, "maxDepth": 30},
    "GradientBoosting": {"rounds": 300, "learning_rate": 0.05, "max_depth": 6, "l2": 0.1},
}


def make_estimator(name: str, weight_sum: float, **overrides):
    """``weight_sum`` turns sklearn's summed-loss L2 (C = 1) into Spark's
    mean-loss objective: regParam = 1 / sum(weights)."""
    p = {**CANDIDATES[name], **overrides}
    common = dict(featuresCol="features", labelCol="label", weightCol="weight")
    if name == "LogisticRegression":
        return LogisticRegression(regParam=1.0 / weight_sum, elasticNetParam=0.0, standardization=False,
                                  tol=1e-6, **common, **p)
    raise SpecError(f"no candidate is called {name!r}")


def _weighted(df: DataFrame, spec: Spec) -> DataFrame:
    if "weight" in df.columns:
        df = df.drop("weight")
    return FT.class_weights(df, spec, "weight")


def prepare_fit(train: DataFrame, spec: Spec):
    """(feature model, persisted prepared rows with weights) of the labelled
    rows of ``train``, as every candidate needs them."""
    train = train.where(F.col(spec.label_col).isNotNull()).persist()
    try:
        fm = FT.fit_features(train, spec)
        keep = [spec.id_col, spec.label_col, "weight"]
        prepared = FT.transform_features(_weighted(train, spec), fm, keep=keep, vector_col=None).persist()
        prepared.count()  # read while its input is kept
    finally:
        train.unpersist()
    return fm, prepared


def fit_classifier(prepared: DataFrame, fm, spec: Spec, name: str, seed: int = 42, **overrides):
    p = {**CANDIDATES.get(name, {}), **overrides}
    if name == "GradientBoosting":
        return BO.fit(prepared, fm.names, spec.label_col, "weight", BO.Params(**p))
    if name == "RandomForest":
        return FO.fit(prepared, fm.names, spec.id_col, spec.label_col, "weight", FO.Params(min_leaf_share=MIN_LEAF_SHARE, seed=seed, **p))
    total_w = prepared.agg(F.sum("weight")).first()[0]
    x = VectorAssembler(inputCols=fm.names, outputCol="features").transform(prepared)
    return make_estimator(name, total_w, **overrides).fit(x)


def fit_one(train: DataFrame, spec: Spec, name: str, seed: int = 42, **overrides):
    """Fit the feature model and one classifier on the labelled rows of
    ``train`` (kept persisted while the fitting passes run over it)."""
    fm, prepared = prepare_fit(train, spec)
    try:
        return fm, fit_classifier(prepared, fm, spec, name, seed, **overrides)
    finally:
        prepared.unpersist()


def score_with(df: DataFrame, fm, clf, keep) -> DataFrame:
    x = FT.transform_features(df, fm, keep=keep, vector_col=None)
    return add_score(x, clf, fm.names).select(*keep, "score")


def correlation_model(df: DataFrame, spec: Spec, digits: int = 6) -> "TrainedModel":
    """A linear scorer in closed form: each coefficient is the correlation of
    the prepared feature with the outcome, rounded; the intercept is minus
    what the average row would score.  No iterative fit, so SQL can say the
    same.  Rows without an outcome take part as in M1-M5, not in the
    correlations."""
    # the fit reads its rows several times: derive them once
    df = staged(FT.project_features(spec.with_label(df), spec, keep=[spec.label_col, spec.target_col]), "fit-rows")
    fm = FT.fit_features(df, spec)
    y = F.when(F.col(spec.target_col).isNotNull(), F.col(spec.label_col)).alias("_y")
    x = FT.transform_features(df.withColumn("_y", y), fm, keep=["_y"], vector_col=None)
    row = x.agg(*[F.round(pearson(c, "_y"), digits).alias(f"r{i}") for i, c in enumerate(fm.names)],
                *[F.round(F.avg(c), digits).alias(f"m{i}") for i, c in enumerate(fm.names)]).first()
    r = [row[f"r{i}"] or 0.0 for i in range(len(fm.names))]
    intercept = 0.0
    for i, c in enumerate(r):
        intercept -= round(c * (row[f"m{i}"] or 0.0), digits)
    return TrainedModel(spec, "Correlation", fm, LinearClassifier(tuple(r), round(intercept, digits)))


def cross_validate(train: DataFrame, spec: Spec, names=None, folds: int = 5, seed: int = 42,
                   overrides: dict | None = None, parallelism: int = 4) -> DataFrame:
    """Per model and fold, ROC-AUC, average precision, F1, recall and
    precision at 0.5 on the held-out fold.  ``train`` must carry a ``fold``
    column (``assign_split``).  A fold's feature model is fitted once for all
    candidates.  The (model, fold) fits are submitted from ``parallelism``
    driver threads (Spark runs their jobs concurrently); every fold's scores
    are staged, unioned and evaluated in one grouped metrics job.  Returns long form (model, fold, metric, value)."""
    from concurrent.futures import ThreadPoolExecutor

    ensure_checkpoint_dir(train.sparkSession)
    names = list(names or CANDIDATES)
    overrides = overrides or {}
    # every fold reads these rows: derive them once
    train = staged(FT.project_features(spec.with_label(train), spec, keep=[spec.label_col, "fold"]), "train")
    prepared = {}

    def prepare(f):
        prepared[f] = prepare_fit(train.where(F.col("fold") != f), spec)

    def run(task):
        name, f = task
        fm, rows = prepared[f]
        clf = fit_classifier(rows, fm, spec, name, seed, **overrides.get(name, {}))
        s = score_with(train.where(F.col("fold") == f), fm, clf, [spec.id_col, spec.label_col])
        # cut the lineage of the fit: a lost executor recomputes from here
        kept = staged(s.select(F.lit(name).alias("model"), F.lit(f).alias("fold"), "label", "score"), "fold-scores")
        if isinstance(clf, FO.Forest):
            clf.drop()
        return kept

    try:
        # boosting takes longest and may be one task, so each of its fits goes first, beside the fold's other ones
        tasks = [(n, f) for f in range(folds) for n in sorted(names, key=lambda n: n != "GradientBoosting")]
        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            list(pool.map(prepare, range(folds)))
            scored = list(pool.map(run, tasks))
        allscores = scored[0]
        for s in scored[1:]:
            allscores = allscores.unionByName(s)
        g = ["model", "fold"]
        auc = MX.roc_auc(allscores, group=g, digits=None)
        ap = MX.average_precision(allscores, group=g, digits=None)
        th = MX.threshold_metrics(allscores, threshold=DEFAULT_THRESHOLD, digits=None, group=g)
        wide = auc.join(ap, g).join(th.select(*g, "f1", "recall", "precision"), g)
        metrics = ["roc_auc", "average_precision", "f1", "recall", "precision"]
        return wide.select(*g, F.inline(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))
    finally:
        for _, rows in prepared.values():
            rows.unpersist()
        drop_staged(train)


def summarize_cv(cv: DataFrame, digits: int | None = 4) -> DataFrame:
    """Mean and population std over folds per (model, metric)."""
    mean, std = F.avg("value"), F.stddev_pop("value")
    if digits is not None:
        mean, std = F.round(mean, digits), F.round(std, digits)
    return cv.groupBy("model", "metric").agg(mean.alias("mean"), std.alias("std"))


def select_best(summary: DataFrame) -> str:
    """Highest mean ROC-AUC (one small row); give it unrounded means.
    Ties go to the candidate that comes first."""
    order = F.lit(0)
    for i, name in enumerate(CANDIDATES):
        order = F.when(F.col("model") == name, i).otherwise(order)
    row = (summary.where(F.col("metric") == "roc_auc")
           .orderBy(F.desc("mean"), order, F.asc("model")).limit(1).first())
    return row["model"]


@dataclass
class TrainedModel:
    spec: Spec
    name: str
    features: FT.FeatureModel
    classifier: object
    threshold: float = DEFAULT_THRESHOLD
    metadata: dict = field(default_factory=dict)

    def save(self, path: str) -> str:
        """A new version below ``path``, seen by readers only once all of
        it is written; its name.  The classifier via ML persistence; fitted
        constants and metadata (model name, class counts, CV results, test
        metrics, threshold) as JSON next to it; encoder tables as Parquet."""
        spark = SparkSession.getActiveSession()
        version = versions.start(spark, path)
        self._write(spark, versions.folder(path, version))
        versions.publish(spark, path, version)
        return version

    def _write(self, spark: SparkSession, path: str) -> None:
        features, linear, trees, forest = asdict(self.features), None, None, None
        if isinstance(self.classifier, LinearClassifier):
            linear = [list(self.classifier.coefficients), self.classifier.intercept]
        elif isinstance(self.classifier, BO.HistogramBooster):
            trees = self.classifier.to_json()
        elif isinstance(self.classifier, FO.Forest):
            kept = os.path.join(path, "forest")
            self.classifier.trees().write.mode("overwrite").parquet(kept)
            forest = [self.classifier.names, [e.tolist() for e in self.classifier.edges], kept, self.classifier.importance]
        else:
            self.classifier.write().overwrite().save(os.path.join(path, "classifier"))
        if self.features.tables:
            kept = os.path.join(path, "encoder")
            spark.read.parquet(next(iter(self.features.tables.values()))).write.mode("overwrite").parquet(kept)
            features["tables"] = dict.fromkeys(self.features.tables, kept)
        blob = {"name": self.name, "threshold": self.threshold, "metadata": self.metadata, "linear": linear, "trees": trees, "forest": forest,
                "features": features, "spec": {k: v for k, v in asdict(self.spec).items()}}
        # written through Spark so that the path may be any shared filesystem
        spark.createDataFrame([(json.dumps(blob, default=list),)], "value string").coalesce(1) \
            .write.mode("overwrite").text(os.path.join(path, "model_json"))

    @staticmethod
    def load(path: str, version: str | None = None) -> "TrainedModel":
        """The newest whole version below ``path``, or the given one."""
        spark = SparkSession.getActiveSession()
        path = versions.latest(spark, path, version)
        blob = json.loads(spark.read.text(os.path.join(path, "model_json")).first()[0])
        if blob.get("linear"):
            clf = LinearClassifier(tuple(blob["linear"][0]), blob["linear"][1])
        elif blob.get("trees"):
            clf = BO.HistogramBooster.from_json(blob["trees"])
        elif blob.get("forest"):
            names, edges, kept, importance = blob["forest"]
            clf = FO.Forest(names, [np.array(e, float) for e in edges], kept, importance, spark)
        else:
            loader = {"LogisticRegression": LogisticRegressionModel, "RandomForest": RandomForestClassificationModel}[blob["name"]]
            clf = loader.load(os.path.join(path, "classifier"))
        sp = blob["spec"]
        spec = Spec(**{k: (tuple(v) if isinstance(v, list) else v) for k, v in sp.items()})
        fm = FT.FeatureModel(**blob["features"])
        return TrainedModel(spec, blob["name"], fm, clf, blob["threshold"], blob["metadata"])


def logistic_gradient(df: DataFrame, model: TrainedModel, test_fraction: float = 0.2, folds: int = 5,
                      seed: int = 42) -> DataFrame:
    """(parameter, gradient) of the penalised, weighted mean loss of a logistic
    regression at its coefficients, over the rows it was trained on: near zero
    if the fit converged."""
    spec = model.spec
    slim = FT.project_features(spec.with_label(df), spec, keep=[spec.label_col])
    rows = _weighted(FT.assign_split(slim, spec, test_fraction, folds, seed).where(F.col("split") == "train"), spec)
    x = FT.transform_features(rows, model.features, keep=[spec.label_col, "weight"], vector_col=None)
    names = model.features.names
    error = F.col("weight") * (F.col("_p") - F.col(spec.label_col))
    sums = add_score(x, model.classifier, names, "_p").agg(
        F.sum("weight").alias("w"), F.sum(error).alias("g"), *[F.sum(error * F.col(c)).alias(f"g{i}") for i, c in enumerate(names)])
    coefficients, _ = linear_terms(model.classifier)
    parts = [F.struct(F.lit("intercept").alias("parameter"), (F.col("g") / F.col("w")).alias("gradient"))]
    parts += [F.struct(F.lit(c).alias("parameter"), ((F.col(f"g{i}") + F.lit(b)) / F.col("w")).alias("gradient"))
              for i, (c, b) in enumerate(zip(names, coefficients, strict=True))]
    return sums.select(F.inline(F.array(*parts)))


REPORT = "model string, scope string, metric string, value double"


def report_of(spark: SparkSession, model: TrainedModel) -> DataFrame:
    """The metrics table of a trained or loaded model (model, scope, metric, value)."""
    return spark.createDataFrame([tuple(r) for r in model.metadata.get("report", [])], REPORT)


def train(df: DataFrame, spec: Spec, names=None, folds: int = 5, test_fraction: float = 0.2, seed: int = 42,
          overrides: dict | None = None, cv: bool = True, threshold_split: str = "test"):
    """E2 end to end: exact stratified split -> CV comparison -> best model
    refit on the train split -> held-out evaluation and Youden threshold.
    The threshold is chosen on ``threshold_split`` ('test' as the reference
    does, which is optimistic; 'train' keeps the test split untouched).
    Returns the trained model and a long-form metrics table."""
    ensure_checkpoint_dir(df.sparkSession)
    names = list(names or CANDIDATES)
    overrides = overrides or {}
    # M1: all that training reads, derived once (the split reads its rows twice)
    slim = staged(FT.project_features(spec.with_label(df), spec, keep=[spec.label_col]), "slim")
    split = FT.assign_split(slim, spec, test_fraction, folds, seed).checkpoint(eager=True)
    drop_staged(slim)
    train_rows = split.where(F.col("split") == "train")
    test_rows = split.where(F.col("split") == "test")
    if cv and len(names) > 1:
        summary = summarize_cv(cross_validate(train_rows, spec, names, folds, seed, overrides),
                               digits=None).checkpoint(eager=True)
        best = select_best(summary)
    else:
        summary, best = None, names[0]
    fm, clf = fit_one(train_rows, spec, best, seed, **overrides.get(best, {}))
    scored = staged(score_with(test_rows, fm, clf, [spec.id_col, spec.label_col]), "test-scores")
    if threshold_split not in ("test", "train"):
        raise SpecError("threshold_split must be 'test' or 'train'")
    # one per-score table of the test split serves AUC, AP (and Youden)
    st_test = MX.score_table(scored).checkpoint(eager=True)
    if threshold_split == "test":
        yt = MX.youden_from_table(st_test).first()
    else:
        yt = MX.youden_threshold(score_with(train_rows, fm, clf, [spec.id_col, spec.label_col])).first()
    threshold = float(yt["threshold"]) if yt and yt["threshold"] is not None else DEFAULT_THRESHOLD
    def longform(df, prefix=""):
        return df.select(F.inline(F.array(*[
            F.struct(F.lit(best).alias("model"), F.lit("test").alias("scope"), F.lit(prefix + c).alias("metric"),
                     F.col(c).cast("double").alias("value")) for c in df.columns])))

    at_half = MX.threshold_metrics(scored, threshold=DEFAULT_THRESHOLD, digits=None)
    at_opt = MX.threshold_metrics(scored, threshold=threshold, digits=None).select("precision", "recall", "f1")
    test_long = (longform(MX.auc_from_table(st_test, digits=None))
                 .unionByName(longform(MX.ap_from_table(st_test, digits=None)))
                 .unionByName(longform(at_half, "at_0.5_"))
                 .unionByName(longform(at_opt, "at_optimal_")))
    extra = split.groupBy("split", "label").agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit(best).alias("model"), F.lit("split").alias("scope"),
        F.concat(F.col("split"), F.lit("_class_"), F.col("label").cast("string")).alias("metric"), "value")
    thr = test_long.sparkSession.createDataFrame(
        [(best, "test", "optimal_threshold", threshold)], "model string, scope string, metric string, value double")
    parts = [test_long, extra, thr]
    if summary is not None:
        parts.append(summary.select("model", F.lit("cv_mean").alias("scope"), "metric",
                                    F.round("mean", 4).alias("value")))
        parts.append(summary.where(F.col("metric") == "roc_auc").select(
            "model", F.lit("cv_std").alias("scope"), "metric", F.round("std", 4).alias("value")))
    report = parts[0]
    for p in parts[1:]:
        report = report.unionByName(p)
    rows = [list(r) for r in report.select("model", "scope", "metric", "value").collect()]  # a few dozen
    model = TrainedModel(spec, best, fm, clf, threshold,
                         {"n_folds": folds, "test_fraction": test_fraction, "report": rows})
    report = report_of(df.sparkSession, model)
    return model, report
