"""Feature preparation (M1-M9).

Fitted state is a handful of constants per feature (median, mean, std,
mode, category list), computed by distributed aggregates and kept as a
small ``FeatureModel``.  A feature of up to ``INLINE_CATEGORIES`` values is
encoded by a literal map; beyond that the fitted (value, index) table stays a
distributed table in the shared folder and the encoding is a join with it.

The stratified split and fold assignment are exact (class shares to the
row) without a window over a whole class: rows are ordered by a seeded
hash of the id, hash ranges are counted per class (bounded table), and
only rows sharing a hash range are ranked together.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapse.operators.quantiles import stacked_quantiles
from lapse.spec import Spec, SpecError, require_columns
from lapse.staging import shared_path, staged

#: Categories of a feature that are kept on the driver and in the plan.
INLINE_CATEGORIES = 1000


def project_features(df: DataFrame, spec: Spec, keep=()) -> DataFrame:
    """M1: id, features (numeric then categorical) and ``keep``; error
    listing every missing feature."""
    cols = [spec.id_col, *spec.features]
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise SpecError(f"these features or ids are not in the table: {', '.join(missing)}")
    return df.select(*cols, *[k for k in keep if k not in cols])


# ---------------------------------------------------------------- split / folds

def _hash(spec: Spec, seed: int):
    return F.xxhash64(F.col(spec.id_col).cast("string"), F.lit(seed))


def assign_split(df: DataFrame, spec: Spec, test_fraction: float = 0.2, folds: int = 5,
                 seed: int = 42, method: str = "exact") -> DataFrame:
    """M7/M8: adds ``split`` ('train'/'test') and ``fold`` (0..folds-1 for
    train rows, NULL for test) stratified by the label.

    ``exact``: per class, the round(test_fraction * n) rows with the
    smallest hash go to test, and train rows are dealt to folds by rank, so
    fold sizes differ by at most one per class.  ``hash``: no shuffle at
    all, shares are exact only in expectation.  Rows without a label are a
    class of their own: every row comes back."""
    df = spec.with_label(df)
    h = _hash(spec, seed)
    if method == "hash":
        u = F.pmod(h, F.lit(1000000)).cast("double") / 1000000.0
        f = F.pmod(_hash(spec, seed + 1), F.lit(folds)).cast("int")
        return df.withColumn("split", F.when(u < test_fraction, "test").otherwise("train")).withColumn(
            "fold", F.when(F.col("split") == "train", f))
    if method != "exact":
        raise SpecError("method must be 'exact' or 'hash'")
    lab = spec.label_col
    keyed = df.withColumn("_h", h).withColumn(
        "_r", F.shiftrightunsigned(F.col("_h").bitwiseXOR(F.lit(-(1 << 63))), 64 - 16).cast("int"))
    # hash ranges per class: at most 2 x 65536 rows whatever the input size
    hist = keyed.groupBy(lab, "_r").agg(F.count(F.lit(1)).alias("_c"))
    wcum = Window.partitionBy(lab).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.select(lab, "_r", F.coalesce(F.sum("_c").over(wcum), F.lit(0)).alias("_before"),
                       F.sum("_c").over(Window.partitionBy(lab)).alias("_n"))
    wrow = Window.partitionBy(lab, "_r").orderBy("_h", F.col(spec.id_col).cast("string"))
    ranked = keyed.withColumn("_rn", F.row_number().over(wrow)).join(
        hist.select(F.col(lab).alias("_lab"), F.col("_r").alias("_r2"), "_before", "_n"),
        F.col(lab).eqNullSafe(F.col("_lab")) & (F.col("_r") == F.col("_r2")))
    rank = F.col("_before") + F.col("_rn") - 1
    k_test = F.round(F.col("_n") * F.lit(float(test_fraction)), 0).cast("long")
    is_test = rank < k_test
    return ranked.select(
        *df.columns,
        F.when(is_test, "test").otherwise("train").alias("split"),
        F.when(~is_test, F.pmod(rank - k_test, F.lit(folds))).cast("int").alias("fold"),
    )


def class_weights(df: DataFrame, spec: Spec, weight_col: str = "weight") -> DataFrame:
    """M9: balanced weights n / (2 * n_class).  The label is 0 or 1, so the
    weights are two literals after one count; rows without a label have a null
    weight and are not counted."""
    df = spec.with_label(df)
    y = F.col(spec.label_col).cast("int")
    n0, n1 = df.agg(F.count_if(y == 0), F.count_if(y == 1)).first()
    n, k = n0 + n1, (n0 > 0) + (n1 > 0)
    w = F.when(y == 0, F.lit(n / (k * n0) if n0 else None)).when(y == 1, F.lit(n / (k * n1) if n1 else None))
    return df.withColumn(weight_col, w.cast("double"))


# ---------------------------------------------------------------- fit / transform

@dataclass
class FeatureModel:
    numeric: list[str]
    categorical: list[str]
    medians: dict = field(default_factory=dict)
    means: dict = field(default_factory=dict)
    stds: dict = field(default_factory=dict)
    modes: dict = field(default_factory=dict)
    categories: dict = field(default_factory=dict)  # feature -> sorted list of values
    tables: dict = field(default_factory=dict)  # feature -> path of its (value, index) table, if it has too many

    @property
    def names(self) -> list[str]:
        return self.numeric + self.categorical


def category_counts(df: DataFrame, columns) -> DataFrame:
    """(feature, value, count) over all categorical columns in one pass:
    the columns are stacked long-form and counted with a partial aggregate."""
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns]
    return (
        df.select(F.inline(F.array(*pairs)))
        .where(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def _indexed(counts: DataFrame, path: str) -> None:
    """Write (feature, value, index): the rank of each value among the sorted
    values of its feature.  Values are dealt out by range, so each task ranks
    its own run and only run sizes are added up."""
    spark = counts.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    runs = staged(counts.select("feature", "value").repartitionByRange(parts, "feature", "value")
                  .withColumn("run", F.spark_partition_id()), "runs")
    sizes = runs.groupBy("feature", "run").agg(F.count(F.lit(1)).alias("n"))  # at most runs + features rows
    before = Window.partitionBy("feature").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("feature", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("feature", "run").orderBy("value"))
    runs.withColumn("own", own).join(F.broadcast(sizes), ["feature", "run"]).select(
        "feature", "value", (F.col("before") + F.col("own") - 1).cast("double").alias("index")).write.parquet(path)


def fit_features(train: DataFrame, spec: Spec, exact: bool = True,
                 inline_categories: int = INLINE_CATEGORIES, accuracy: int = 100000) -> FeatureModel:
    """M2-M5 fitted on ``train``: exact interpolated median, mean and
    population std of the imputed values (zero std -> 1), most frequent
    value (lowest on ties) and the sorted categories per feature.
    ``inline_categories`` only chooses where they are kept."""
    num, cat = list(spec.numeric), list(spec.categorical)
    require_columns(train, num + cat)
    model = FeatureModel(num, cat)
    if num:
        # the mean and population std after median imputation follow exactly
        # from the moments of the present values (Chan's parallel-variance
        # combination with n_missing copies of the median)
        aggs = []
        for i, c in enumerate(num):
            x = F.col(c).cast("double")
            aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}")]
            if not exact:
                aggs.append(F.percentile_approx(x, 0.5, 10000).alias(f"q{i}"))
        row = train.agg(F.count(F.lit(1)).alias("rows"), *aggs).first()
        medians = {r["feature"]: r["q0"] for r in stacked_quantiles(train, num, [0.5], accuracy).collect()} if exact \
            else {c: row[f"q{i}"] for i, c in enumerate(num)}
        n = row["rows"]
        for i, c in enumerate(num):
            med = float(medians[c]) if medians.get(c) is not None else 0.0
            na = row[f"n{i}"]
            nb = n - na
            if na == 0:
                mean, var = med, 0.0
            else:
                ma, m2a = float(row[f"m{i}"]), float(row[f"v{i}"]) * na
                delta = med - ma
                mean = ma + delta * nb / n
                var = (m2a + delta * delta * na * nb / n) / n
            model.medians[c] = med
            model.means[c] = mean
            std = var ** 0.5
            model.stds[c] = std if std > 0 else 1.0
    if cat:
        counts = staged(category_counts(train, cat), "categories")
        # per feature: how many values, and the most frequent (lowest on ties)
        top = {r["feature"]: r for r in counts.groupBy("feature").agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.struct((-F.col("count")).alias("c"), F.col("value").alias("v"))).alias("m")).collect()}
        few = [c for c in cat if c not in top or top[c]["n"] <= inline_categories]
        kept = {c: [] for c in few}
        for r in counts.where(F.col("feature").isin(few)).collect():  # at most inline_categories a feature
            kept[r["feature"]].append(r["value"])
        model.categories = {c: sorted(v) for c, v in kept.items()}
        model.modes = {c: top[c]["m"]["v"] if c in top else None for c in cat}
        many = [c for c in cat if c not in few]
        if many:
            path = shared_path(train.sparkSession, "encoder")
            _indexed(counts.where(F.col("feature").isin(many)), path)
            model.tables = dict.fromkeys(many, path)
    return model


def _join_indexes(df: DataFrame, model: FeatureModel) -> DataFrame:
    """``df`` with _i_<feature> for the features encoded by a join.  The
    tables are read from files, so their size decides how they are joined."""
    for c, path in model.tables.items():
        table = df.sparkSession.read.parquet(path).where(F.col("feature") == c).select(
            F.col("value").alias(f"_v_{c}"), F.col("index").alias(f"_i_{c}"))
        value = F.coalesce(F.col(c).cast("string"), F.lit(model.modes.get(c)))
        df = df.join(table, value == F.col(f"_v_{c}"), "left").drop(f"_v_{c}")
    return df


def transform_features(df: DataFrame, model: FeatureModel, keep=(), digits: int | None = None,
                       vector_col: str | None = "features") -> DataFrame:
    """Apply the fitted model: numeric -> (coalesce(x, median) - mean) / std;
    categorical -> index in the sorted category list of coalesce(x, mode),
    -1 when unseen (M5).  Column expressions in one projection, after one
    join for each feature with too many categories for a literal map."""
    df = _join_indexes(df, model)
    out = []
    for c in model.numeric:
        e = (F.coalesce(F.col(c).cast("double"), F.lit(model.medians[c])) - F.lit(model.means[c])) / F.lit(
            model.stds[c])
        out.append((F.round(e, digits) if digits is not None else e).alias(c))
    for c in model.categorical:
        if c in model.tables:
            out.append(F.coalesce(F.col(f"_i_{c}"), F.lit(-1.0)).alias(c))
            continue
        cats = model.categories.get(c, [])
        mapping = F.create_map(*[x for i, v in enumerate(cats) for x in (F.lit(v), F.lit(float(i)))]) \
            if cats else None
        v = F.coalesce(F.col(c).cast("string"), F.lit(model.modes.get(c)))
        e = F.coalesce(F.try_element_at(mapping, v), F.lit(-1.0)) if mapping is not None else F.lit(-1.0)
        out.append(e.alias(c))
    res = df.select(*keep, *out)
    if vector_col:
        res = VectorAssembler(inputCols=model.names, outputCol=vector_col).transform(res)
    return res


def feature_defaults(df: DataFrame, spec: Spec) -> DataFrame:
    """The fill-in value of every feature over all rows: median for
    numeric, most frequent (lowest on ties) for categorical, as text."""
    num, cat = list(spec.numeric), list(spec.categorical)
    rows = []
    if num:
        med = stacked_quantiles(df, num, [0.5])
        rows.append(med.select("feature", F.col("q0").alias("numeric_default"),
                               F.lit(None).cast("string").alias("categorical_default")))
    if cat:
        modes = category_counts(df, cat).groupBy("feature").agg(
            F.min(F.struct((-F.col("count")).alias("nc"), F.col("value").alias("v"))).alias("m"))
        rows.append(modes.select("feature", F.lit(None).cast("double").alias("numeric_default"),
                                 F.col("m.v").alias("categorical_default")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
