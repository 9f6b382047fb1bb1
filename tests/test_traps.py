"""Hand-made rows for the semantic traps of the reference (pandas null
handling, ties, constant columns, bucket edges, unseen categories)."""

import pytest
from pyspark.sql import functions as F

from lapse.operators import aggregates as A
from lapse.operators import cleaning as S
from lapse.operators import features as FT
from lapse.operators import metrics as MX
from lapse.operators import profiling as P
from lapse.operators import ranking as T
from lapse.spec import Spec, SpecError

SPEC = Spec(id_col="id", target_col="target", positive="Yes", negative="No",
            numeric=("x",), categorical=("k",), tenure_col="tenure", charge_col="charge")


def test_dirty_customers_cleaning(spark):
    rows = [
        ("A1", 0, " ", 1, "Yes"),       # blank total at tenure 0 -> imputed 0.0
        ("A2", 5, "", 0, "No"),         # blank total at tenure > 0 -> dropped
        (" A3 ", 3, " 12.5 ", 0, "No"),  # padded strings
        ("A4", 4, "20", 1, None),       # missing target -> label 0
        ("A4", 4, "20", 1, None),       # exact duplicate
        ("A5", 2, "abc", 0, "Yes"),     # non-numeric -> dropped
    ]
    raw = spark.createDataFrame(rows, "id string, tenure int, total string, flag int, target string")
    plan = S.CleanPlan(measure="total", tenure_col="tenure", int_cols=("flag",))
    out = {r["id"]: r for r in S.clean(raw, SPEC, plan).collect()}
    assert set(out) == {"A1", "A3", "A4"}
    assert out["A1"]["total"] == 0.0 and out["A1"]["label"] == 1
    assert out["A3"]["total"] == 12.5
    assert out["A4"]["label"] == 0
    rep = S.clean_report(raw, SPEC, plan).first()
    assert (rep["n_input"], rep["n_imputed"], rep["n_dropped"], rep["n_duplicates"], rep["n_output"]) == (6, 1, 2, 1, 3)


@pytest.fixture
def null_groups(spark):
    rows = [("a", 1.0, "Yes"), ("a", 3.0, "No"), (None, 5.0, "Yes"), ("b", None, "No"),
            ("c", 2.0, None), ("d", None, "Yes"), ("d", None, "No")]
    return spark.createDataFrame(rows, "k string, x double, target string")


def test_null_group_semantics(null_groups):
    r = {row["k"]: row for row in A.group_rate(null_groups, SPEC, "k").collect()}
    assert None not in r  # missing keys dropped
    assert r["c"]["rate_pct"] == 0.0  # missing outcome counts as "not"
    s = {row["k"]: row["sum_x"] for row in A.group_aggregate(null_groups, "k", "x", "sum").collect()}
    assert s["d"] == 0.0  # all-missing group sums to 0
    sd = {row["k"]: row["std_x"] for row in A.group_aggregate(null_groups, "k", "x", "std").collect()}
    assert sd["c"] is None  # one-row group
    counts = {row["value"]: row["count"] for row in A.value_counts(null_groups, "k").collect()}
    assert counts[None] == 1  # value counts keep missing
    m = P.get_missing_values(null_groups).collect()
    assert {(r["column"], r["n_missing"]) for r in m} == {("k", 1), ("x", 3), ("target", 1)}


def test_group_by_target_itself_allowed(null_groups):
    out = A.group_aggregate(null_groups, "target", "target", "count").collect()
    assert {r["target"] for r in out} == {"Yes", "No"}


def test_constant_and_pairwise_missing_correlation(spark):
    rows = [(1.0, 2.0), (1.0, 3.0), (1.0, None), (1.0, 5.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    assert A.correlation_pair(df, "x", "y").first()["pearson_r"] is None  # no error under ANSI
    df2 = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 6.0), (4.0, 8.0)], "x double, y double")
    assert A.correlation_pair(df2, "x", "y").first()["pearson_r"] == 1.0


def test_tenure_edges(spark):
    rows = [(0, 1.0, "Yes"), (12, 1.0, "No"), (13, 2.0, "No"), (72, 3.0, "Yes"), (73, 4.0, "Yes"),
            (None, 5.0, "No"), (-1, 6.0, "Yes")]
    df = spark.createDataFrame(rows, "tenure int, charge double, target string")
    out = {r["tenure_bucket"]: r["count"] for r in A.tenure_trend(df, SPEC).collect()}
    assert out == {"0-12": 2, "13-24": 1, "61-72": 1}


def test_operator_semantics(spark):
    df = spark.createDataFrame([("a.b", 1), (None, 2), ("A+B", 3), ("axb", None)], "s string, n int")
    cnt = lambda col, v, op, **kw: A.filter_and_count(df, col, v, op, **kw).first()["count"]
    assert cnt("s", "a.b", "ne") == 3  # missing matches ne
    assert cnt("s", "a.b", "eq") == 1
    assert cnt("s", "a.b", "contains") == 3  # regex: '.' matches any char, case-insensitive
    assert cnt("s", "a.b", "contains", literal=True) == 1
    assert cnt("n", 2, "gte") == 2  # missing never matches
    with pytest.raises(SpecError):
        A.filter_and_count(df, "s", 3, "gt")  # number against a string column


def test_scored_ties_and_levels(spark):
    rows = [(1, 1, 0.70), (2, 0, 0.70), (3, 1, 0.40), (4, 0, 0.40), (5, 0, 0.1), (6, 1, 0.9)]
    df = spark.createDataFrame(rows, "id long, label int, score double")
    # pairs: 0.70 vs (tie, 1, 1), 0.40 vs (0, tie, 1), 0.90 vs (1, 1, 1)
    assert MX.roc_auc(df).first()["roc_auc"] == pytest.approx(7 / 9, abs=1e-6)
    tiers = {r["risk_level"]: r["count"] for r in T.tier_counts(df, "score").collect()}
    assert tiers == {"High": 3, "Medium": 2, "Low": 1}
    one_class = df.where("label = 1")
    assert MX.roc_auc(one_class).first()["roc_auc"] is None
    m = MX.threshold_metrics(df, threshold=0.95).first()
    assert (m["tp"], m["precision"], m["f1"]) == (0, 0.0, 0.0)  # zero division -> 0
    yt = MX.youden_threshold(df).first()
    assert yt["threshold"] == 0.9  # highest threshold on ties


def test_encoding_unseen_and_mode_tie(spark):
    train = spark.createDataFrame([("b", 1.0), ("a", 2.0), ("b", None), ("a", 4.0), (None, 5.0)],
                                  "k string, x double")
    spec = Spec(id_col="x", target_col="k", positive="a", numeric=("x",), categorical=("k",))
    fm = FT.fit_features(train, spec)
    assert fm.modes["k"] == "a"  # tie -> lowest value
    assert fm.categories["k"] == ["a", "b"]
    assert fm.medians["x"] == 3.0
    test = spark.createDataFrame([("c", 1.0), (None, None), ("b", 3.0)], "k string, x double")
    out = FT.transform_features(test, fm, vector_col=None).collect()
    assert [r["k"] for r in out] == [-1.0, 0.0, 1.0]  # unseen -> -1, missing -> mode 'a'


def test_exact_split_shares(spark):
    df = spark.range(0, 1003).select(F.col("id"), F.when(F.col("id") % 4 == 0, "Yes").otherwise("No").alias("target"))
    spec = Spec(id_col="id", target_col="target", positive="Yes")
    s = FT.assign_split(df, spec, 0.2, 5)
    counts = {(r["split"], r["label"]): r["count"] for r in s.groupBy("split", "label").count().collect()}
    assert counts[("test", 1)] == round(251 * 0.2) and counts[("test", 0)] == round(752 * 0.2)
    sizes = s.where("split = 'train'").groupBy("label", "fold").count()
    spread = sizes.groupBy("label").agg((F.max("count") - F.min("count")).alias("d")).collect()
    assert all(r["d"] <= 1 for r in spread)  # fold sizes differ by at most one per class


def test_lookup_normalised(spark):
    df = spark.createDataFrame([("7590-VHVEG", 1), ("1111-AAAAA", 2)], "id string, v int")
    spec = Spec(id_col="id", target_col="v", positive="1")
    assert T.lookup_ids(df, spec, [" 7590-vhveg "]).count() == 1
    assert T.lookup_ids(df, spec, ["NON-EXISTENT-ID"]).count() == 0


def test_top_n_missing_last(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, 1.0)], "id int, v double")
    assert [r["id"] for r in T.top_n_records(df, "v", 3, tie_break="id").collect()] == [2, 3, 1]
    assert [r["id"] for r in T.top_n_records(df, "v", 3, ascending=True, tie_break="id").collect()] == [3, 2, 1]
